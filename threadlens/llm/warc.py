"""WARC revisit resolution: an as-of join by canonical URL.

A revisit record (a 304 answer) stands for the payload of an earlier capture.
It resolves to the latest earlier full response of its canonical URL, if its
validators agree with that response; the resolved record has the payload of
the response and its headers, updated by the permitted headers of the revisit.

The as-of join is two windows over narrow rows (no payload, no headers). A URL
may hold a third of all captures, so the first window works within (URL, time
bucket), and carries the latest response of the bucket along; a second one
works over one row for each URL and bucket, to hand the latest response of all
earlier buckets on. Payload and headers join at the end, by record id.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Headers that a 304 answer may update (RFC 9110, 15.4.5; RFC 9111, 3.2), lower case (fixed values).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Seconds of a time bucket: a hot URL is split into that many seconds of captures.
BUCKET_SECONDS = 6 * 3600
RESOLVED, MISMATCH, UNVALIDATED, MISSING = "resolved", "validator_mismatch", "no_validator", "no_earlier_response"


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, http as https, no default port, no
    leading ``www.`` or ``m.``, no fragment, no tracking parameters, the
    parameters in order, no trailing slash or ``.html``. Null stays null."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^(www|m)[.]", "")
    rest = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    path = F.regexp_replace(F.regexp_replace(rest, "[?].*$", ""), "([.]html)?/*$", "")
    query = F.regexp_extract(rest, "[?](.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref|fbclid|gclid)="))
    return F.when(url.isNotNull(), F.concat(
        F.lit("https://"), host, path,
        F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise("")))


def resolve_revisits(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """One row for each revisit of ``records``: (record_id, canonical_url,
    captured_at, outcome, response_id, headers, payload).

    ``records`` has record_id, url, captured_at (epoch seconds), kind
    ('response' or 'revisit'), etag, last_modified, digest, headers
    (map<string,string>) and payload; other columns are ignored. Record ids
    are unique and not null.

    A response is earlier if its time is smaller, or equal with a smaller
    record id; of several the latest by (time, id) counts. Validators: every one
    of etag (weak marks ignored), last_modified and digest that both records
    have must agree, and they must share one (else ``no_validator``). Without an
    earlier response, and for a null URL or time, the outcome is
    ``no_earlier_response``; only resolved revisits have headers and payload.
    Header names are compared in lower case; of names that differ in case only
    the first in order counts. Empty texts are values like any other; other
    kinds of records are left out; no rows give no rows.
    """
    at = F.struct(F.col("captured_at").alias("at"), F.col("record_id").alias("id"))
    narrow = (records.filter(F.col("kind").isin("response", "revisit")).select(
        "record_id", "captured_at", "kind", "etag", "last_modified", "digest",
        canonical_url(F.col("url")).alias("canonical_url"),
        F.floor(F.col("captured_at") / bucket_seconds).alias("bucket")))
    usable = F.col("canonical_url").isNotNull() & F.col("captured_at").isNotNull()
    response = F.struct(at.alias("at"), "etag", "last_modified", "digest")
    keyed = narrow.filter(usable).select(
        "*", at.alias("at"), F.when(F.col("kind") == "response", response).alias("own"))
    inside = W.partitionBy("canonical_url", "bucket").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    revisits = (keyed.withColumn("near", F.last("own", ignorenulls=True).over(inside))
                .filter(F.col("kind") == "revisit").drop("own", "at"))
    # one row for each URL and bucket
    latest = keyed.groupBy("canonical_url", "bucket").agg(F.max("own").alias("own"))
    before = W.partitionBy("canonical_url").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = latest.select("canonical_url", "bucket", F.last("own", ignorenulls=True).over(before).alias("far"))
    found = (revisits.join(carried, ["canonical_url", "bucket"]).withColumn("found", F.coalesce("near", "far"))
             .drop("near", "far"))
    lost = narrow.filter(~usable & (F.col("kind") == "revisit")).select(
        *[F.lit(None).cast(found.schema["found"].dataType).alias(c) if c == "found" else F.col(c) for c in found.columns])
    judged = found.unionByName(lost).withColumn("outcome", _outcome()).select(
        "record_id", "canonical_url", "captured_at", "outcome",
        F.when(F.col("outcome") != MISSING, F.col("found.at.id")).alias("response_id"))
    judged = judged.withColumn("use_id", F.when(F.col("outcome") == RESOLVED, F.col("response_id")))
    responses = records.filter(F.col("kind") == "response").select(
        F.col("record_id").alias("use_id"), F.col("headers").alias("old"), "payload")
    updates = records.filter(F.col("kind") == "revisit").select("record_id", F.col("headers").alias("new"))
    resolved = (judged.filter(F.col("use_id").isNotNull()).join(updates, "record_id").join(responses, "use_id")
                .withColumn("headers", merged_headers(F.col("old"), F.col("new"))))
    columns = ["record_id", "canonical_url", "captured_at", "outcome", "response_id", "headers", "payload"]
    rest = judged.filter(F.col("use_id").isNull()).select(
        *columns[:5], F.lit(None).cast("map<string,string>").alias("headers"), F.lit(None).cast("string").alias("payload"))
    return resolved.select(*columns).unionByName(rest)


def _outcome() -> Column:
    agree, shared = F.lit(True), F.lit(False)
    for name in ("etag", "last_modified", "digest"):
        own, old = F.col(name), F.col(f"found.{name}")
        if name == "etag":
            own, old = F.regexp_replace(own, "^W/", ""), F.regexp_replace(old, "^W/", "")
        both = own.isNotNull() & old.isNotNull()
        agree = agree & (~both | (own == old))
        shared = shared | both
    return (F.when(F.col("found").isNull(), MISSING).when(~shared, UNVALIDATED)
            .when(~F.coalesce(agree, F.lit(False)), MISMATCH).otherwise(RESOLVED))


def merged_headers(old: Column, new: Column) -> Column:
    """The response's headers with the permitted ones of the revisit in place
    of theirs; names in lower case. A null map is an empty one."""
    empty = F.create_map().cast("map<string,string>")

    def lowered(headers: Column) -> Column:
        # of names that are equal in lower case the first in order
        entries = F.array_sort(F.map_entries(F.coalesce(headers, empty)))
        names = F.transform(entries, lambda e: F.lower(e["key"]))
        first = F.filter(F.transform(entries, lambda e, i: F.struct(
            F.lower(e["key"]).alias("key"), e["value"].alias("value"), i.alias("i"))),
            lambda e: F.array_position(names, e["key"]) == e["i"] + 1)
        return F.map_from_entries(F.transform(first, lambda e: F.struct(e["key"], e["value"])))

    update = F.map_filter(lowered(new), lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter(lowered(old), lambda k, _: ~F.map_contains_key(update, k))
    return F.map_concat(kept, update)


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """WARC records from ``pages``: each page gives a full response and three
    revisits (ids 4 x page_id to 4 x page_id + 3) at other times. The first
    revisit has the page's validators, the second an own ETag on every third
    page, the third a Last-Modified only, which the response lacks on every
    fifth page."""
    pages = pages.select("page_id", "url", "html", F.md5(F.coalesce("html", F.lit(""))).alias("page_digest"))
    digest, i = F.col("page_digest"), F.col("page_id")
    start = F.lit(1_700_000_000) + (i * 7919) % 864_000
    etag, modified = F.concat(F.lit('"'), digest, F.lit('"')), F.concat(F.lit("day "), (i % 28).cast("string"))

    def record(k: int, at, etag, modified, digest, headers, payload):
        return F.struct(
            (i * 4 + k).alias("record_id"), "url", at.alias("captured_at"),
            F.lit("revisit" if k else "response").alias("kind"), etag.cast("string").alias("etag"),
            modified.cast("string").alias("last_modified"), digest.cast("string").alias("digest"),
            F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in headers]).alias("headers"),
            payload.cast("string").alias("payload"))

    none = F.lit(None)
    size = F.length("html").cast("string")
    records = F.array(
        record(0, start, etag, F.when(i % 5 != 0, modified), digest,
               ["Content-Type", F.lit("text/html"), "Content-Length", F.coalesce(size, F.lit("0")), "ETag", etag,
                "Cache-Control", F.lit("max-age=60")], F.col("html")),
        record(1, start + 3600 * (1 + i % 40), F.concat(F.lit("W/"), etag), modified, none,
               ["etag", F.concat(F.lit("W/"), etag), "Content-Length", F.lit("0"), "Cache-Control", F.lit("no-cache")], none),
        record(2, start + 7200 * (1 + i % 30), F.when(i % 3 == 0, F.lit('"other"')).otherwise(etag), none, digest,
               ["Date", F.concat(F.lit("t"), (start + 7200 * (1 + i % 30)).cast("string")), "Server", F.lit("s")], none),
        record(3, start - 1800 + 60 * (i % 59), none, modified, none,
               ["Expires", F.lit("0"), "expires", F.lit("1")], none))
    return pages.select(F.explode(records).alias("r")).select("r.*")


def revisits_query(spark, sf_dir: str) -> DataFrame:
    """Op 1 over the captures of ``pages``, written once as the table of records."""
    from threadlens.llm.common import materialize, read

    found = resolve_revisits(materialize(captures_of_pages(read(spark, sf_dir, "pages")), "captures"))
    entries = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return found.select("record_id", "canonical_url", "captured_at", "outcome", "response_id",
                        F.array_join(entries, ";").alias("headers"), F.sha2("payload", 256).alias("payload_sha256"),
                        F.length("payload").cast("long").alias("payload_chars"))


#: DuckDB: every revisit with the latest earlier response by an ASOF-like argmax.
ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id AS i, url, html, md5(coalesce(html, '')) AS digest,
         1700000000 + (page_id * 7919) % 864000 AS t0, 'day ' || CAST(page_id % 28 AS VARCHAR) AS modified FROM pages),
u AS (
  SELECT *, regexp_replace(trim(url), '#.*$', '') AS u0 FROM p),
c AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u0, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), ':(80|443)$', ''),
                           '^(www|m)[.]', '') AS host,
         regexp_replace(u0, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', '') AS rest FROM u),
q AS (
  SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '[?](.*)$', 1), '&'),
                                  lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)='))) AS args FROM c),
k AS (
  SELECT i, html, digest, t0, modified, '"' || digest || '"' AS etag,
         CASE WHEN url IS NOT NULL THEN 'https://' || host
              || regexp_replace(regexp_replace(rest, '[?].*$', ''), '([.]html)?/*$', '')
              || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END END AS cu FROM q),
resp AS (
  SELECT i * 4 AS id, cu, t0 AS t, etag, CASE WHEN i % 5 <> 0 THEN modified END AS modified, digest, html FROM k),
rev AS (
  SELECT i * 4 + 1 AS id, cu, t0 + 3600 * (1 + i % 40) AS t, etag, modified, NULL AS digest, 'W/' || etag AS raw, 1 AS n FROM k
  UNION ALL
  SELECT i * 4 + 2, cu, t0 + 7200 * (1 + i % 30), CASE WHEN i % 3 = 0 THEN '"other"' ELSE etag END, NULL, digest, NULL, 2 FROM k
  UNION ALL
  SELECT i * 4 + 3, cu, t0 - 1800 + 60 * (i % 59), NULL, modified, NULL, NULL, 3 FROM k),
m AS (
  SELECT v.id, arg_max(r.id, struct_pack(t := r.t, i := r.id)) AS rid
  FROM rev v JOIN resp r ON v.cu = r.cu AND (r.t < v.t OR (r.t = v.t AND r.id < v.id)) GROUP BY v.id),
j AS (
  SELECT v.*, m.rid, r.etag AS r_etag, r.modified AS r_modified, r.digest AS r_digest, r.html, r.t AS r_t,
         CASE WHEN m.rid IS NULL THEN 'no_earlier_response'
              WHEN (v.etag IS NULL OR r.etag IS NULL) AND (v.modified IS NULL OR r.modified IS NULL)
                   AND (v.digest IS NULL OR r.digest IS NULL) THEN 'no_validator'
              WHEN coalesce(v.etag <> r.etag, false) OR coalesce(v.modified <> r.modified, false)
                   OR coalesce(v.digest <> r.digest, false) THEN 'validator_mismatch'
              ELSE 'resolved' END AS outcome
  FROM rev v LEFT JOIN m ON v.id = m.id LEFT JOIN resp r ON m.rid = r.id)
SELECT id AS record_id, cu AS canonical_url, t AS captured_at, outcome, rid AS response_id,
       CASE WHEN outcome = 'resolved' THEN
         'cache-control=' || CASE WHEN n = 1 THEN 'no-cache' ELSE 'max-age=60' END
         || ';content-length=' || coalesce(CAST(length(html) AS VARCHAR), '0') || ';content-type=text/html'
         || CASE WHEN n = 2 THEN ';date=t' || CAST(t AS VARCHAR) ELSE '' END
         || ';etag=' || CASE WHEN n = 1 THEN raw ELSE r_etag END
         || CASE WHEN n = 3 THEN ';expires=0' ELSE '' END END AS headers,
       CASE WHEN outcome = 'resolved' THEN sha256(html) END AS payload_sha256,
       CASE WHEN outcome = 'resolved' THEN CAST(length(html) AS BIGINT) END AS payload_chars
FROM j
"""
