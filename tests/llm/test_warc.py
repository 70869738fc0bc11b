import random

from pyspark.sql import functions as F

from conftest import SF_MID
from threadlens.llm import warc as W
from threadlens.testing import compare, duckdb_views

SCHEMA = ("record_id long, url string, captured_at long, kind string, etag string, last_modified string, digest string, "
          "headers map<string,string>, payload string")


def records(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def test_query_matches_sql(spark):
    res = compare(W.revisits_query(spark, SF_MID), duckdb_views(SF_MID), W.ORACLE_SQL)
    assert res["values_match"], res


def test_canonical_url(spark):
    same = ["http://www.Example.com:80/a/b.html?x=2&utm_source=q&a=1#top", "https://m.example.com/a/b/?a=1&x=2",
            " HTTPS://example.com/a/b?a=1&x=2&ref=z "]
    rows = spark.createDataFrame([(u,) for u in same + [None, "", "http://example.com/"]], "u string")
    got = [r[0] for r in rows.select(W.canonical_url(F.col("u"))).collect()]
    assert set(got[:3]) == {"https://example.com/a/b?a=1&x=2"}
    assert got[3] is None and got[4] == "https://" and got[5] == "https://example.com"


def test_against_a_loop_over_all_records(spark):
    """One hot URL holds most captures; ties in time; several bucket widths."""
    rng = random.Random(1)
    rows = []
    for i in range(400):
        url = "http://hot.example/x" if rng.random() < 0.6 else f"http://site{rng.randrange(20)}.example/"
        kind = rng.choice(["response", "revisit", "revisit", "request"])
        rows.append((i, rng.choice([url, url, None]) if rng.random() < 0.05 else url, rng.randrange(300), kind,
                     rng.choice([None, "a", "b", "W/a"]), rng.choice([None, "m"]), rng.choice([None, "d", "e"]),
                     {"A": str(i)}, f"p{i}"))
    want = {}
    for r in rows:
        if r[3] != "revisit":
            continue
        earlier = [q for q in rows if q[3] == "response" and q[1] == r[1] and r[1] and (q[2], q[0]) < (r[2], r[0])]
        if not earlier:
            want[r[0]] = (W.MISSING, None, None)
            continue
        q = max(earlier, key=lambda q: (q[2], q[0]))
        strip = lambda e: e[2:] if e and e.startswith("W/") else e
        pairs = [(strip(r[4]), strip(q[4])), (r[5], q[5]), (r[6], q[6])]
        both = [(a, b) for a, b in pairs if a is not None and b is not None]
        outcome = W.UNVALIDATED if not both else W.RESOLVED if all(a == b for a, b in both) else W.MISMATCH
        want[r[0]] = (outcome, q[0], q[8] if outcome == W.RESOLVED else None)
    for width in (1, 50, 10_000):
        got = {r["record_id"]: (r["outcome"], r["response_id"], r["payload"])
               for r in W.resolve_revisits(records(spark, rows), width).collect()}
        assert got == want


def test_header_merge(spark):
    rows = [(1, "http://a/", 1, "response", "e", None, None,
             {"Content-Type": "text/html", "ETag": "e", "Cache-Control": "max-age=1", "content-length": "9"}, "body"),
            (2, "http://a/", 2, "revisit", "e", None, None,
             {"etag": "e2", "Content-Length": "0", "CACHE-CONTROL": "no-store", "cache-control": "x", "Server": "s"}, None),
            (3, "http://a/", 3, "revisit", "e", None, None, None, None)]
    got = {r["record_id"]: r["headers"] for r in W.resolve_revisits(records(spark, rows)).collect()}
    assert got[2] == {"content-type": "text/html", "etag": "e2", "cache-control": "no-store", "content-length": "9"}
    assert got[3] == {"content-type": "text/html", "etag": "e", "cache-control": "max-age=1", "content-length": "9"}


def test_odd_records(spark):
    rows = [(1, None, 1, "response", "e", None, None, None, "x"), (2, None, 2, "revisit", "e", None, None, None, None),
            (3, "http://a/", None, "response", "e", None, None, None, "x"),
            (4, "http://a/", 5, "revisit", "e", None, None, None, None),
            (5, "http://b/", 1, "response", "", "", "", {}, ""), (6, "http://b/", 1, "revisit", "", None, None, {}, None),
            (7, "http://b/", 1, "response", "", "", "", {}, "later"), (8, "http://c/", 9, None, "e", "m", "d", None, None),
            (9, "http://b/", None, "revisit", "", None, None, {}, None)]
    clash = records(spark, [r + ("q", "q") for r in rows], SCHEMA + ", canonical_url string, near string")
    got = {r["record_id"]: (r["outcome"], r["response_id"], r["payload"]) for r in W.resolve_revisits(clash).collect()}
    assert got == {2: (W.MISSING, None, None), 4: (W.MISSING, None, None), 6: (W.RESOLVED, 5, ""),
                   9: (W.MISSING, None, None)}
    assert W.resolve_revisits(records(spark, [])).count() == 0
    pages = spark.createDataFrame([(None, None, None), (1, None, "x"), (2, "http://a/", None)],
                                  "page_id long, url string, html string")
    assert W.resolve_revisits(W.captures_of_pages(pages.filter("page_id is not null"))).count() == 6
