"""Secret scan with a battery of randomness tests, in DataFrame functions only.

Three fixed patterns (assignments, access keys, long hex runs) give the base
spans. The method adds strings that look random: every run of 16 or more
characters of the usual encodings (hex, base32, base36, base64) is a candidate,
with or without digits, and so is every part of 16 or more between '-' and '_'
(the secret of a prefixed token). In one letter case '-' and '_' are not
symbols and are left out of the test (UUIDs, prefixed tokens joined); in both
cases they are the symbols of base64url. A random base32, base36 or base64
string that happens to hold letters only is uniform over the letters, so these
are tested against them, in classes of their own. Only strings without a letter have no
encoding (decimal numbers), nor those with fewer than 16 symbols once joined.
Each different candidate string, over all documents, goes through three tests
against a uniform random string of its inferred alphabet:

* chi-squared uniformity of the symbols (Wilson-Hilferty normal score);
* runs above and below the middle of the alphabet (Wald-Wolfowitz);
* serial correlation of neighbouring symbol values at lag 1.

Fisher's method combines the three p-values. For random strings the result
falls off as ``SURVIVAL`` says (near uniform; the tests are weakly dependent),
for ordinary ones (words, paths, counters) it piles up near 0. How well the
tests tell them apart depends on length and alphabet, so the false-discovery
control works within classes of both. Some ordinary strings reach the upper
half too, but there their p-values still fall: ``ORDINARY_TAIL`` of them or
fewer reach ``TAIL``, of the random ones SURVIVAL(TAIL) / SURVIVAL(HALF). So
the shape above ``HALF`` gives the random share of the class. A class whose
tail is within ``ERRORS`` standard errors of ordinary strings alone flags
nothing (single strings of a class cannot be told apart by a tail, so small
classes often flag nothing); one within that of random strings alone counts as
all random there. A threshold t then flags #(p >= t) strings, of which a known
number are random, and the class takes the smallest threshold whose estimated
share of others is at most ``FDR``, or none.

Documents without a span or candidate never enter a shuffle; the rest are
written once and joined with the flagged strings.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import materialize, text_or_empty
from threadlens.llm.spans import SPAN, find_spans, no_spans

#: The base patterns and the length each must reach.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32
#: Order of kinds at one start.
KINDS = ("assign", "access", "hex", "random")

#: Candidates, and the lower ends of the length classes.
MIN_CANDIDATE = 16
CANDIDATE = r"[A-Za-z0-9+/_-]{%d,}+={0,2}" % MIN_CANDIDATE
PART = r"[A-Za-z0-9+/]{%d,}+={0,2}" % MIN_CANDIDATE
LENGTHS = (16, 24, 32, 48, 64, 128)
#: Symbols of each encoding in the order of their values (fixed values).
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "letters": "abcdefghijklmnopqrstuvwxyz",
    "both-cases": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
}
FDR = 0.1
#: Thresholds on p, each with the share of random strings that reaches it (simulated: 3,000 strings of 16, 24, 40 and 64
#: symbols of every alphabet; the share at 0.5 is 0.53 to 0.56 in each of them).
SURVIVAL = {0.001: 0.996, 0.002: 0.994, 0.005: 0.988, 0.01: 0.980, 0.02: 0.966, 0.05: 0.933, 0.1: 0.885, 0.2: 0.800,
            0.3: 0.717, 0.4: 0.636, 0.5: 0.551, 0.6: 0.458, 0.7: 0.360, 0.8: 0.255, 0.9: 0.135, 0.95: 0.068}
THRESHOLDS = tuple(SURVIVAL)
#: Where the shape of the upper half is read, the share of its ordinary strings beyond TAIL (0.12 to 0.18 in simulated
#: camelCase, snake_case, slug and path strings of 16 to 23 characters), and standard errors.
HALF, TAIL, ORDINARY_TAIL, ERRORS = 0.5, 0.8, 0.18, 2.0


def base_spans(text: Column) -> Column:
    """The spans of the three patterns, in order of kind."""
    assign = F.filter(find_spans(text, ASSIGN, "assign"),
                      lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= MIN_ASSIGN)
    access = F.filter(find_spans(text, ACCESS, "access"), lambda s: s["end"] - s["start"] >= MIN_ACCESS)
    # a run of the hex letters is one match, so the short ones need not be found first
    hexes = find_spans(text, HEX[:-1] + "{%d,}" % MIN_HEX, "hex")
    return F.concat(
        F.when(text.contains(":") | text.contains("="), assign).otherwise(no_spans()),
        F.when(text.contains("AKIA"), access).otherwise(no_spans()),
        F.when(text.rlike("[0-9a-f]{%d}" % MIN_HEX), hexes).otherwise(no_spans()))


def joined(token: Column) -> Column:
    """The token without padding, '-' and '_'."""
    return F.regexp_replace(token, "[-_]|=+$", "")


def encoding_of(token: Column) -> Column:
    """Name of the inferred encoding; null without a letter or with fewer than
    16 symbols."""
    lower, upper, body = token.rlike("[a-z]"), token.rlike("[A-Z]"), joined(token)
    one_case = F.when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(body.rlike("^[A-Z2-7]+$"), "base32").when(
        body.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), "base36")
    # one letter case without a digit, beyond the six letters of hex
    one_case = F.when(body.rlike("^[A-Za-z]+$") & body.rlike("[G-Zg-z]"), "letters").otherwise(one_case)
    return (F.when(~(lower | upper), F.lit(None).cast("string"))
            .when(lower & upper, F.when(token.rlike("^[A-Za-z]+=*$"), "both-cases").otherwise("base64"))
            .when(F.length(body) < MIN_CANDIDATE, F.lit(None).cast("string"))
            .otherwise(F.coalesce(one_case, F.lit("base64"))))


def candidates(text: Column) -> Column:
    """The candidates, and their parts between '-' and '_' where they have some."""
    keep = lambda found: F.filter(found, lambda s: encoding_of(s["hit"]).isNotNull())
    found = find_spans(text, CANDIDATE, "random")
    parts = F.when(text.rlike("[-_]"), find_spans(text, PART, "random")).otherwise(no_spans())
    return F.when(text.rlike("[A-Za-z0-9+/_-]{%d}" % MIN_CANDIDATE), keep(F.array_union(found, parts))).otherwise(no_spans())


def widest(spans: Column) -> Column:
    """The spans that lie in no larger one."""
    size = lambda s: s["end"] - s["start"]
    return F.filter(spans, lambda s: ~F.exists(
        spans, lambda o: (o["start"] <= s["start"]) & (o["end"] >= s["end"]) & (size(o) > size(s))))


def normal_tail(z: Column) -> Column:
    """P(Z > z): Abramowitz and Stegun 26.2.17."""
    a = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + a * 0.2316419)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, upper).otherwise(1.0 - upper)


def battery(tokens: DataFrame, token_col: str = "token") -> DataFrame:
    """(token, encoding, n, p_uniform, p_runs, p_serial, p) for strings with an
    inferred encoding. A constant string has p_runs = p_serial = 0."""
    code = tokens.select(F.col(token_col).alias("token")).withColumn("encoding", encoding_of(F.col("token"))).filter(
        F.col("encoding").isNotNull())
    alphabet = F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv])[F.col("encoding")]
    body = F.when(F.col("encoding") == "base64", F.translate(F.regexp_replace("token", "=+$", ""), "-_", "+/")).otherwise(
        joined(F.col("token")))
    body = F.when(F.col("encoding").isin("hex", "base36", "letters"), F.lower(body)).otherwise(body)
    code = (code.withColumn("alphabet", alphabet).withColumn("body", body)
            .withColumn("k", F.length("alphabet").cast("double")).withColumn("n", F.length("body").cast("double"))
            .withColumn("chars", F.regexp_extract_all("body", F.lit("."), F.lit(0)))
            .withColumn("x", F.transform("chars", lambda c: (F.position(c, F.col("alphabet")) - 1).cast("double"))))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)
    neighbours = lambda f: F.zip_with(F.slice("x", F.lit(1), F.size("x") - 1), F.slice("x", F.lit(2), F.size("x") - 1), f)
    squares = total(F.transform("chars", lambda c: F.col("n") - F.length(F.replace(F.col("body"), c, F.lit("")))))
    code = (code.withColumn("chi2", F.col("k") * squares / F.col("n") - F.col("n"))
            .withColumn("high", total(F.transform("x", lambda v: F.when(v * 2 >= F.col("k"), 1.0).otherwise(0.0))))
            .withColumn("runs", 1 + total(neighbours(
                lambda a, b: F.when((a * 2 >= F.col("k")) != (b * 2 >= F.col("k")), 1.0).otherwise(0.0))))
            .withColumn("mean", total(F.col("x")) / F.col("n")))
    code = (code.withColumn("spread", total(F.transform("x", lambda v: (v - F.col("mean")) * (v - F.col("mean")))))
            .withColumn("joint", total(neighbours(lambda a, b: (a - F.col("mean")) * (b - F.col("mean")))))
            .withColumn("mu", 2 * F.col("high") * (F.col("n") - F.col("high")) / F.col("n") + 1))
    df = F.col("k") - 1
    z_chi = (F.cbrt(F.col("chi2") / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    var = (F.col("mu") - 1) * (F.col("mu") - 2) / (F.col("n") - 1)
    z_runs = F.when(var > 0, F.abs(F.col("runs") - F.col("mu")) / F.sqrt(var))
    z_serial = F.when(F.col("spread") > 0,
                      F.abs(F.col("joint") / F.col("spread") + 1 / F.col("n")) * F.sqrt("n"))
    two_sided = lambda z: F.coalesce(2 * normal_tail(z), F.lit(0.0))
    code = (code.withColumn("p_uniform", normal_tail(z_chi)).withColumn("p_runs", two_sided(z_runs))
            .withColumn("p_serial", two_sided(z_serial)))
    tests = [F.col(c) for c in ("p_uniform", "p_runs", "p_serial")]
    half = -sum((F.log(F.greatest(p, F.lit(1e-300))) for p in tests), F.lit(0.0))
    code = code.withColumn("half", half).withColumn(
        "p", F.least(F.lit(1.0), F.exp(-F.col("half")) * (1 + F.col("half") + F.col("half") * F.col("half") / 2)))
    return code.select("token", "encoding", F.col("n").cast("int").alias("n"), "p_uniform", "p_runs", "p_serial", "p")


def random_strings(tested: DataFrame, fdr: float = FDR) -> DataFrame:
    """The tokens that their class's threshold keeps; a class may have none."""
    low = F.array_max(F.filter(F.array(*[F.lit(x) for x in LENGTHS]), lambda x: x <= F.greatest("n", F.lit(LENGTHS[0]))))
    tested = tested.withColumn("length_class", low)
    above = {t: F.col(f"above_{i}") for i, t in enumerate(SURVIVAL)}
    sums = tested.groupBy("encoding", "length_class").agg(
        *[F.sum(F.when(F.col("p") >= t, 1).otherwise(0)).alias(f"above_{i}") for i, t in enumerate(SURVIVAL)])
    random_tail = SURVIVAL[TAIL] / SURVIVAL[HALF]
    width = random_tail - ORDINARY_TAIL
    upper = F.nullif(above[HALF], F.lit(0))  # null: nothing reaches the upper half, nothing is flagged
    share = (above[TAIL] / upper - ORDINARY_TAIL) / width
    error = lambda q: ERRORS * math.sqrt(q * (1 - q)) / width / F.sqrt(upper)
    evident = share > error(ORDINARY_TAIL)
    share = F.when(share >= 1 - error(random_tail), 1.0).otherwise(share)
    n_random = share * upper / SURVIVAL[HALF]
    cut = F.coalesce(*[F.when(above[t] - n_random * reached <= above[t] * fdr, t) for t, reached in SURVIVAL.items()])
    # one row for each encoding and length class: 36 at most
    cuts = F.broadcast(sums.select("encoding", "length_class", F.when(evident, cut).alias("cut")))
    return tested.join(cuts, ["encoding", "length_class"]).filter(F.col("p") >= F.col("cut")).select("token")


def find_secrets(docs: DataFrame, text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """All columns of ``docs`` with ``secret_spans``: array of (kind, start,
    end, hit) ordered by start, then kind; end exclusive, in code points.

    A null or empty text has no spans. Statistics run over all documents; a
    string counts once however often it occurs, and every occurrence of a
    flagged string is a span, unless a larger flagged string holds it.
    Repeated rows are rows of their own. Columns
    named like the ones used here are replaced only if they are
    ``secret_spans``, ``secret_base``, ``secret_cands`` or ``secret_row``.
    """
    names = [c for c in docs.columns if c not in ("secret_spans", "secret_base", "secret_cands", "secret_row")]
    text = text_or_empty(text_col)
    scanned = docs.select(*names, base_spans(text).alias("secret_base"), candidates(text).alias("secret_cands"))
    found = (F.size("secret_base") > 0) | (F.size("secret_cands") > 0)
    clean = scanned.filter(~found).select(*names, no_spans().alias("secret_spans"))
    held = materialize(scanned.filter(found).withColumn("secret_row", F.monotonically_increasing_id()), "secrets")
    hits = held.select("secret_row", F.explode("secret_cands").alias("span"))
    tested = materialize(battery(hits.select(F.col("span.hit").alias("token")).distinct()), "secrets-tested")
    flagged = random_strings(tested, fdr)
    more = (hits.join(flagged, F.col("span.hit") == F.col("token")).groupBy("secret_row")
            .agg(F.collect_list("span").alias("more")).withColumn("more", widest(F.col("more"))))
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    ordered = F.transform(F.array_sort(F.transform(
        F.concat("secret_base", F.coalesce("more", no_spans())),
        lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s.alias("span")))),
        lambda s: s["span"])
    dirty = held.join(more, "secret_row", "left").select(*names, ordered.alias("secret_spans"))
    return clean.unionByName(dirty)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` (from ``find_secrets``) with every span's text replaced by
    ``mark``; spans that overlap are replaced as one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col(text_col)

    def step(done, s):
        gap = F.substring(text, done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0)))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"),
                        F.when(s["start"] >= done["at"], F.concat(done["out"], gap, F.lit(mark)))
                        .otherwise(done["out"]).alias("out"))

    rest = lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    new = F.when(F.size("secret_spans") > 0, F.aggregate("secret_spans", start, step, rest)).otherwise(text)
    return docs.withColumn(text_col, new)


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secrets_query(spark, sf_dir: str) -> DataFrame:
    """Op 3 over ``documents``."""
    from threadlens.llm.common import read

    found = find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secret_spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["kind"] != "random")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(spans).alias("spans"),
                        count("random"))
