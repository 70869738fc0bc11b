"""Representative documents and mergeable distinct counts against plain Python."""

import math
from collections import Counter

from threadlens.operators.quality import SKETCH_ERROR, distinct_sketches, merged_distinct
from threadlens.operators.terms import representative_docs


def plain(rows, top_n):
    import hashlib
    import re

    words = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if len(w) >= 2]
    rows = [(c, t) for c, t in rows if t is not None]
    tf = {c: Counter(w for x, t in rows if x == c for w in words(t)) for c in {c for c, _ in rows}}
    sizes = {c: sum(n.values()) for c, n in tf.items() if n}
    mean = math.floor(sum(sizes.values()) / len(sizes))
    total = sum(tf.values(), Counter())
    idf = {w: math.log(1 + mean / n) for w, n in total.items()}
    out = []
    for c in tf:
        if c == -1:
            continue
        topic = {w: n / sizes[c] * idf[w] for w, n in tf[c].items()}
        scored = []
        for t in {t for x, t in rows if x == c}:
            own = {w: n * idf[w] for w, n in Counter(words(t)).items()}
            norms = math.sqrt(sum(v * v for v in own.values())) * math.sqrt(sum(v * v for v in topic.values()))
            scored.append((-round(sum(v * topic[w] for w, v in own.items()) / norms, 6) if norms else 0.0,
                           hashlib.sha256(t.encode()).hexdigest(), t))
        out += [(c, i + 1, t, -s) for i, (s, _, t) in enumerate(sorted(scored)[:top_n])]
    return sorted(out)


def test_representatives(spark):
    rows = [(0, "red green blue"), (0, "red red green"), (0, "green"), (0, "red green blue"), (0, "1 2 !"), (0, None),
            (1, "blue sky over the sea"), (1, "sea sea sea " * 200), (-1, "noise red"), (2, "?"), (3, "lone words here"),
            (4, "tie one"), (4, "one tie"), (4, "tie  one")]
    docs = spark.createDataFrame(rows, "Topic int, Document_description string")
    for n in (1, 3):
        got = sorted(tuple(r) for r in representative_docs(docs, n).collect())
        assert got == plain(rows, n)
    kept = representative_docs(docs, 1, keep_outliers=True).collect()
    assert {r.Topic for r in kept} == {-1, 0, 1, 2, 3, 4}
    assert representative_docs(docs.limit(0)).count() == 0


def test_sketches_merge(spark):
    rows = spark.range(60_000).selectExpr("id % 6 AS day", "CAST(id % 25000 AS STRING) AS a",
                                          "CASE WHEN id % 2 = 0 THEN id % 7 END AS b", "CAST(NULL AS STRING) AS c")
    days = distinct_sketches(rows, ["day"], ["a"])
    again = distinct_sketches(rows.filter("day = 3"), ["day"], ["a"])   # a day that was stored twice
    est = merged_distinct(days.unionByName(again), []).first()
    assert est["column_name"] == "a" and abs(est["n_distinct"] - 25_000) <= 3 * SKETCH_ERROR * 25_000
    small = merged_distinct(distinct_sketches(rows, ["day"], ["b"]), []).first()
    assert small["n_distinct"] == 7
    none = merged_distinct(distinct_sketches(rows, ["day"], ["c"]), ["day"]).collect()
    assert [r["n_distinct"] for r in none] == [0] * 6
