import random
import re
import zlib
from collections import Counter

import pytest
from frames import no_documents, odd_documents

from conftest import SF_SMALL
from threadlens.llm import variants as V


def one_edit(a, b):
    """By the definition: equal but for one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def slow_groups(counts, ratio=10):
    """All pairs of words, by length first."""
    by_length = {}
    for w in counts:
        by_length.setdefault(len(w), []).append(w)
    out = {}
    for w, n in counts.items():
        near = [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if v != w and one_edit(v, w)]
        top = min(near, key=lambda v: (-counts[v], v.encode())) if near else None
        form = top if top is not None and counts[top] >= ratio * n else None
        out[w] = [form, None, n, len(near), counts[form] if form is not None else None]
    for w in out:
        r = w
        while out[r][0] is not None:
            r = out[r][0]
        out[w][1] = r
    return {w: tuple(v) for w, v in out.items()}


def groups(spark, counts, ratio=10):
    got = V.variant_groups(spark.createDataFrame(list(counts.items()), "word string, n long"), ratio).collect()
    assert len(got) == len(counts)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got}


def test_all_pairs_of_random_words(spark):
    rng = random.Random(11)
    counts = {}
    for _ in range(120):  # families around a word, many edits, repeated letters, chains of falling counts
        w = "".join(rng.choice("aabé") for _ in range(rng.randrange(1, 9)))
        n = 10 ** rng.randrange(5)
        for _ in range(6):
            counts.setdefault(w, max(1, n))
            i, n = rng.randrange(len(w) + 1), n // rng.choice([1, 5, 10])
            w = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abé") + w[i:],
                            w[:i] + rng.choice("ab\U0001f600") + w[i + 1:]])
    counts.setdefault("", 3)
    assert groups(spark, counts) == slow_groups(counts)
    assert groups(spark, counts, 2) == slow_groups(counts, 2)


def test_ranges_give_the_same_numbers_to_the_same_prefixes(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(0, 8))) for _ in range(900)})
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = V.number_nodes(df, "path", 37).collect()
    node, back = {}, {}
    for r in got:
        assert len(r["path"]) == len(r["word"]) + 1
        for i, p in enumerate(r["path"]):
            assert node.setdefault(r["word"][:i], p) == p and back.setdefault(p, r["word"][:i]) == r["word"][:i]
    assert len(got) == len(words) and len({r["path"][-1] for r in got}) == len(words)


def slow_counts(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if h % 31 == 0:
                i = h % len(w)
                w = w[:i] + w[i + 1:]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def test_query_against_all_pairs(spark):
    got = V.variants_query(spark, SF_SMALL).collect()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = slow_groups(slow_counts([(d["doc_id"], d["text"]) for d in docs]))
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == want
    assert len(got) == len(want) and any(r["form"] for r in got)


def test_small_parts_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(40)
    want = {tuple(r) for r in V.count_words(docs).collect()}
    monkeypatch.setattr(V, "PART", 64)
    monkeypatch.setattr(V, "COUNTED", 5)
    assert {tuple(r) for r in V.count_words(docs).collect()} == want


def test_odd_documents_and_words(spark):
    got = {r["word"]: r["n"] for r in V.count_words(odd_documents(spark), edited=0, min_length=1).collect()}
    assert got["quick"] == 3 and got["word"] == 30_000 and got["être"] == 1 and got["without"] == 1
    assert V.variant_groups(V.count_words(no_documents(spark))).count() == 0
    long = "ab" * 15_000
    rows = [(None, 5, "x"), ("rooted", None, "x"), (long, 30, "x"), (long + "c", 2, None), (long[1:], 2, "x"),
            ("rooted", 4, "x"), ("rooted", 4, "y"), ("Rooted", 1, "x")]
    df = spark.createDataFrame(rows, "word string, n int, form string")
    found = {r["word"]: r for r in V.variant_groups(df, 8).collect()}
    assert set(found) == {long, long + "c", long[1:], "rooted", "Rooted"}
    assert found["rooted"]["n"] == 8 and found["Rooted"]["root"] == "rooted" and found["rooted"]["form"] is None
    assert found[long]["n_near"] == 2 and found[long + "c"]["root"] == long and found[long[1:]]["form_n"] == 30
    with pytest.raises(ValueError):
        V.variant_groups(df, 1)
