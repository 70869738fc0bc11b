import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from frames import no_documents, odd_documents
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF_SMALL
from threadlens.llm import tandem as T


def slow_runs(w, min_length=6, min_exponent=4):
    """Every stretch [s, e) that keeps a period q and cannot be extended, by
    trying all periods; the smallest period of a stretch counts."""
    n, best = len(w), {}
    for q in range(1, n // min_exponent + 1):
        s = 0
        while s + q < n:
            if w[s] != w[s + q]:
                s += 1
                continue
            e = s
            while e + q < n and w[e] == w[e + q]:
                e += 1
            length = e + q - s
            if length >= max(min_length, min_exponent * q):
                best.setdefault((s, length), q)
            s = e + 1
    return sorted((s, length, q) for (s, length), q in best.items())


def slow_collapse(w, runs):
    return [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), max_size=4),
       st.sampled_from([(6, 4), (4, 2), (2, 2), (9, 3)]))
def test_small_alphabets_against_all_periods(documents, bounds):
    got = T.runs_of_documents(documents, *bounds)
    assert got == [slow_runs(w, *bounds) for w in documents]
    assert [T.collapse(w, r) for w, r in zip(documents, got)] == [
        slow_collapse(w, r) for w, r in zip(documents, got)]


def test_planted_runs_of_runs():
    rng = random.Random(3)
    documents = []
    for _ in range(60):
        w = [rng.choice("abcdef").encode() for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(4)):
            x = [rng.choice("abcdef").encode() for _ in range(rng.randrange(1, 6))]
            x = x * rng.randrange(1, 5) + x[:rng.randrange(3)]
            w += x * rng.randrange(1, 8) + x[:rng.randrange(5)]
        documents.append(w)
    documents += documents[:10]  # copies share an array
    assert T.runs_of_documents(documents) == [slow_runs(w) for w in documents]


def test_suffix_array_and_lcp():
    rng = np.random.default_rng(5)
    s = np.append(rng.integers(0, 3, 300), -1)
    order, rank, lcp = T.suffix_array(s)
    t = [tuple(s[i:]) for i in range(len(s))]
    assert order.tolist() == sorted(range(len(s)), key=lambda i: t[i])
    assert (rank[order] == np.arange(len(s))).all()
    for j in range(1, len(s)):
        a, b = t[order[j - 1]], t[order[j]]
        n = next(k for k in range(len(s)) if a[k:k + 1] != b[k:k + 1])
        assert lcp[j] == n


def test_one_word_many_times_and_long_periods():
    long = [str(i % 997).encode() for i in range(20_000)]
    got = T.runs_of_documents([[b"x"] * 30_000, long, [b"x"] * 5, [b"x"] * 6])
    assert got == [[(0, 30_000, 1)], [(0, 20_000, 997)], [], [(0, 6, 1)]]


def test_a_small_chunk_bound_changes_nothing(monkeypatch):
    rng = random.Random(8)
    documents = [[rng.choice("ab").encode() for _ in range(rng.randrange(80))] for _ in range(30)]
    want = T.runs_of_documents(documents)
    monkeypatch.setattr(T, "CHUNK_WORDS", 50)
    monkeypatch.setattr(T, "QUESTIONS", 7)
    assert T.runs_of_documents(documents) == want


def slow_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(w)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda r: (r[0], r[2])))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha(lines),
            sha(" ".join(slow_collapse(w, runs))))


def test_query_against_all_periods(spark):
    got = T.runs_query(spark, SF_SMALL).collect()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == {r["doc_id"]: slow_row(r["doc_id"], r["text"]) for r in docs}
    assert len(got) == len(docs) and sum(r["n_runs"] for r in got) > 0
    assert {c.typeName() for c in (f.dataType for f in T.runs_query(spark, SF_SMALL).schema)} == {"long", "string"}


def test_odd_documents(spark):
    docs = odd_documents(spark, "runs string, collapsed string, n_words string")
    got = T.find_runs(docs, ["doc_id", "lang", "runs"]).collect()
    assert len(got) == 10 and got[0].asDict().keys() == {"doc_id", "lang", "n_words", "runs", "collapsed"}
    empty = [r for r in got if r["doc_id"] in (2, 3, 4)]
    assert all(r["n_words"] == 0 and r["runs"] == [] and r["collapsed"] == "" for r in empty)
    assert [r["n_words"] for r in got if r["doc_id"] == 5] == [60_000]
    planted = T.repeat_tails(docs).collect()
    assert sorted(map(str, (r["doc_id"] for r in planted))) == sorted(map(str, (r["doc_id"] for r in got)))
    assert T.find_runs(no_documents(spark), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        T.find_runs(docs, ["doc_id"], min_exponent=1)
