import random

import pytest
from frames import LONG, no_documents, odd_documents

from conftest import SF_MID
from threadlens.llm import automata as A
from threadlens.testing import compare, duckdb_views


def slow_kept(docs, window):
    """docs: (id, text) in order; kept words by a table of all earlier windows."""
    seen, out = set(), []
    for _, text in docs:
        w = (text or "").encode().split()
        gone = set()
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            if key in seen:
                gone |= set(range(k, k + window))
            seen.add(key)
        out.append(b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    return out


def test_matching_statistics():
    rng = random.Random(2)
    for _ in range(100):
        text = [rng.choice("abc").encode() for _ in range(40)]
        more = [rng.choice("abc").encode() for _ in range(15)]
        query = [rng.choice("abcd").encode() for _ in range(50)]
        sam = A.SuffixAutomaton()
        sam.add(text)
        sam.add(more)
        runs = {tuple(t[i:j]) for t in (text, more) for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        want = [max([0] + [n for n in range(1, e + 2) if tuple(query[e + 1 - n:e + 1]) in runs]) for e in range(50)]
        assert sam.matching_statistics(query) == want
        assert len(sam.next) <= 2 * (len(text) + len(more)) + 2


def test_pieces_cover_each_window_once():
    words = LONG.encode().split()[:5000] + [b"x"] * 100
    first, count, hashes = A.minimizers(words)
    assert first[0] == 0 and list(first[1:]) == list((first + count)[:-1]) and (first + count)[-1] == len(words) - 19
    assert count.max() <= A.WINDOW - A.GRAM + 1 and len(hashes) == len(first)


def test_query_matches_sql(spark):
    res = compare(A.repeats_query(spark, SF_MID), duckdb_views(SF_MID), A.ORACLE_SQL)
    assert res["values_match"], res


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_random_documents(spark, hot):
    """Few different words, so windows repeat in all ways: across and within
    documents, periodic, shifted; hot minimizers of any size give the same."""
    rng = random.Random(hot)
    rows = []
    for i in range(60):
        kind = rng.random()
        if kind < 0.3 and rows:
            base = rng.choice(rows)[1].split()
            a = rng.randrange(len(base) + 1)
            text = " ".join(base[a:] + [rng.choice("xy") for _ in range(3)] + base[:a])
        elif kind < 0.5:
            text = " ".join("ab" * rng.randint(1, 30))
        else:
            text = " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 80)))
        rows.append((i * 7, text))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in A.remove_repeats(frame, window=8, gram=4, hot_pieces=hot).collect()}
    want = slow_kept(rows, 8)
    assert [got[i]["kept"] for i, _ in rows] == want
    assert sum(r["n_removed"] for r in got.values()) > 0
    for i, text in rows:
        w, r = text.split(), got[i]
        gone = {k for s in r["spans"] for k in range(s["start"], s["end"])}
        assert r["n_words"] == len(w) and r["n_removed"] == len(gone)
        assert " ".join(x for k, x in enumerate(w) if k not in gone) == r["kept"]


def test_odd_documents(spark):
    docs = odd_documents(spark, extra="hash string, doc string, mini string, marks string")
    copy = docs.filter("doc_id = 5").selectExpr("9L doc_id", "text", "lang", "source", "n_chars", "hash", "doc", "mini", "marks")
    got = A.remove_repeats(docs.unionByName(copy)).collect()
    assert len(got) == docs.count() + 1
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["n_words"] == 0 and by[i]["kept"] == "" for i in (2, 3, 4))
    assert by[9]["n_removed"] == by[9]["n_words"] == len(LONG.split()) and by[9]["kept"] == ""
    assert by[5]["n_removed"] < by[5]["n_words"]  # the first one keeps what is new
    assert by[6]["kept"] == "the quick brown fox jumps over the lazy dog"  # shorter than a window
    assert A.remove_repeats(no_documents(spark)).count() == 0
