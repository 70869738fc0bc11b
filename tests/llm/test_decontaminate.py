import random
import re

from frames import LONG, no_documents, odd_documents
from pyspark.sql import functions as F

from conftest import SF_MID
from threadlens.llm import decontaminate as D
from threadlens.testing import compare, duckdb_views

ITEM = "item_id string, text string"


def slow_find(words, items):
    spans, found = [], set()
    for item, text in items:
        w = D.words_of((text or "").encode())
        for k in range(max(1, len(w) - 9) if w else 0):
            p = w[k:k + 10]
            for i in range(len(words) - len(p) + 1):
                if words[i:i + len(p)] == p:
                    spans.append((i, i + len(p)))
                    found.add(item)
    return D.merge(spans), found


def test_words():
    want = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "ab-c_1 É\x7fé\nz")
    assert [w.decode() for w in D.words_of("Ab-C_1 É\x7fé\nZ".encode())] == want


def test_search_against_brute_force():
    rng = random.Random(1)
    vocabulary = list("abcd")
    for _ in range(200):
        words = [rng.choice(vocabulary).encode() for _ in range(rng.randint(0, 60))]
        items = [(str(i), " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 9, 10, 11, 14]))))
                 for i in range(rng.randint(0, 6))]
        if len(words) > 20:
            items.append(("cut", b" ".join(words[4:19]).decode()))
        spans, found = D.Matcher([(i, t.encode()) for i, t in items]).find(words)
        assert (spans, found) == slow_find(words, items)


def test_query_matches_sql(spark):
    res = compare(D.decontaminate_query(spark, SF_MID), duckdb_views(SF_MID), D.ORACLE_SQL)
    assert res["values_match"], res
    assert D.decontaminate_query(spark, SF_MID).filter("contaminated").count() > 0


def test_shards_give_the_same_result(spark, monkeypatch):
    docs = odd_documents(spark)
    items = spark.createDataFrame([("1", "quick brown fox"), ("2", "Lazy DOG"), ("3", "brown fox jumps over"),
                                   ("4", LONG[:200]), ("5", "")], ITEM)
    want = sorted(map(str, D.contamination(docs, items, ["doc_id"]).collect()))
    monkeypatch.setattr(D, "SHARD_ITEMS", 1)
    assert sorted(map(str, D.contamination(docs, items, ["doc_id"]).collect())) == want


def test_odd_documents_and_items(spark):
    docs = odd_documents(spark)
    items = spark.createDataFrame([("b", "quick BROWN fox"), ("a", "quick brown fox"), (None, "lazy dog"), ("n", None),
                                   ("e", " .. "), ("a", "quick brown fox")], ITEM)
    got = D.contamination(docs, items, docs.columns)
    assert got.count() == docs.count()
    row = got.filter("doc_id = 1").first()
    assert [tuple(s) for s in row["hit_spans"]] == [(1, 4), (7, 9)] and row["hit_items"] == ["", "a", "b"]
    assert got.filter(F.col("doc_id") == 6).count() == 2  # repeated rows stay
    assert all(r["n_words"] == 0 for r in got.filter("doc_id in (2, 3, 4)").collect())
    assert got.filter(F.size("hit_spans") > 0).count() == 3
    assert D.contamination(docs, items.limit(0), ["doc_id"]).filter(F.size("hit_spans") > 0).count() == 0
    assert D.contamination(no_documents(spark), items, ["doc_id"]).count() == 0
