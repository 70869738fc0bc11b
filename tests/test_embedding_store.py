"""The embedding store: each different text once, over runs; failures with a reason."""

import os

import numpy as np
import pandas as pd

from threadlens.operators.embedding_store import embed_stored, hashed_bag, read_store
from threadlens.operators.features import embed


def counting(folder):
    """An embedder that leaves a file for each call, with the texts it got."""
    import uuid

    def run(texts: pd.Series) -> pd.Series:
        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write("\n".join(texts))
        return pd.Series([np.array([len(t), t.count("a")], np.float32) for t in texts])

    return run


def called(folder):
    return sorted(t for name in os.listdir(folder) for t in open(os.path.join(folder, name)).read().split("\n"))


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_only_new_texts_are_embedded(spark, tmp_path):
    store = f"{tmp_path}/store"
    folders = [tmp_path / n for n in ("one", "two", "other", "none")]
    for f in folders:
        f.mkdir()
    first = embed_stored(docs_of(spark, ["aa", "b", "aa", "aa"]), "text", store, "m/1", counting(str(folders[0])))
    assert called(folders[0]) == ["aa", "b"]
    assert sorted((r.doc_id, list(r.embedding)) for r in first.collect()) == [
        (0, [2, 2]), (1, [1, 0]), (2, [2, 2]), (3, [2, 2])]
    second = embed_stored(docs_of(spark, ["b", "cab", "cab", None]), "text", store, "m/1", counting(str(folders[1])))
    assert called(folders[1]) == ["", "cab"]      # null is the empty text
    assert sorted((r.doc_id, list(r.embedding)) for r in second.collect()) == [
        (0, [1, 0]), (1, [3, 1]), (2, [3, 1]), (3, [0, 0])]
    # another model knows none of them; a run without new texts calls nothing
    embed_stored(docs_of(spark, ["b"]), "text", store, "m/2", counting(str(folders[2])))
    assert called(folders[2]) == ["b"]
    embed_stored(docs_of(spark, ["b", "aa"]), "text", store, "m/1", counting(str(folders[3])))
    assert called(folders[3]) == []
    assert read_store(spark, store, "m/1").count() == 4


def test_failures_have_a_reason_and_are_tried_again(spark, tmp_path):
    store = f"{tmp_path}/store"

    def strict(texts):
        if any("bad" in t for t in texts):
            raise ValueError("refused")
        return pd.Series([None if t == "none" else [float("nan")] if t == "nan" else [1.0] for t in texts])

    docs = docs_of(spark, ["bad", "good", "nan", "none", "bad"])
    got = {r.doc_id: (r.embedding, r.embedding_error) for r in embed_stored(docs, "text", store, "m", strict).collect()}
    assert got == {0: (None, "ValueError: refused"), 1: ([1.0], None), 2: (None, "a value is not finite"),
                   3: (None, "no vector"), 4: (None, "ValueError: refused")}
    fine = embed_stored(docs, "text", store, "m", lambda texts: pd.Series([[2.0]] * len(texts)))
    assert {r.doc_id: (r.embedding, r.embedding_error) for r in fine.collect()} == {
        0: ([2.0], None), 1: ([1.0], None), 2: ([2.0], None), 3: ([2.0], None), 4: ([2.0], None)}


def test_clashing_columns_and_empty_input(spark, tmp_path):
    docs = docs_of(spark, ["a", "B b"]).selectExpr("*", "1 AS embedding", "2 AS embedding_error", "3 AS text_key", "4 AS model")
    got = embed_stored(docs, "text", f"{tmp_path}/store", "m", hashed_bag)
    assert got.columns == ["doc_id", "text", "text_key", "model", "embedding", "embedding_error"]
    want = {r.doc_id: list(r.embedding) for r in embed(docs_of(spark, ["a", "B b"]), "text").collect()}
    assert {r.doc_id: list(r.embedding) for r in got.collect()} == want
    assert embed_stored(docs.limit(0), "text", f"{tmp_path}/empty", "m", hashed_bag).count() == 0
