import random

import pytest
import sentencepiece
from frames import no_documents, odd_documents
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb

from conftest import SF_MID, SF_SMALL
from threadlens.llm import pieces as P

LIB = sentencepiece.SentencePieceProcessor(model_file=P.PIECES_PATH)
VOCABULARY = P.Vocabulary.load()


def texts(spark, d, n=None):
    rows = spark.read.parquet(f"{d}/documents.parquet").select("text").collect()
    return [r[0] for r in rows][:n]


def test_bpe_ids_are_the_librarys(spark):
    t = P.Tokenizer(VOCABULARY)
    docs = texts(spark, SF_MID)
    assert [t.encode(x) for x in docs] == LIB.encode(docs, num_threads=1)


def test_bpe_on_random_strings():
    t, rng = P.Tokenizer(VOCABULARY), random.Random(3)
    parts = [" ", "  ", "a", "e", "th", "ing", "é", "\n", "\t", "1", "😀", "xxx", "the", "Z", "=", "\x00", "漢", "▁"]
    cases = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    cases += ["", " ", " " * 37, " " * 100 + "a", "a" * 1000, "é" * 300, "😀" * 50, "ab" * 3000]
    for x in cases:
        assert t.encode(x) == LIB.encode(x), repr(x)
        if "▁" not in x:
            assert t.decode(t.encode(x)) == x == LIB.decode(LIB.encode(x))


def test_stream_commits_within_a_window():
    """The backpointer table stays a few windows long on a text without a
    blank, and the ids are those of one search over the whole text."""
    sizes = []

    class Watched(dict):
        def __setitem__(self, k, v):
            super().__setitem__(k, v)
            sizes.append(len(self))

    t = P.Tokenizer(VOCABULARY)
    text = "▁" + "thequickbrownfoxjumpsoverthelazydog" * 60
    edge = t._bpe_edge
    t._bpe_edge = lambda s, i, low, best: (sizes.append(len(best)), edge(s, i, low, best))[1]
    ids = list(t.stream(text))
    assert ids == LIB.encode(text[1:]) and max(sizes) <= 6 * VOCABULARY.longest


def unigram(splits=True):
    """A unigram model with the file's pieces and scores that add up exactly."""
    model = pb.ModelProto()
    with open(P.PIECES_PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = P.UNIGRAM
    for i, p in enumerate(model.pieces):
        if p.type == P.NORMAL:
            p.score = -(4 + len(p.piece)) - (i * 2654435761 % 4096) / 1024
    v = P.Vocabulary([(p.piece, p.score, p.type) for p in model.pieces], P.UNIGRAM)
    if not splits:
        v.together[:] = True  # one search over the whole text
    return P.Tokenizer(v), sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


@pytest.mark.parametrize("splits", [True, False])
def test_unigram_scores_are_the_librarys(spark, splits):
    """The best sum is unique up to ties: equal scores, equal texts, nearly all ids."""
    t, lib = unigram(splits)
    docs = [x[:2000] for x in texts(spark, SF_SMALL, 40)]
    total = lambda ids: sum(t.v.scores[i] for i in ids)
    mine, theirs = [t.encode(x) for x in docs], lib.encode(docs, num_threads=1)
    assert [total(a) for a in mine] == pytest.approx([total(b) for b in theirs])
    assert sum(a == b for a, b in zip(mine, theirs)) >= 0.9 * len(docs)
    assert all(t.decode(a) == x for a, x in zip(mine, docs))


def test_query_round_trips(spark):
    got = P.pieces_query(spark, SF_SMALL)
    assert got.filter("not round_trip or n_tokens <> size(ids)").count() == 0
    assert got.count() == len(texts(spark, SF_SMALL))


def test_odd_documents(spark):
    docs = odd_documents(spark, extra="ids string, round_trip string, fp string")
    got = P.encode(docs, VOCABULARY)
    assert got.count() == docs.count() and got.columns.count("ids") == 1
    assert got.filter("doc_id in (2, 3)").agg(F.sum(F.size("ids"))).first()[0] == 0
    back = P.decode(got.drop("text"), VOCABULARY)
    key = ["doc_id", "text"]
    assert sorted(map(str, back.select(key).collect())) == sorted(
        map(str, docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()))
    assert P.encode(no_documents(spark), VOCABULARY).count() == 0
    nothing = P.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), VOCABULARY)
    assert [r["text"] for r in nothing.collect()] == ["", ""]
