import re
from collections import Counter

import pytest
import sentencepiece
from frames import no_documents, odd_documents
from test_langid import slow_model
from test_secrets import slow_battery, slow_spans
from test_simhash import slow_components, slow_fingerprint

import corpus_pipeline as C
from conftest import SF_SMALL
from threadlens.llm import decontaminate as D
from threadlens.llm import langid, pieces
from threadlens.llm import secrets as S


def slow_random_strings(texts):
    """The candidates that the false-discovery control keeps."""
    tested = {}
    for t in texts:
        for m in re.finditer(S.CANDIDATE, t):
            token = m[0]
            if not (re.search("[0-9]", token) and re.search("[A-Za-z]", token)):
                continue
            if not re.fullmatch("[0-9a-f]+|[0-9A-F]+|[A-Z2-7]+=*|[0-9a-z]+|[0-9A-Z]+", token) and not (
                    re.search("[a-z]", token) and re.search("[A-Z]", token)):
                continue
            encoding, *ps = slow_battery(token)
            half = -sum(__import__("math").log(max(p, 1e-300)) for p in ps)
            p = min(1.0, __import__("math").exp(-half) * (1 + half + half * half / 2))
            n = len(token.rstrip("="))
            tested[token] = ((encoding, max(x for x in S.LENGTHS if x <= max(n, S.LENGTHS[0]))), p)
    kept = set()
    for c in {c for c, _ in tested.values()}:
        ps = [p for k, p in tested.values() if k == c]
        m0 = 2 * sum(p >= 0.5 for p in ps)
        cut = next((t for t in S.THRESHOLDS if sum(p >= t for p in ps) - m0 * (1 - t) <= S.FDR * sum(p >= t for p in ps)), None)
        if cut is not None:
            kept |= {t for t, (k, p) in tested.items() if k == c and p >= cut}
    return kept


def slow_pipeline(spark, d):
    docs = [r.asDict() for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    marks = {r["doc_id"]: r["h"] for r in spark.read.parquet(f"{d}/documents.parquet").select(
        "doc_id", langid.held_out().alias("h")).collect()}
    predict = slow_model([(x["doc_id"], x["text"], x["lang"]) for x in docs if not marks[x["doc_id"]]])
    stages = []
    docs = [x for x in docs if (lambda p: p[0] != "und" and p[1] >= C.MIN_LANG_SCORE)(predict(x["text"]))]
    stages.append(docs)
    group = slow_components({x["doc_id"]: slow_fingerprint(x["text"]) for x in docs})
    docs = [x for x in docs if group[x["doc_id"]] == x["doc_id"]]
    stages.append(docs)
    windows = set()
    for t in items:
        w = D.words_of((t or "").encode())
        windows |= {tuple(w[k:k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    lengths = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[k:k + m]) in windows for m in lengths for k in range(len(w) - m + 1))
    docs = [x for x in docs if not hit(D.words_of((x["text"] or "").encode()))]
    stages.append(docs)
    random = slow_random_strings([x["text"] or "" for x in docs])
    out = []
    for x in docs:
        text = x["text"]
        spans = [(a, b) for _, a, b in slow_spans(text)]
        spans += [(m.start(), m.end()) for m in re.finditer(S.CANDIDATE, text or "") if m[0] in random]
        for a, b in reversed(D.merge([(2 * a + 1, 2 * b) for a, b in spans])):  # touching spans stay two
            text = text[:a // 2] + "[SECRET]" + text[b // 2:]
        out.append(x | ({"text": text, "n_chars": len(text)} if spans else {}))
    stages.append(out)
    return stages


def test_against_a_brute_force_version(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.PIECES_PATH)
    want = slow_pipeline(spark, SF_SMALL)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns = docs.columns
    for (name, stage), rows in zip(C.STAGES, want):
        docs = C.materialize(stage(spark, docs, SF_SMALL), "test")
        assert docs.columns == columns, name
        assert sorted(tuple(r) for r in docs.collect()) == sorted(tuple(x[c] for c in columns) for x in rows), name
    got = C.run(spark, SF_SMALL).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {x["doc_id"]: library.encode(x["text"]) for x in want[-1]}
    assert all(r["round_trip"] for r in got) and len(got) == len(want[-1])
    assert len(want[3]) < len(want[0])


@pytest.mark.parametrize("k", range(len(C.STAGES)))
def test_odd_documents(spark, k):
    """Every stage takes nulls, empty and long texts, repeated rows and clashing columns."""
    name, stage = C.STAGES[k]
    docs = odd_documents(spark, extra="row string, __id string, secret_spans string, hit_spans string, lang_pred string, "
                                      "token string, kept string, key string, fp string")
    got = stage(spark, docs, SF_SMALL)
    rows = got.select(docs.columns).collect()
    ids = Counter(r["doc_id"] for r in rows)
    if k == 0:
        assert not {2, 3, 4} & set(ids) and ids[6] == 2
    elif k == 1:
        # 2, 3 and 4 have fingerprint 0; 1 and both rows of 6 are one text
        assert ids == Counter({1: 1, 2: 1, 5: 1, 7: 2, None: 1})
    else:
        assert sum(ids.values()) == docs.count()
    if k < len(C.STAGES) - 1:
        assert got.columns == docs.columns
    assert stage(spark, no_documents(spark), SF_SMALL).count() == 0


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "x y z w v")], "doc_id long, text string")
    got = C.drop_near_duplicates(spark, docs, SF_SMALL).collect()
    assert sorted(map(tuple, got)) == [(1, "a b c"), (1, "x y z w v")]
