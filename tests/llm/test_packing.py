import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from frames import LONG, no_documents, odd_documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from conftest import SF_MID, SF_SMALL
from threadlens.llm import packing as P

PATH = public_tokenizers.path(P.TOKENIZER)


def one_by_one(lengths, capacity, rule, weights):
    """{(length, number): (sequence, offset)}: each piece looks at every open sequence."""
    full, w = capacity.vector(), np.array(weights)
    rest, out, seen = [], {}, Counter()
    for n in sorted(lengths, reverse=True):
        need = P.needs(n)
        if n < 1 or (need > full).any():
            continue
        best = None
        for b, r in enumerate(rest):
            if (r >= need).all():
                score = ((w * ((r - need) / full) ** 2).sum() if rule == "norm"
                         else -(w * (r / full) * (need / full)).sum())
                if best is None or score < best[0]:
                    best = (score, b)
        if best is None:
            rest.append(full.copy())
            best = (0, len(rest) - 1)
        b = best[1]
        out[n, seen[n]] = (b, int(full[0] - rest[b][0]))
        rest[b] = rest[b] - need
        seen[n] += 1
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 45), max_size=120), st.sampled_from(["norm", "dot"]),
       st.sampled_from([P.Capacity(40), P.Capacity(40, 3), P.Capacity(40, 5, 700), P.Capacity(40, 2, 1600)]),
       st.sampled_from([(1.0, 0.01, 0.01), (1.0, 1.0, 1.0), (1.0, 5.0, 2.0)]))
def test_plan_is_best_fit_piece_by_piece(lengths, rule, capacity, weights):
    want = one_by_one(lengths, capacity, rule, weights)
    plan = P.make_plan(Counter(lengths), capacity, rule, weights)
    seen, got = Counter(), {}
    for n in lengths:
        found, seq, at = P.look_up(plan, np.array([n]), np.array([seen[n]]))
        if found[0]:
            got[n, seen[n]] = (int(seq[0]), int(at[0]))
        seen[n] += 1
    assert got == want


def test_plan_does_not_grow_with_the_number_of_pieces():
    rng = random.Random(2)
    counts = Counter(min(4096, int(rng.lognormvariate(6, 1)) + 1) for _ in range(20_000))
    small, large = P.make_plan(counts), P.make_plan({n: c * 1_000_003 for n, c in counts.items()})
    assert len(large) < 5 * 4096 and len(small) < 5 * 4096
    bins = (large[:, 4] + (large[:, 2] - 1) // large[:, 3]).max() + 1
    tokens = sum(n * c for n, c in counts.items()) * 1_000_003
    assert bins <= 1.001 * tokens / 4096


def check_packing(rows, max_tokens=4096):
    """No gap, no overlap, within the capacity."""
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= max_tokens
    return len(held)


def whole_text_pieces(text, tokenizer):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
    parts = [ids[a:a + 4096] for a in range(0, len(ids), 4096)]
    return [(k, 4096 * k, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, p in enumerate(parts)]


def test_query_against_whole_texts(spark):
    got = P.packing_query(spark, SF_SMALL).collect()
    tokenizer = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = {(d["doc_id"], *p) for d in docs for p in whole_text_pieces(d["text"], tokenizer)}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    assert len(got) == len(want)
    lengths = [r["length"] for r in got]
    used = check_packing(got)
    assert used == 1 + max(s for s, _ in one_by_one(lengths, P.Capacity(), "norm", P.WEIGHTS).values())


def test_few_sequences(spark):
    got = P.packing_query(spark, SF_MID).collect()
    lower = -(-sum(r["length"] for r in got) // 4096)
    assert check_packing(got) <= lower + 1


def test_word_by_word_ids_are_the_texts_ids():
    tokenizer, ids = Tokenizer.from_file(PATH), P.Ids(open(PATH, encoding="utf-8").read())
    rng = random.Random(6)
    odd = ["İstanbul ΟΔΟΣ ΣΑΣΣ", "é ́x a b c　d\x85e\x1cf", "<|endoftext|>x <|startoftext|>",
           "I'Ll it's 'S we've123 ½Ⅷ", "漢字かな😀👍🏽 ​‍ ﻿", "한 각", "a\r\n\t\x0b\x0cb", ""]
    odd += ["don't I'LL x's_it've 3rd 42nd (a)[b]{c};'sa''t", "\x1c\x00\x7f a\x1fb", "<|endoftext|", "tail<|ENDOFTEXT|>"]
    marks = "aé́ ̧\t'sS Σς1½<|>\nİ"
    odd += ["".join(rng.choice(marks) for _ in range(40)) for _ in range(300)]
    for t in odd:
        want = tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids.of(t.encode()), "<u4").tolist() == want, t


def test_other_tokenizers_take_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = P.Ids(open(path, encoding="utf-8").read())
    text = " two  blanks and\nlines  "
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert not ids.by_word and np.frombuffer(ids.of(text.encode()), "<u4").tolist() == want
    assert P.Ids(open(PATH, encoding="utf-8").read()).by_word


def test_small_memory_changes_nothing(monkeypatch):
    text = open(PATH, encoding="utf-8").read()
    want = P.Ids(text).of(LONG[:50_000].encode())
    monkeypatch.setattr(P, "MEMORY", 20)
    monkeypatch.setattr(P, "BLOCK", 10)
    monkeypatch.setattr(P, "PART", 10)
    assert P.Ids(text).of(LONG[:50_000].encode()) == want


def test_capacities_and_odd_lengths(spark):
    rows = [(i, n) for i, n in enumerate([30, 30, 20, 10, 10, 5, 5, 5, 5, 40, 41, 0, -3, None, 5, 5])]
    df = spark.createDataFrame([(i, n, "x", None) for i, n in rows], "id long, length int, offset string, part long")
    for capacity in (P.Capacity(40, 3), P.Capacity(40, 3, 1000)):
        got = P.pack(df.repartition(3), capacity=capacity).collect()
        assert {r["id"] for r in got} == {i for i, _ in rows} and len(got) == len(rows)
        none = [r["length"] for r in got if r["sequence_id"] is None]
        assert set(none) == ({41, 0, -3, None} if capacity.cost is None else {41, 40, 0, -3, None})
        placed = [r for r in got if r["sequence_id"] is not None]
        check_packing(placed, 40)
        docs, cost = Counter(r["sequence_id"] for r in placed), Counter()
        for r in placed:
            cost[r["sequence_id"]] += r["length"] ** 2
        assert max(docs.values()) <= 3 and max(cost.values()) <= capacity.vector()[2]
    with pytest.raises(ValueError):
        P.make_plan({1: 1}, rule="first")


def test_odd_documents(spark):
    docs = odd_documents(spark, "piece string, start string, length string")
    pieces = P.cut_documents(docs, PATH, ["doc_id", "lang", "piece"])
    got = P.pack(pieces).collect()
    used = check_packing(got)
    assert sum(1 for r in got if r["doc_id"] in (2, 3, 4) and r["length"] == 1) == 3
    assert sum(r["length"] for r in got if r["doc_id"] == 5) > 4096 and used > 1
    assert sum(1 for r in got if r["doc_id"] is None) == 1 and sum(1 for r in got if r["doc_id"] == 6) == 2
    assert P.pack(P.cut_documents(no_documents(spark), PATH, ["doc_id"])).count() == 0
