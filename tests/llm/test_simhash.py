import random
import re

import numpy as np
import xxhash
from frames import no_documents, odd_documents

from conftest import SF_SMALL
from threadlens.llm import simhash as S


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, radius=4):
    """{id: smallest id reachable} by comparing all pairs."""
    out = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if bin(fps[a] ^ fps[b]).count("1") <= radius and out[b] < out[a]:
                    out[a], changed = out[b], True
    return out


def test_query_against_all_pairs(spark):
    got = S.simhash_query(spark, SF_SMALL).collect()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    fps = {r["doc_id"]: slow_fingerprint(r["text"]) for r in docs}
    want = slow_components(fps)
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(got) == len(docs)


def test_ball_links_find_all_pairs_and_no_more_than_a_forest(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for x in base:  # at every distance from 1 to 7, and chains
        for k in range(1, 8):
            y = x
            for b in rng.sample(range(64), k):
                y ^= 1 << b
            fps.add(y)
    fps = sorted(fps)
    signed = [(int(np.uint64(f).view(np.int64)),) for f in fps]
    links = S.ball_links(spark.createDataFrame(signed, "fp long")).collect()
    unsigned = lambda v: int(np.int64(v).view(np.uint64))
    label = {f: f for f in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in links:
        a, b = root(unsigned(r["u"])), root(unsigned(r["v"]))
        label[max(a, b)] = min(a, b)
    assert {f: root(f) for f in fps} == slow_components({f: f for f in fps})


def test_a_dense_group_makes_few_links(spark):
    """600 fingerprints within two bits of one: 180,000 pairs, few links."""
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    group = {centre}
    while len(group) < 600:
        a, b = rng.sample(range(64), 2)
        group.add(centre ^ (1 << a) ^ (1 << b))
    frame = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in group], "fp long")
    links = S.ball_links(frame)
    assert 599 <= links.count() <= 600 * 56


def test_longer_prefixes_and_splits_change_nothing(spark, monkeypatch):
    rng = random.Random(6)
    fps = [rng.getrandbits(12) << 50 | rng.getrandbits(8) for _ in range(300)]
    signed = [(int(np.uint64(f).view(np.int64)),) for f in sorted(set(fps))]
    frame = spark.createDataFrame(signed, "fp long")

    def components(bits):
        star = S.star_forest(S.ball_links(frame, prefix_bits=bits))
        return sorted(map(tuple, star.collect()))

    keys = np.array(sorted(set(fps)), np.uint64)
    whole = [S.forest(len(keys), np.concatenate(list(S.link_within(keys, np.zeros(len(keys), int), 64, 2, 4))))]
    monkeypatch.setattr(S, "CHUNK_VARIANTS", 5000)
    split = [S.forest(len(keys), np.concatenate(list(S.link_within(keys, np.zeros(len(keys), int), 64, 2, 4))))]
    assert sorted(map(tuple, whole[0])) == sorted(map(tuple, split[0]))
    assert components(8) == components(13)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    got = S.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["fp"], r["component_id"]))
    assert by[2][0] == by[3][0] == by[4][0] == (0, 2)  # null, empty and blank: fingerprint 0
    assert by[1][0][1] == 1 and [c for _, c in by[6]] == [1, 1]
    assert by[None][0][1] is None  # no id in its component
    assert S.near_duplicates(no_documents(spark)).count() == 0
