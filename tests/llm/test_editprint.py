import hashlib
import random

from frames import LONG, no_documents, odd_documents
from pyspark.sql import functions as F

from conftest import SF_SMALL
from threadlens.llm import editprint as E

WALKER = E.Walker()


def slow_fingerprint(text):
    """The walk step by step, with the same shared bits (a step leaves if the
    table's next arrival is one step on)."""
    if not text:
        return "0" * E.SLOTS
    written, j = [], 0
    for c in text:
        row = WALKER.after[ord(c) & 255]
        while True:
            written.append(c)
            j += 1
            if row[(j - 1) % E.PERIOD] == j % E.PERIOD:
                break
    out = []
    for ranks in WALKER.ranks.tolist():
        step = max(r for r in ranks if r < len(written))
        out.append("0123456789abcdef"[(ord(written[step]) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 60])
    return "".join(out)


def test_walk_against_single_steps():
    rng = random.Random(1)
    for n in (1, 2, 10, 300, 5000):
        text = "".join(rng.choice("abcdeé漢😀 \n") for _ in range(n))
        assert WALKER.fingerprint(text) == slow_fingerprint(text)


def test_query_rows(spark):
    got = {r["doc_id"]: r for r in E.fingerprint_query(spark, SF_SMALL).collect()}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    texts = [d["text"] or "" for d in docs]
    assert len(got) == len(docs)
    for i, d in enumerate(docs):
        text, after = texts[i], texts[(i + 1) % len(texts)]
        cut = len(text) // 4
        edited = text[:len(text) - cut] + after[:cut]
        r = got[d["doc_id"]]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == WALKER.fingerprint(text) and r["edited_fingerprint"] == WALKER.fingerprint(edited)
        assert r["near_edited"] == E.likeness(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == E.likeness(r["fingerprint"], WALKER.fingerprint(after))
    far = [i for i in got if got[i]["near_next"] < 1]
    assert sum(got[i]["near_edited"] > got[i]["near_next"] for i in far) == len(far)


def test_likeness_falls_with_edits():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(3000))
    means = []
    for edits in (0, 1, 30, 3000):
        found = []
        for _ in range(12):
            t = list(text)
            for _ in range(edits):
                t[rng.randrange(len(t))] = rng.choice("abcdefghijklmnopqrstuvwxyz ")
            found.append(E.likeness(WALKER.fingerprint(text), WALKER.fingerprint("".join(t))))
        means.append(sum(found) / len(found))
    assert means[0] == 1 and means[1] > 0.8 and means == sorted(means, reverse=True) and means[3] < 0.5


def test_an_insertion_does_not_shift_the_rest():
    """Unlike the plain text, the embedding comes back into step after an insertion."""
    rng = random.Random(3)
    found = []
    for _ in range(20):
        text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(2000))
        found.append(E.likeness(WALKER.fingerprint(text), WALKER.fingerprint(text[:200] + "q" + text[200:])))
    assert sum(found) / len(found) > 0.5


def test_near_links(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("0123456789abcdef") for _ in range(E.SLOTS)) for _ in range(20)]
    near = [b[:64] + ("0" if b[64] != "0" else "1") + b[65:] for b in base]
    prints = spark.createDataFrame([(p,) for p in base + near + base], "fingerprint string")
    links = {frozenset((r["a"], r["b"])) for r in E.near_links(prints).collect()}
    assert links == {frozenset(p) for p in zip(base, near)}


def test_odd_documents(spark):
    docs = odd_documents(spark, extra="id string, place string, fingerprint string, range string")
    got = E.edited_likeness(docs).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[2]["n_chars"] == 0 and by[2]["fingerprint"] == "0" * E.SLOTS and by[2]["near_edited"] == 1
    assert by[5]["n_chars"] == len(LONG) and by[1]["fingerprint"] == by[6]["fingerprint"]
    # the null id comes first, so the last document's next is the one without an id
    first = docs.filter("doc_id is null").first()["text"]
    last = max(r["text"] for r in docs.filter("doc_id = 7").collect())
    cut = len(last) // 4
    want = hashlib.sha256((last[:len(last) - cut] + first[:cut]).encode()).hexdigest()
    assert want in {r["edited_sha256"] for r in got if r["doc_id"] == 7}
    assert E.fingerprints(docs, docs.columns).count() == docs.count()
    assert E.edited_likeness(no_documents(spark)).count() == 0
    one = E.edited_likeness(docs.filter(F.col("doc_id") == 1)).first()
    assert one["near_next"] == 1
