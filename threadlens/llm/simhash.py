"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance 4 or less have a common point at distance 2 or
less from both. So every fingerprint emits all variants within half the
radius (1 + 64 + 2016 for radius 4), equal variants meet, and whoever shares a
variant is a pair to verify.

The variants are not shuffled one by one. A variant is a choice of flips in
its first ``prefix_bits`` bits and of flips in the rest. Before the shuffle a
fingerprint emits only its prefix variants (56 rows at 10 bits), keyed by the
flipped prefix; behind it the task that owns a prefix completes them with the
flips that are left and finds equal variants by sorting. Every variant is
still made exactly once, in the task that owns its prefix.

Fingerprints that share a variant are linked by a star to the smallest one,
each link verified by its bit distance (any two of them are within the radius
by the triangle inequality), so a group of m near copies costs at most m links
a variant, never m². Within a task the links shrink to a spanning forest.
Equal fingerprints meet once, whatever their number of documents.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import ASCII_LOWER, map_batches, materialize, text_bytes
from threadlens.operators.components import star_forest

BITS = 64
#: XXH64 seed of the shingle hashes.
SEED = 42
#: Prefix bits that key the shuffle at least; more once a task's variants would outgrow TASK_VARIANTS.
PREFIX_BITS = 10
TASK_VARIANTS = 1 << 24
#: Variants that a task holds at once; a larger prefix is worked off by longer prefixes.
CHUNK_VARIANTS = 1 << 21


def fingerprint_of(text: bytes, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles (repeats included)."""
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[:len(words) - shingle + 1], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())], dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for part in range(0, len(hashes), 1 << 16):  # a very long text in bounded pieces
        bits = np.unpackbits(hashes[part:part + (1 << 16)].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. A null or empty
    text has fingerprint 0; ids are passed through, null and repeated ones too."""

    def rows(batch: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint_of(t, shingle) for t in text_bytes(batch.column(1))], np.uint64)
        return {id_col: batch.column(0), "fp": pa.array(fps.view(np.int64))}

    kept = docs.select(F.col(id_col), F.col(text_col))
    return map_batches(kept, rows, f"{id_col} {kept.schema[id_col].dataType.simpleString()}, fp long")


def flips(bits: range, most: int) -> list[tuple[int, int]]:
    """(mask, number of flips) of every choice of at most ``most`` of ``bits``."""
    return [(sum(1 << b for b in c), n) for n in range(most + 1) for c in itertools.combinations(bits, n)]


def link_within(keys: np.ndarray, spent: np.ndarray, low: int, half: int, radius: int) -> Iterator[np.ndarray]:
    """Spanning links among fingerprints of one variant prefix.

    ``keys``: fingerprints whose bits from ``low`` up are already flipped to
    the prefix, by ``spent`` flips each. Yields arrays of (key index, key
    index) that share a variant. Prefixes with more variants than a task
    should hold are split on four more bits.
    """
    made = sum(int((spent == s).sum()) * len(flips(range(low), half - s)) for s in range(half + 1))
    if made > CHUNK_VARIANTS and low > 4:
        cut = low - 4
        index, grown, used = [], [], []
        for s in range(half + 1):
            at = np.flatnonzero(spent == s)
            for mask, n in flips(range(cut, low), half - s):
                index.append(at)
                grown.append(keys[at] ^ np.uint64(mask))
                used.append(np.full(len(at), s + n))
        index, grown, used = map(np.concatenate, (index, grown, used))
        part = (grown >> np.uint64(cut)) & np.uint64(15)
        for p in range(16):
            at = np.flatnonzero(part == p)
            if len(at) > 1:
                for links in link_within(grown[at], used[at], cut, half, radius):
                    yield index[at][links]
        return
    variants, owners = [], []
    for s in range(half + 1):
        at = np.flatnonzero(spent == s)
        masks = np.array([m for m, _ in flips(range(low), half - s)], np.uint64)
        variants.append((keys[at][:, None] ^ masks).ravel())
        owners.append(np.repeat(at, len(masks)))
    variants, owners = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(variants, kind="stable")
    variants, owners = variants[order], owners[order]
    same = variants[1:] == variants[:-1]
    if not same.any():
        return
    heads = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), np.arange(len(variants)), 0))
    at = np.flatnonzero(same) + 1
    links = np.stack([owners[heads[at]], owners[at]], 1)
    yield np.unique(links[links[:, 0] != links[:, 1]], axis=0)


def forest(n: int, links: np.ndarray) -> np.ndarray:
    """Links (smallest index of the component, index), one for each index that has links but is not the smallest."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[links[:, 0]], label[links[:, 1]])
        new = label.copy()
        np.minimum.at(new, links[:, 0], low)
        np.minimum.at(new, links[:, 1], low)
        np.minimum.at(new, label[links[:, 0]], low)
        np.minimum.at(new, label[links[:, 1]], low)
        new = new[new]
        if (new == label).all():
            at = np.flatnonzero(label != np.arange(n))
            return np.stack([label[at], at], 1)
        label = new


def ball_links(fps: DataFrame, radius: int = 4, prefix_bits: int = PREFIX_BITS) -> DataFrame:
    """(u, v): links between different fingerprints of ``fps`` (fp long,
    distinct) whose components are those of all pairs within ``radius`` bits."""
    half = (radius + 1) // 2
    masks = np.array([m << (BITS - prefix_bits) for m, _ in flips(range(prefix_bits), half)], np.uint64)
    counts = np.array([n for _, n in flips(range(prefix_bits), half)], np.int8)
    low = BITS - prefix_bits

    def emit(batch: pa.RecordBatch) -> dict:
        fp = batch.column(0).to_numpy().view(np.uint64)
        grown = (fp[:, None] ^ masks).ravel()
        return {"prefix": (grown >> np.uint64(low)).astype(np.int64), "fp": np.repeat(fp, len(masks)).view(np.int64),
                "spent": np.tile(counts, len(fp))}

    def meet(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        prefix = np.uint64(table.column("prefix")[0].as_py() << low)
        order = np.argsort(fp)  # the smallest index is then the smallest fingerprint, whatever the arrival
        fp, spent = fp[order], table.column("spent").to_numpy()[order]
        keys = (fp & np.uint64((1 << low) - 1)) | prefix
        kept = np.zeros((0, 2), np.int64)
        for links in link_within(keys, spent, low, half, radius):
            near = np.bitwise_count(fp[links[:, 0]] ^ fp[links[:, 1]]) <= radius
            kept = np.concatenate([kept, links[near]])
            if len(kept) > 4 * len(fp) + CHUNK_VARIANTS:
                kept = forest(len(fp), kept)
        if len(kept):
            kept = forest(len(fp), kept)
        return pa.table({"u": fp[kept[:, 0]].view(np.int64), "v": fp[kept[:, 1]].view(np.int64)})

    routed = map_batches(fps.select("fp"), emit, "prefix long, fp long, spent byte")
    return routed.groupBy("prefix").applyInArrow(meet, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id), one row for each row of ``docs``:
    component_id is the smallest id among the documents that can be reached by
    links of ``radius`` bits or less, the document itself included.

    Null and empty texts have fingerprint 0 and link like any other. Rows with
    a null id get the component's smallest id that is not null (null if there
    is none). Repeated ids and texts are rows of their own. Columns beside id
    and text are ignored; no rows give no rows.
    """
    marked = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash")
    nodes = materialize(marked.groupBy("fp").agg(F.min(id_col).alias("first_id")), "simhash-nodes")
    # tasks beyond their share of variants get longer prefixes; the result is the same for any length
    variants = nodes.count() * len(flips(range(BITS), (radius + 1) // 2))
    bits = min(24, max(PREFIX_BITS, (variants // TASK_VARIANTS).bit_length()))
    star = star_forest(ball_links(nodes, radius, bits))
    classes = (nodes.join(star, nodes.fp == star.u, "left")
               .select("fp", "first_id", F.coalesce("v", "fp").alias("root")))
    smallest = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = classes.join(smallest, "root").select("fp", "component_id")
    return marked.join(of_fp, "fp").select(id_col, "fp", "component_id")


def hex_fingerprint(col: str = "fp"):
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(col)), 16, "0"))


def simhash_query(spark, sf_dir: str) -> DataFrame:
    """Op 7 over ``documents``: 4-word shingles, 4 bits."""
    from threadlens.llm.common import read

    found = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", hex_fingerprint().alias("fingerprint"), "component_id")
