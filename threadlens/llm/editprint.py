"""Document fingerprints by a randomised edit embedding.

A random walk (Chakraborty, Goldenberg and Koucky, 2016) reads a text: at step
j it writes the character it stands on and then moves on or stays by a random
bit shared by all texts and drawn for (j, character). Texts at small edit
distance give embeddings at small Hamming distance, since the walks meet again
after an edit. The fingerprint samples the embedding: slot s keeps 4 bits of
the character written at one step, the one with the smallest random rank of
slot s among all steps of the walk. So samples lie all over the whole text, and
walks of nearly equal length sample nearly the same steps. Likeness of two
fingerprints is the share of equal slots (bands of slots find candidates, the
likeness verifies them).

The walk leaves a character after the first step whose bit is 1, so it is one
table look-up a character; only the arrival steps are kept, a few bytes for
each character of one text at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import map_batches, texts

SLOTS = 128
#: The shared bits repeat after so many steps; characters share them by their lowest 8 bits.
PERIOD = 4096
CLASSES = 256
SEED = 20240229
#: Slots of a band, and the likeness of two documents that are near.
BAND = 8
NEAR = 0.8


class Walker:
    """The shared randomness and the walk."""

    def __init__(self, seed: int = SEED, slots: int = SLOTS):
        rng = np.random.Generator(np.random.PCG64(seed))
        moves = rng.integers(0, 2, (CLASSES, PERIOD), dtype=np.int8).astype(bool)
        moves[:, -1] = True
        steps = np.arange(PERIOD)
        leave = np.where(moves, steps, PERIOD)
        leave = np.minimum.accumulate(leave[:, ::-1], axis=1)[:, ::-1]
        shared = list(range(PERIOD))
        self.after = [[shared[j] for j in row] for row in ((leave + 1) % PERIOD).tolist()]
        self.slots = slots
        self.ranks = self._records(rng, slots)

    @staticmethod
    def _records(rng: np.random.Generator, slots: int) -> np.ndarray:
        """For each slot the steps at which a new smallest rank turns up, drawn
        without drawing all ranks: after a smallest rank v the next one comes a
        geometric number of steps (rate v) later and is uniform below v."""
        rows = []
        for _ in range(slots):
            at, low, row = 0, rng.random(), [0]
            while at < 1 << 48:
                at += int(rng.geometric(max(low, 1e-18)))
                low *= rng.random()
                row.append(at)
            rows.append(row)
        width = max(map(len, rows))
        return np.array([r + [1 << 62] * (width - len(r)) for r in rows])

    def arrivals(self, points: np.ndarray, start: int = 0) -> np.ndarray:
        """Step (from ``start`` on) at which the walk has left each character."""
        if not len(points):
            return np.zeros(0, np.int64)
        after = self.after
        j = start % PERIOD
        seen = [j := after[c][j] for c in (points & (CLASSES - 1)).astype(np.uint8).tobytes()]
        seen = np.array(seen)
        return start + np.cumsum(np.diff(seen, prepend=start % PERIOD) % PERIOD)

    def sample(self, points: np.ndarray, left: np.ndarray) -> str:
        """Hex digits of the slots; all 0 for an empty text."""
        if not len(points):
            return "0" * self.slots
        at = (self.ranks < left[-1]).sum(1) - 1
        steps = self.ranks[np.arange(self.slots), at]
        written = points[np.searchsorted(left, steps, side="right")].astype(np.uint64)
        digits = (written * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(60)
        return "".join(["0123456789abcdef"[d] for d in digits.tolist()])

    def fingerprint(self, text: str) -> str:
        points = code_points(text)
        return self.sample(points, self.arrivals(points))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def likeness(a: str, b: str) -> float:
    """Share of equal slots, 0 to 1."""
    return sum(x == y for x, y in zip(a, b)) / len(a)


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", seed: int = SEED) -> DataFrame:
    """The columns ``keep`` with n_chars (code points) and fingerprint of the
    whole text (columns of these names are replaced). Null is an empty text;
    its fingerprint is all zeros. Equal texts have equal fingerprints; each row has its own. No shuffle."""
    keep = [c for c in keep if c not in ("n_chars", "fingerprint")]
    kept = docs.select(*keep, F.col(text_col).alias("print_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]
    made: list[Walker] = []

    def rows(batch: pa.RecordBatch) -> dict:
        if not made:
            made.append(Walker(seed))
        found = texts(batch.column(len(keep)))
        return {c: batch.column(i) for i, c in enumerate(keep)} | {
            "n_chars": [len(t) for t in found], "fingerprint": [made[0].fingerprint(t) for t in found]}

    return map_batches(kept, rows, ", ".join([*fields, "n_chars long", "fingerprint string"]))


def near_links(prints: DataFrame, near: float = NEAR, band: int = BAND) -> DataFrame:
    """(a, b): links between different fingerprints (column ``fingerprint``)
    of likeness ``near`` or more that agree in a band of ``band`` sampled
    slots. Equal fingerprints meet once. Within a band's bucket every pair is
    compared in blocks, but only a spanning forest of the near pairs leaves
    the task: its components are those of all near pairs of the bucket."""
    from threadlens.llm.simhash import forest

    distinct = prints.select("fingerprint").distinct()
    keys = F.transform(F.sequence(F.lit(0), F.lit(SLOTS // band - 1)), lambda i: F.concat_ws(
        ":", i, F.substring("fingerprint", i * band + 1, F.lit(band))))
    routed = distinct.select("fingerprint", F.explode(keys).alias("bucket"))

    def verify(table: pa.Table) -> pa.Table:
        names = sorted(table.column("fingerprint").to_pylist())
        marks = np.array([list(n.encode()) for n in names], np.uint8)
        kept = np.zeros((0, 2), np.int64)
        for a in range(0, len(names), 256):
            for b in range(a, len(names), 256):
                same = (marks[a:a + 256, None, :] == marks[None, b:b + 256, :]).mean(2)
                i, j = np.nonzero(same >= near)
                kept = np.concatenate([kept, np.stack([i + a, j + b], 1)])
            kept = kept[kept[:, 0] != kept[:, 1]]
            if len(kept):
                kept = forest(len(names), kept)
        names = np.array(names, object)
        return pa.table({"a": pa.array(names[kept[:, 0]], pa.string()), "b": pa.array(names[kept[:, 1]], pa.string())})

    return routed.groupBy("bucket").applyInArrow(verify, "a string, b string").distinct()


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """One row for each row of ``docs``: (id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next). The edited text
    is the text with its last n_chars // 4 code points replaced by the first
    as many (or all) of the next document; the next one of the last is the
    first.

    The order is by id (null first), then by text. A null text is an empty
    one; a single row is its own next. Texts are shuffled once: to ranges of
    ids, where they stream in order, each range followed by the first document
    of the next one.
    """
    spark = docs.sparkSession
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = kept.schema["id"].dataType.simpleString()
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = 4 * parts
    # the numbers of ranges and their first ids are all that the driver sees
    cuts = np.unique(kept.approxQuantile("id", [i / ranges for i in range(1, ranges)], 0.1 / ranges)
                     if kept.filter(F.col("id").isNotNull()).limit(1).count() else [])

    def range_of(ids: pd.Series) -> np.ndarray:
        found = np.searchsorted(cuts, ids.to_numpy(dtype=float, na_value=np.nan), side="right")
        return np.where(ids.isna(), -1, found)

    @F.pandas_udf("long")
    def range_col(ids: pd.Series) -> pd.Series:
        return pd.Series(range_of(ids))

    heads = (kept.select("id", range_col("id").alias("r")).groupBy("r").agg(F.min("id").alias("id"))
             .orderBy("r").collect())
    before = {h["r"]: heads[i - 1]["r"] for i, h in enumerate(heads)}
    first_id = {h["r"]: h["id"] for h in heads}

    @F.pandas_udf("array<long>")
    def places(ids: pd.Series) -> pd.Series:
        out = []
        for r, i in zip(range_of(ids).tolist(), ids.astype(object).where(ids.notna(), None)):
            first = first_id[r] is None or i == first_id[r]
            out.append([2 * r, 2 * before[r] + 1] if first else [2 * r])
        return pd.Series(out)

    # place: twice the range, and one more for a first document that goes to the end of the range before
    routed = (kept.withColumn("place", F.explode(places("id")))
              .withColumn("range", F.floor(F.col("place") / 2))
              .repartition(parts, "range").sortWithinPartitions("place", F.col("id").asc_nulls_first(), "text"))
    schema = (f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = Walker(seed)
        held = None  # (range, id, text, code points, arrivals, fingerprint) of the row that waits for its next
        for batch in batches:
            out: list[tuple] = []
            for i, text, place in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist()):
                if place & 1 and (held is None or held[0] != place >> 1):
                    continue  # more rows with the id of the first document
                points = code_points(text)
                left = walker.arrivals(points)
                now = (place >> 1, i, text, points, left, walker.sample(points, left))
                if held is not None:
                    out.append(_edited(walker, held, now))
                held = None if place & 1 else now
            columns = list(zip(*out)) if out else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return routed.select("id", "text", "place").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _edited(walker: Walker, own: tuple, after: tuple) -> tuple:
    _, i, text, points, left, print_own = own
    cut = len(text) // 4
    stay = len(text) - cut
    tail = after[3][:cut]
    more = walker.arrivals(tail, int(left[stay - 1]) if stay else 0)
    edited = np.concatenate([points[:stay], tail])
    print_edited = walker.sample(edited, np.concatenate([left[:stay], more]))
    sha = hashlib.sha256((text[:stay] + after[2][:cut]).encode()).hexdigest()
    return i, len(text), sha, print_own, print_edited, likeness(print_own, print_edited), likeness(print_own, after[5])


def fingerprint_query(spark, sf_dir: str) -> DataFrame:
    """Op 2 over ``documents``."""
    from threadlens.llm.common import read

    return edited_likeness(read(spark, sf_dir, "documents"))
