"""Packing pieces of documents into sequences by vector best-fit.

A sequence has three capacities: tokens, documents and attention cost (a piece
of n tokens costs n * n). Pieces come by falling length; each goes to the open
sequence that can hold it under all three and that the rule likes best: the
smallest weighted norm of what is left after it, or the largest weighted dot
product of the piece with what is left before it, all in shares of the
capacities. Where none can, a sequence is opened.

Pieces of one length are alike, and so are sequences with the same rest. So
the plan is made from the number of pieces of each length, at most one number
a token of the capacity, whatever the size of the corpus: a step puts pieces
of one length into a whole stretch of alike sequences, with the result of
placing them one by one. A step that uses a stretch up halves its rest at
least, so the plan has a number of steps bounded by the capacity too. The
pieces never leave Spark: each is numbered among those of its length (counted
along its partition, plus the counts of the partitions before it) and looks
its number up in the plan.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from threadlens.llm.common import map_batches, materialize, read, text_bytes

MAX_TOKENS = 4096
#: Weights of tokens, documents and attention cost in the rule.
WEIGHTS = (1.0, 0.01, 0.01)
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Normaliser and word pattern of the tokenizer file; the words for which it reduces to _PARTS once lower-cased.
WORD_FRONT = (
    {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)
_OTHER = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ÿ]")
_PARTS = re.compile("[a-zß-öø-ÿ]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^ \t-\ra-zß-öø-ÿ0-9]+")
#: Words whose ids a task remembers, words looked up and characters searched at once.
MEMORY, BLOCK, PART = 500_000, 50_000, 1 << 20


@dataclass(frozen=True)
class Capacity:
    """What a sequence can hold. By default the tokens alone bind: a piece has
    a token at least, and the costs of pieces within n tokens sum to n * n at most."""

    tokens: int = MAX_TOKENS
    documents: int | None = None
    cost: int | None = None

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.tokens if self.documents is None else self.documents,
                         self.tokens ** 2 if self.cost is None else self.cost], np.int64)


def needs(length: int) -> np.ndarray:
    return np.array([length, 1, length * length], np.int64)


def make_plan(counts: dict[int, int], capacity: Capacity = Capacity(), rule: str = "norm",
              weights: tuple[float, float, float] = WEIGHTS) -> np.ndarray:
    """Rows (length, first number, pieces, pieces a sequence, first sequence,
    offset): the pieces of ``length`` numbered from the first number on fill
    successive sequences from ``offset`` on. Ties go to the sequence opened
    first. Lengths that fit no empty sequence are left out."""
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule!r}")
    full, weight = capacity.vector(), np.asarray(weights, float)
    rest = np.zeros((0, 3), np.int64)      # of each stretch of alike sequences
    first, size = np.zeros(0, np.int64), np.zeros(0, np.int64)
    opened, steps = 0, []

    def add(r, at, n):
        nonlocal rest, first, size
        rest, first, size = np.vstack([rest, r[None]]), np.append(first, at), np.append(size, n)

    for length in sorted(counts, reverse=True):
        left, number, need = int(counts[length]), 0, needs(length)
        if length < 1 or (need > full).any():
            continue
        while left:
            fits = np.flatnonzero((rest >= need).all(1))
            if not len(fits):  # open as many as the pieces that are left fill, the last one perhaps in part
                each = int((full // need).min())
                for n, k in ((left // each, each), (min(1, left % each), left % each)):
                    if n:
                        steps.append((length, number, n * k, k, opened, 0))
                        add(full - k * need, opened, n)
                        opened, number = opened + n, number + n * k
                break
            if rule == "norm":
                score = (weight * ((rest[fits] - need) / full) ** 2).sum(1)
            else:
                score = -(weight * (rest[fits] / full) * (need / full)).sum(1)
            at = fits[np.lexsort((first[fits], score))[0]]
            # one after the other: the norm falls with each piece, so a sequence is filled; the product falls, so the next alike one is taken
            each = int((rest[at] // need).min()) if rule == "norm" else 1
            old, begin, n = rest[at].copy(), int(first[at]), int(size[at])
            whole = min(n, left // each)
            for m, k in ((whole, each), (int(whole < n and left % each > 0), left % each)):
                if m:
                    steps.append((length, number, m * k, k, begin, int(full[0] - old[0])))
                    add(old - k * need, begin, m)
                    begin, number, left, n = begin + m, number + m * k, left - m * k, n - m
            first[at], size[at] = begin, n
            if not n:
                rest, first, size = np.delete(rest, at, 0), np.delete(first, at), np.delete(size, at)
        alive = (rest[:, 0] > 0) & (rest[:, 1] > 0) & (rest[:, 2] > 0)
        rest, first, size = rest[alive], first[alive], size[alive]
    plan = np.array(steps, np.int64).reshape(-1, 6)
    return plan[np.lexsort((plan[:, 1], plan[:, 0]))]


def look_up(plan: np.ndarray, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(found, sequence, offset) of pieces by their length and number."""
    keys = (plan[:, 0] << 40) + plan[:, 1]
    step = np.searchsorted(keys, (length << 40) + number, side="right") - 1
    row = plan[np.maximum(step, 0)] if len(plan) else np.ones((len(length), 6), np.int64)
    among = number - row[:, 1]
    found = (step >= 0) & (row[:, 0] == length) & (among < row[:, 2])
    return found, row[:, 4] + among // row[:, 3], row[:, 5] + among % row[:, 3] * length


def pack(pieces: DataFrame, length_col: str = "length", capacity: Capacity = Capacity(), rule: str = "norm",
         weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """``pieces`` with sequence_id and offset (columns of these names are
    replaced). Offsets leave no gap within a sequence.

    A piece without a length, with one below 1, or one that fits no empty
    sequence has a null sequence_id and offset. Other columns may be null and
    rows may repeat: each row is a piece. No rows give no rows. Which of the
    pieces of one length gets which place follows from the order of the rows;
    the packing itself from their lengths alone.
    """
    kept = pieces.drop("sequence_id", "offset")
    names = kept.columns
    longest = capacity.tokens
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    slim = kept.select(row.alias("row"), F.col(f"`{length_col}`").cast("long").alias("size"))
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType([*slim.schema.fields, StructField("part", IntegerType()), StructField("place", LongType())])
    arrow = to_arrow_schema(schema)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(longest + 2, np.int64)
        for batch in batches:
            n = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            n = np.where((n < 1) | (n > longest), longest + 1, n)
            order = np.argsort(n, kind="stable")
            run = n[order]
            place = np.empty(len(n), np.int64)
            place[order] = np.arange(len(n)) - np.searchsorted(run, run)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(n), part, np.int32)),
                                              pa.array(place + seen[n])], schema=arrow)
            seen += np.bincount(n, minlength=longest + 2)

    numbered = materialize(slim.mapInArrow(number, schema), "packing-numbered")
    fitting = F.col("size").between(1, longest)
    sizes = numbered.filter(fitting).groupBy("size", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("size").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes = materialize(sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "packing-sizes")
    counts = {r["size"]: r["n"] for r in sizes.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    shared = kept.sparkSession.sparkContext.broadcast(make_plan(counts, capacity, rule, weights))

    placed = numbered.join(sizes.select("size", "part", "base"), ["size", "part"], "left").select(
        "row", "size", (F.col("base") + F.col("place")).alias("number"))
    fields = f"row {slim.schema['row'].dataType.simpleString()}, sequence_id long, offset long"

    def rows(batch: pa.RecordBatch) -> dict:
        size = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
        at = batch.column(2).fill_null(-1).to_numpy(zero_copy_only=False)
        numbered = at >= 0
        found, sequence, offset = look_up(shared.value, np.where(numbered, size, 0), np.where(numbered, at, 0))
        absent = ~(found & numbered)
        return {"row": batch.column(0), "sequence_id": pa.array(sequence, mask=absent),
                "offset": pa.array(offset, mask=absent)}

    return map_batches(placed, rows, fields).select("row.*", "sequence_id", "offset")


def _cuts(text: str) -> list[tuple[int, int]]:
    """Stretches of about PART characters that end at blanks."""
    ends = [0]
    while len(text) - ends[-1] > PART:
        at = text.find(" ", ends[-1] + PART)
        if at < 0:
            break
        ends.append(at)
    return list(zip(ends, [*ends[1:], len(text)]))


class Memory(dict):
    """Values of ``make``, at most ``MEMORY`` of them remembered."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: bytes) -> bytes:
        if len(self) >= MEMORY:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Ids:
    """Token ids of texts as 32-bit numbers, by the tokenizer's library.

    With the front of WORD_FRONT (white space dropped, no token over a word's
    end) a text's ids are those of its words one after the other, so each
    different word is encoded once and remembered. Texts and words of ASCII and
    Latin-1 letters are split by the front's own pattern first, which leaves
    fewer different parts, and these go to the model as they are. Texts that
    hold a special token, and all texts with any other tokenizer, are encoded whole.
    """

    def __init__(self, tokenizer_json: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        spec = json.loads(tokenizer_json)
        self.by_word = (spec["normalizer"], spec["pre_tokenizer"]) == WORD_FRONT
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.words, self.parts = Memory(self._word), Memory(self._part)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level: other bytes from 256 on
        others = [b for b in range(256) if b not in printable]
        self.letters = {b: 256 + i for i, b in enumerate(others)}
        self.merge = self.tokenizer.model.tokenize

    def of(self, text: bytes) -> bytes:
        if not self.by_word or any(s in text for s in self.special):
            return self._library(text)
        read = text.decode(errors="replace")
        if not _OTHER.search(read):
            return self._plain(read)
        words = read.split(" ")  # a blank ends a word; other white space stays within
        return b"".join([b"".join(map(self.words.__getitem__, words[a:a + BLOCK])) for a in range(0, len(words), BLOCK)])

    def _plain(self, text: str) -> bytes:
        part = self.parts.__getitem__
        return b"".join([b"".join(map(part, _PARTS.findall(text[a:b].lower()))) for a, b in _cuts(text)])

    def _word(self, word: str) -> bytes:
        return self._library(word.encode()) if _OTHER.search(word) else self._plain(word)

    def _part(self, part: str) -> bytes:
        letters = part.isascii() and part.isalpha()
        spelled = part if letters else part.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.merge(spelled)]).tobytes()

    def _library(self, text: bytes) -> bytes:
        return array("I", self.tokenizer.encode(text.decode(errors="replace"), add_special_tokens=False).ids).tobytes()


def cut_documents(docs: DataFrame, tokenizer_path: str, keep: list[str], text_col: str = "text",
                  max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Pieces of whole documents: the columns ``keep`` of ``docs`` with piece
    (from 0), start, length and ids_crc32 (of the ids as little-endian 32-bit
    numbers). A document is its ids and ``end_id``; one of more than
    ``max_tokens`` ids is cut into pieces of as many, the last one perhaps
    shorter. A null or empty text is ``end_id`` alone. The tokenizer file is
    read by the driver and handed to the tasks. Rows repeat and ids may be
    null; no rows give no rows."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast({"json": f.read()})
    keep = [c for c in keep if c not in ("piece", "start", "length", "ids_crc32")]
    kept = docs.select(*keep, F.col(text_col).alias("packing_text"))
    end = np.array([end_id], "<u4").tobytes()
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]

    def rows(batch: pa.RecordBatch) -> dict:
        held = shared.value  # a worker's own copy: what its Ids remember serves its next tasks
        if "ids" not in held:
            held["ids"] = Ids(held["json"])
        owner, piece, start, length, crc = [], [], [], [], []
        for i, text in enumerate(text_bytes(batch.column(len(keep)))):
            ids = held["ids"].of(text) + end
            for k, a in enumerate(range(0, len(ids) // 4, max_tokens)):
                part = ids[4 * a:4 * (a + max_tokens)]
                owner.append(i)
                piece.append(k)
                start.append(a)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        of = pa.array(owner, pa.int64())
        return {c: batch.column(i).take(of) for i, c in enumerate(keep)} | {
            "piece": piece, "start": start, "length": length, "ids_crc32": crc}

    return map_batches(kept, rows, ", ".join([*fields, "piece int, start long, length long, ids_crc32 long"]))


def packing_query(spark, sf_dir: str) -> DataFrame:
    """Op 11 over ``documents``: 4,096 tokens a sequence; the number of
    documents and the attention cost are held to what those tokens allow."""
    import public_tokenizers

    pieces = cut_documents(read(spark, sf_dir, "documents").select("doc_id", "text"),
                           public_tokenizers.path(TOKENIZER), ["doc_id"])
    return pack(pieces)
