"""Substring dedup with suffix automata of reference shards.

Every word that is covered by a window of ``window`` words whose sequence also
starts earlier (smaller id, or earlier in the same document) is removed.
Matching statistics against a suffix automaton of the earlier text give, for
each position, the length of the longest match that ends there; where it
reaches the window, the maximal span of that match goes.

An automaton of the whole corpus would not fit anywhere, and streaming all
documents past each of its shards would cost shards x corpus. So reference and
documents are sharded by content. Each window belongs to its minimizer, the
``GRAM`` words in it with the smallest hash. Equal windows have equal
minimizers, so they are in one shard; a stretch of text whose windows share
one minimizer occurrence is a *piece*. Then, per shard (one minimizer value):

1. only minimizers that occur more than once have pieces at all;
2. equal pieces meet in an aggregate of their hashes: all but the first are
   repeats as a whole, whatever their number;
3. the first ones of a shard with several different pieces, and only they,
   come with their words, and go past the shard's automaton in order: what
   matches is a repeat, the rest is added to the automaton.

A minimizer with more than ``HOT_PIECES`` different pieces (a common phrase in
ever new contexts) would make one shard grow with the corpus. There each
window is a shard by itself, and equal windows meet before the shuffle.
Shards are therefore bounded, none is dropped, and the result does not depend
on the split. Whole texts are shuffled once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import map_batches, text_bytes

WINDOW = 20
#: Words of a minimizer.
GRAM = 8
HOT_PIECES = 1000
_MUL = 0x9E3779B97F4A7C15


class SuffixAutomaton:
    """Generalised suffix automaton over words: knows every run of
    consecutive words of the texts added so far."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, words: list[bytes]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(w)
        if known is not None:
            if length[known] == length[last] + 1:
                return known
            return self._clone(last, w, known)
        new = self._state({}, length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = nxt[p][w]
            link[new] = q if length[p] + 1 == length[q] else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: bytes, q: int) -> int:
        copy = self._state(dict(self.next[q]), self.length[p] + 1)
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _state(self, edges: dict[bytes, int], length: int) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def matching_statistics(self, words: Iterable[bytes]) -> list[int]:
        """For each word the length of the longest run ending in it that occurs in the automaton."""
        state, matched, out = 0, 0, []
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            to = self.next[state].get(w)
            if to is not None:
                state, matched = to, matched + 1
            else:
                matched = 0
            out.append(matched)
        return out


def minimizers(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, hash) of each piece: the longest
    stretches of windows that share one minimizer occurrence (the leftmost
    smallest hash in the window)."""
    n = len(words) - window + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram = min(gram, window)
    digest = xxhash.xxh64_intdigest
    codes = np.array([digest(w) for w in words], np.uint64)
    hashes = np.zeros(len(words) - gram + 1, np.uint64)
    for k in range(gram):
        hashes = hashes * np.uint64(_MUL) + codes[k:len(codes) - gram + 1 + k]
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(32)
    width = window - gram + 1
    chosen = np.empty(n, np.int64)
    for a in range(0, n, 1 << 16):  # a very long text in bounded pieces
        b = min(n, a + (1 << 16))
        views = np.lib.stride_tricks.sliding_window_view(hashes[a:b + width - 1], width)
        chosen[a:b] = np.arange(a, b) + views.argmin(1)
    first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
    return first, np.diff(np.concatenate((first, [n]))), hashes[chosen[first]]


#: A document: whether it has an id, the id (0 for none) and a hash of its text.
_DOC = ["known", "doc", "hash"]


def _doc_fields(frame: DataFrame) -> str:
    return f"known boolean, doc {frame.schema['doc'].dataType.simpleString()}, hash long"


def _doc_columns(batch: pa.RecordBatch, of: pa.Array) -> dict:
    """The first three columns of ``batch``, at the rows ``of``."""
    return {c: batch.column(i).take(of) for i, c in enumerate(_DOC)}


def _pieces(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(mini, document): one row for each piece of each document."""

    def marks(batch: pa.RecordBatch) -> dict:
        found = [minimizers(t.split(), window, gram)[2] for t in text_bytes(batch.column(3))]
        of = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
        return {"mini": np.concatenate(found).view(np.int64)} | _doc_columns(batch, of)

    return map_batches(docs.select(*_DOC, "text"), marks, f"mini long, {_doc_fields(docs)}")


def _repeated_pieces(affected: DataFrame, window: int, gram: int) -> DataFrame:
    """(shard, code, document, first, n): the pieces whose minimizer repeats;
    ``code`` is a hash of the piece's words."""

    def cut(batch: pa.RecordBatch) -> dict:
        out: dict = {"shard": [], "code": [], "first": [], "n": []}
        of = []
        for i, (text, minis) in enumerate(zip(text_bytes(batch.column(3)), batch.column(4))):
            words = text.split()
            first, count, hashes = minimizers(words, window, gram)
            at = np.flatnonzero(np.isin(hashes.view(np.int64), minis.values.to_numpy()))
            first, count = first[at], count[at]
            code = [xxhash.xxh64_intdigest(b" ".join(words[a:a + n + window - 1]))
                    for a, n in zip(first.tolist(), count.tolist())]
            out["shard"].append(hashes[at].view(np.int64))
            out["code"].append(np.array(code, np.uint64).view(np.int64))
            out["first"].append(first)
            out["n"].append(count)
            of.append(np.full(len(at), i))
        return {c: np.concatenate(v) for c, v in out.items()} | _doc_columns(batch, pa.array(np.concatenate(of)))

    return map_batches(affected.select(*_DOC, "text", "minis"), cut,
                       f"shard long, code long, {_doc_fields(affected)}, first int, n int")


def _words_of_pieces(wanted: DataFrame, window: int) -> DataFrame:
    """(shard, piece, document, first, n) with the words of the pieces that
    ``wanted`` lists for each text. Of a hot shard each window comes as a
    shard of its own, of equal windows in a batch the first one."""

    def cut(batch: pa.RecordBatch) -> dict:
        out: dict = {"shard": [], "piece": [], "first": [], "n": []}
        of: list[int] = []
        windows: dict[bytes, tuple] = {}
        places = list(zip(*[batch.column(i).to_pylist() for i in range(3)]))

        def put(shard: int, piece: bytes, first: int, n: int, i: int) -> None:
            for column, value in zip(out.values(), (shard, piece, first, n)):
                column.append(value)
            of.append(i)

        for i, (text, pieces) in enumerate(zip(text_bytes(batch.column(3)), batch.column(4).to_pylist())):
            words = text.split()
            for p in pieces:
                a, n = p["first"], p["n"]
                if not p["hot"]:
                    put(p["shard"], b" ".join(words[a:a + n + window - 1]), a, n, i)
                    continue
                for k in range(a, a + n):
                    piece = b" ".join(words[k:k + window])
                    windows[piece] = min(windows.get(piece, (*places[i], k, i)), (*places[i], k, i))
        for piece, (*_, k, i) in windows.items():
            put(int(np.uint64(xxhash.xxh64_intdigest(piece)).view(np.int64)), piece, k, 1, i)
        return out | _doc_columns(batch, pa.array(of, pa.int64()))

    return map_batches(wanted.select(*_DOC, "text", "pieces"), cut,
                       f"shard long, piece binary, {_doc_fields(wanted)}, first int, n int")


def _repeats_in_shards(firsts: DataFrame, window: int) -> DataFrame:
    """(document, first, n, mask): for each different piece of a shard the
    windows (bits) that an earlier one has. The pieces come in order of shard
    and first occurrence; a task holds one shard's automaton at a time."""
    schema = f"{_doc_fields(firsts)}, first int, n int, mask long"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        shard, held, automaton = None, None, None
        for batch in batches:
            masks = []
            for key, piece in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist()):
                words = piece.split()
                if key != shard:  # the automaton is made when a second piece comes
                    shard, held, automaton = key, words, None
                    masks.append(0)
                    continue
                if automaton is None:
                    automaton = SuffixAutomaton()
                    automaton.add(held)
                longest = automaton.matching_statistics(words)
                masks.append(sum(1 << k for k, m in enumerate(longest[window - 1:]) if m >= window))
                automaton.add(words)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(masks, pa.int64())], schema=arrow)

    ordered = (firsts.select(*_DOC, "first", "n", "shard", "piece").repartition("shard")
               .sortWithinPartitions("shard", *_DOC, "first"))
    return ordered.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   gram: int = GRAM, hot_pieces: int = HOT_PIECES, digest: bool = False) -> DataFrame:
    """One row for each row of ``docs``: (id, n_words, n_removed, spans, kept)
    with the merged word spans (start, end) that are removed and the kept
    words, joined by one blank (``digest``: the SHA-256 of that text, so that
    no text goes through the last join).

    Words are the runs of anything but blank and control characters 9 to 13.
    Null, empty and blank texts have no words. Null ids come before all
    others. Rows with one id are documents of their own, in order of a hash of
    their text; rows with one id and one text are the same document and get
    the same result. Other columns are ignored; no rows give no rows.
    """
    if window - min(gram, window) >= 63:
        raise ValueError("a piece may have 63 windows at most: take longer minimizers")
    id_type = docs.schema[id_col].dataType
    all_docs = docs.select(F.col(id_col).isNotNull().alias("known"),
                           F.coalesce(F.col(id_col), F.lit(0).cast(id_type)).alias("doc"),
                           F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    pieces = _pieces(all_docs, window, gram)
    repeated = pieces.groupBy("mini").agg(F.count("*").alias("n")).filter("n > 1").select("mini")
    by_doc = pieces.join(repeated, "mini").groupBy(*_DOC).agg(F.collect_set("mini").alias("minis"))
    # sort-merge joins on the document only, so that the shuffled texts are used again by each
    affected = all_docs.join(by_doc.hint("merge"), _DOC)
    firsts = (_repeated_pieces(affected, window, gram).groupBy("shard", "code")
              .agg(F.min(F.struct(*_DOC, "first", "n")).alias("at")).select("shard", "at.*"))
    # counting a column of the first place keeps this the same aggregate as ``firsts``
    sized = firsts.join(firsts.groupBy("shard").agg(F.count("first").alias("m")), "shard")
    alone = sized.filter("m = 1").select(*_DOC, "first", "n", F.lit(0).cast("long").alias("mask"))
    several = sized.filter("m > 1").groupBy(*_DOC).agg(F.collect_list(F.struct(
        "shard", "first", "n", (F.col("m") > hot_pieces).alias("hot"))).alias("pieces"))
    spelled = _words_of_pieces(affected.join(several.hint("merge"), _DOC), window)
    masks = alone.unionByName(_repeats_in_shards(spelled, window)).groupBy(*_DOC).agg(
        F.collect_list(F.struct("first", "n", "mask")).alias("masks"))
    done = _kept(affected.join(masks.hint("merge"), _DOC, "left"), window, gram, digest)
    done = done.groupBy(*_DOC).agg(*[F.first(c).alias(c) for c in ("n_removed", "spans", "kept")])
    nothing = F.lit(None).cast("array<long>").alias("minis"), F.lit(None).cast(masks.schema["masks"].dataType).alias("masks")
    whole = _kept(all_docs.select("*", *nothing), window, gram, digest).withColumnsRenamed(
        {"spans": "w_spans", "kept": "w_kept", "n_removed": "w_removed"})
    return whole.join(done, _DOC, "left").select(
        F.when(F.col("known"), F.col("doc")).alias(id_col), "n_words",
        F.coalesce("n_removed", "w_removed").alias("n_removed"),
        F.coalesce("spans", "w_spans").alias("spans"), F.coalesce("kept", "w_kept").alias("kept"))


def _kept(marked: DataFrame, window: int, gram: int, digest: bool) -> DataFrame:
    """(document, n_words, n_removed, spans, kept) from (document, text, minis, masks)."""

    def rows(batch: pa.RecordBatch) -> dict:
        out: dict = {c: batch.column(i) for i, c in enumerate(_DOC)}
        out |= {"n_words": [], "n_removed": [], "spans": [], "kept": []}
        for text, minis, masks in zip(text_bytes(batch.column(3)), batch.column(4), batch.column(5).to_pylist()):
            words = text.split()
            gone = np.zeros(len(words), bool)
            if minis.is_valid:
                first, count, hashes = minimizers(words, window, gram)
                at = np.flatnonzero(np.isin(hashes.view(np.int64), minis.values.to_numpy()))
                gone = covered(len(words), first[at], count[at], masks or [], window)
            edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
            kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g]) if len(edges) else b" ".join(words)
            out["n_words"].append(len(words))
            out["n_removed"].append(int(gone.sum()))
            out["spans"].append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
            out["kept"].append(hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "replace"))
        return out

    return map_batches(marked.select(*_DOC, "text", "minis", "masks"), rows, f"{_doc_fields(marked)}, n_words long, "
                       "n_removed long, spans array<struct<start:int,end:int>>, kept string")


def covered(n: int, first: np.ndarray, count: np.ndarray, masks: list[dict], window: int) -> np.ndarray:
    """Which of ``n`` words lie in a repeated window. The windows of the
    repeated pieces (``first``, ``count``) are repeats, but for those that a
    mask names as first of their kind: a mask has a bit for each of its ``n``
    windows from ``first`` on, set for a repeat."""
    repeat = np.zeros(n + 1, np.int64)
    for a, k in zip(first.tolist(), count.tolist()):
        repeat[a:a + k] = 1
    for m in masks:
        for k in range(m["n"]):
            repeat[m["first"] + k] = m["mask"] >> k & 1
    at = np.flatnonzero(repeat)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + window, -1)
    return np.cumsum(step[:n]) > 0


def repeats_query(spark, sf_dir: str) -> DataFrame:
    """Op 6: every document against all documents."""
    from threadlens.llm.common import read

    found = remove_repeats(read(spark, sf_dir, "documents"), digest=True)
    return found.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


#: DuckDB: windows joined by their words with the first place of each.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM d WHERE len(w) >= 20),
x AS (SELECT doc_id, k, array_to_string(w[k : k + 19], ' ') AS win FROM s),
r AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY win ORDER BY doc_id, k) AS place FROM x)
      WHERE place > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS pos FROM r),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
k AS (SELECT p.doc_id, count(*) FILTER (g.pos IS NOT NULL) AS n_removed,
             string_agg(word, ' ' ORDER BY p.pos) FILTER (g.pos IS NULL) AS kept
      FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
