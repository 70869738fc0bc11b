"""Periodic runs of words, found in an enhanced suffix array by branching tandems.

A square xx at word i with period d = |x| is branching when the word behind it
is not the one that would continue the period. The suffixes at i and i + d then
share exactly d words: they lie in different children of one LCP interval of
depth d. So for each LCP interval the suffixes of its smaller children ask,
by the inverse suffix array, whether the suffix d words on (or d words back)
lies in the interval's other part. Taking the smaller side bounds the questions
by n log n. Every maximal run ends with one branching square per multiple of
its period; rotating a square to the left as long as it stays a square gives
the run's start, and squares with one end and start merge into one run of the
smallest period.

The suffix array, its inverse and the LCP values are plain arrays (prefix
doubling, only tied suffixes are sorted again); LCP intervals are read off the
LCP array with a stack, no tree node is made. Documents share an array in
chunks, each closed by a word of its own, so no repeat spans two of them.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import map_batches, read, text_bytes

#: A run has at least this many words and this many periods.
MIN_LENGTH = 6
MIN_EXPONENT = 4
#: Words that share a suffix array (a longer document has its own), and questions asked at once.
CHUNK_WORDS = 1 << 16
QUESTIONS = 1 << 21
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, its inverse and the LCP values (lcp[j]: of the suffixes
    at places j - 1 and j) of whole numbers whose last one occurs once."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = symbols[order[1:]] != symbols[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    levels = [rank.astype(np.int32)]  # equal where the first 1, 2, 4, ... words are equal
    step = 1
    while True:
        tied = np.flatnonzero(~fresh | ~np.append(fresh[1:], True))
        if not len(tied):
            break
        at = order[tied]
        key = rank[at] * np.int64(n) + rank[at + step]
        by_key = np.argsort(key, kind="stable")
        order[tied], key = at[by_key], key[by_key]
        new = np.ones(len(tied), bool)
        new[1:] = key[1:] != key[:-1]
        fresh[tied] = new
        rank[order[tied]] = np.maximum.accumulate(np.where(new, tied, 0))
        levels.append(rank.astype(np.int32))
        step *= 2
    lcp = np.zeros(n, np.int64)
    pair = np.flatnonzero(symbols[order[1:]] == symbols[order[:-1]]) + 1
    a, b, length = order[pair - 1], order[pair], np.zeros(len(pair), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        length += (levels[k][a + length] == levels[k][b + length]).astype(np.int64) << k
    lcp[pair] = length
    return order, rank, lcp


def interval_sides(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every place j with lcp[j] > 0: (j, left, right). The suffixes at
    places left..j-1 and those at j..right-1 are in different children of the
    LCP interval of depth lcp[j]; each such pair has one j."""
    values = lcp.tolist()
    n = len(values)
    left, right = [0] * n, [n] * n
    stack = [0]
    for j in range(1, n):
        v = values[j]
        while values[stack[-1]] > v:
            right[stack.pop()] = j
        left[j] = stack[-1]
        if v:
            stack.append(j)
        else:
            stack = [j]
    j = np.flatnonzero(lcp > 0)
    return j, np.array(left, np.int64)[j], np.array(right, np.int64)[j]


def branching_squares(symbols: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every branching square with a period of at most ``longest`` words."""
    order, rank, lcp = suffix_array(symbols)
    j, left, right = interval_sides(lcp)
    wanted = lcp[j] <= longest
    j, left, right = j[wanted], left[wanted], right[wanted]
    depth = lcp[j]
    from_left = j - left <= right - j
    low, size = np.where(from_left, left, j), np.minimum(j - left, right - j)
    other_low, other_high = np.where(from_left, j, left), np.where(from_left, right, j)
    starts, periods = [], []
    ends = np.cumsum(size)
    a = 0
    while a < len(j):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + QUESTIONS, side="right")))
        of = np.repeat(np.arange(a, b), size[a:b])
        first = ends[a:b] - size[a:b] - (ends[a - 1] if a else 0)
        suffix = order[low[of] + np.arange(len(of)) - np.repeat(first, size[a:b])]
        d = depth[of]
        for at, start in ((suffix + d, suffix), (suffix - d, suffix - d)):
            inside = (at >= 0) & (at < len(symbols))
            place = rank[np.where(inside, at, 0)]
            found = inside & (place >= other_low[of]) & (place < other_high[of])
            starts.append(start[found])
            periods.append(d[found])
        a = b
    return np.concatenate([*starts, np.zeros(0, np.int64)]), np.concatenate([*periods, np.zeros(0, np.int64)])


def rotations(symbols: np.ndarray, start: int, period: int) -> int:
    """How many times the square at ``start`` can be rotated to the left: words
    before it that equal the one a period on (compared in growing blocks)."""
    at, step = start, 16
    while at:
        step = min(step, at)
        differ = symbols[at - step:at] != symbols[at - step + period:at + period]
        if differ.any():
            return start - (at - step + int(np.flatnonzero(differ)[-1]) + 1)
        at -= step
        step *= 2
    return start


def periodic_runs(symbols: np.ndarray, longest: int, min_length: int = MIN_LENGTH,
                  min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run, ascending."""
    starts, periods = branching_squares(symbols, longest)
    need = np.maximum(min_length, min_exponent * periods) - 2 * periods  # rotations
    likely = starts >= need
    probe = likely & (need > 0)
    likely[probe] = symbols[starts[probe] - need[probe]] == symbols[(starts - need + periods)[probe]]
    starts, periods = starts[likely], periods[likely]
    by_end = np.lexsort((periods, starts + 2 * periods))
    runs, known, end = set(), [], -1
    for i, d in zip(starts[by_end].tolist(), periods[by_end].tolist()):
        if i + 2 * d != end:
            end, known = i + 2 * d, []
        if any(d % q == 0 and s <= i for s, q in known):
            continue  # a multiple of a smaller period of the same run
        s = i - rotations(symbols, i, d)
        known.append((s, d))
        if end - s >= max(min_length, min_exponent * d):
            runs.add((s, end - s, d))
    return sorted(runs)


def runs_of_documents(documents: list[list[bytes]], min_length: int = MIN_LENGTH,
                      min_exponent: int = MIN_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    chunk: list[int] = []
    size = 0
    for i, words in enumerate(documents):
        if len(words) >= min_length:
            chunk.append(i)
            size += len(words)
        if chunk and (size >= CHUNK_WORDS or i == len(documents) - 1):
            _runs_of_chunk(documents, chunk, out, min_length, min_exponent)
            chunk, size = [], 0
    if chunk:
        _runs_of_chunk(documents, chunk, out, min_length, min_exponent)
    return out


def _runs_of_chunk(documents, chunk, out, min_length, min_exponent) -> None:
    number = defaultdict(count().__next__)
    parts, firsts, size = [], [], 0
    for i in chunk:
        firsts.append(size)
        parts.append(np.array([*map(number.__getitem__, documents[i]), 0], np.int64))
        parts[-1][-1] = -1 - len(firsts)  # a word of its own behind each document
        size += len(parts[-1])
    longest = max(map(len, parts)) // min_exponent
    for start, length, period in periodic_runs(np.concatenate(parts), longest, min_length, min_exponent):
        k = int(np.searchsorted(firsts, start, side="right")) - 1
        out[chunk[k]].append((start - firsts[k], length, period))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run has after its first period."""
    if not runs:
        return words
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    return [w for w, n in zip(words, np.cumsum(dropped).tolist()) if not n]


def find_runs(docs: DataFrame, keep: list[str], text_col: str = "text", min_length: int = MIN_LENGTH,
              min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """The columns ``keep`` of ``docs`` with n_words, runs (array of start,
    length, period in words, ascending) and collapsed (the words that no run
    holds after its first period, joined by one space). Columns of these names
    in ``keep`` are replaced.

    Words are runs of characters other than ASCII white space. A run is a
    stretch with smallest period q, of at least ``min_length`` words and
    ``min_exponent`` (2 or more) periods, that no neighbouring word extends. A
    null, empty or blank text has no words, no runs and collapses to the empty
    text. Every row, repeated or not, gets its own result; rows without an id
    too; no rows give no rows. One map over whole texts, without a shuffle; a
    very long text needs memory in proportion to its words.
    """
    if min_exponent < 2:
        raise ValueError("a run has at least two periods")
    keep = [c for c in keep if c not in ("n_words", "runs", "collapsed")]
    kept = docs.select(*keep, F.col(text_col).alias("runs_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]

    def rows(batch: pa.RecordBatch) -> dict:
        documents = [t.split() for t in text_bytes(batch.column(len(keep)))]
        found = runs_of_documents(documents, min_length, min_exponent)
        return {c: batch.column(i) for i, c in enumerate(keep)} | {
            "n_words": list(map(len, documents)),
            "runs": [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found],
            "collapsed": [b" ".join(collapse(w, r)).decode() for w, r in zip(documents, found)]}

    return map_batches(kept, rows, ", ".join([*fields, f"n_words long, runs array<{RUN}>, collapsed string"]))


def repeat_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the query's input: in documents whose h = crc32 of the
    id's text is divisible by 10 the words from a on repeat with period p,
    a = floor(h / 10) % n, p = 1 + floor((n - a) / (3 + floor(h / 10) % 8))."""
    words = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    marked = docs.select("doc_id", "text", g.alias("g"),
                         F.when(h % 10 == 0, words).alias("words")).withColumn("n", F.size("words"))
    a = F.col("g") % F.col("n")
    p = F.lit(1) + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))
    marked = marked.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", p)
    source = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    places = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1),
                         lambda i: F.get("words", source(i).cast("int")))
    return marked.select("doc_id", F.when(F.col("n") > 0, F.concat_ws(" ", places)).otherwise(F.col("text")).alias("text"))


def runs_query(spark, sf_dir: str) -> DataFrame:
    """Op 13 over ``documents``, a tenth of them with a periodic tail."""
    found = find_runs(repeat_tails(read(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id"])
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"], -r["start"], -r["period"], r["start"].alias("at"), r["period"].alias("q"))))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    by_start = F.array_sort(F.transform("runs", lambda r: F.struct(r["start"], r["period"], r["length"])))
    best = found.withColumn("best", longest)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.at").alias("start"),
        F.col("best.length").alias("length"), F.col("best.q").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.q")).cast("long").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(by_start, line)), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
