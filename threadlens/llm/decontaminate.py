"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark items: every ten consecutive
words, or the whole item where it has fewer. Words are the symbols, a block is
two words. For patterns of m words the shift table says how far a search
position may jump by the block that ends there (m - 1 words for a block that
no pattern has); where the shift is zero, the bucket of that suffix block
gives the patterns that end in it, and comparing their words decides.

Patterns of one length form one search (m is then the length of all of them);
one-word patterns are a plain lookup. The pattern set is cut into shards of a
fixed size, each broadcast by itself, so what a task holds never grows with
the benchmark; documents are streamed and nothing is shuffled as long as
there is one shard.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import map_batches, materialize, text_bytes

WINDOW = 10
#: Items in one broadcast shard, and the bytes of their texts at most.
SHARD_ITEMS = 20_000
SHARD_BYTES = 32 << 20

#: Lower-cases A-Z; every ASCII character that is no letter or digit becomes a blank.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
                    for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the lower-cased text."""
    return text.translate(_WORD_BYTES).split()


class WuManber:
    """Search tables for patterns that all have ``m`` words."""

    def __init__(self, m: int, patterns: set[tuple[bytes, ...]]):
        self.m = m
        self.block = min(2, m)
        self.default = m - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(list)
        for p in patterns:
            for end in range(self.block - 1, m):
                block = p[end] if self.block == 1 else (p[end - 1], p[end])
                self.shift[block] = min(self.shift.get(block, self.default), m - 1 - end)
            self.buckets[p[-1] if self.block == 1 else p[-2:]].append(p)
        self.buckets = dict(self.buckets)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """(start, pattern) of every occurrence."""
        m, default, shift = self.m, self.default, self.shift.get
        n, at, pairs = len(words), self.m - 1, self.block == 2
        while at < n:
            block = (words[at - 1], words[at]) if pairs else words[at]
            jump = shift(block, default)
            if jump:
                at += jump
                continue
            start = at - m + 1
            for p in self.buckets[block]:
                if p[0] == words[start] and p == tuple(words[start:at + 1]):
                    yield start, p
            at += 1


class Matcher:
    """All windows of some benchmark items, and the items of each window."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.items_of: dict[tuple[bytes, ...], set] = defaultdict(set)
        for item_id, text in items:
            words = words_of(text)
            if words:
                for i in range(max(1, len(words) - window + 1)):
                    self.items_of[tuple(words[i:i + window])].add(item_id)
        by_length = defaultdict(set)
        for p in self.items_of:
            by_length[len(p)].add(p)
        self.searches = [WuManber(m, ps) for m, ps in sorted(by_length.items())]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans of words (start, end) inside occurrences; the items that occur."""
        spans, items = [], set()
        for search in self.searches:
            for start, p in search.find(words):
                spans.append((start, start + search.m))
                items |= self.items_of[p]
        return merge(spans), items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _shards(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, bytes]]]:
    """The items in shards of bounded size; toLocalIterator keeps one partition of items on the driver."""
    shard, size = [], 0
    rows = items.filter(F.col(text_col).isNotNull()).select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col))
    for item_id, text in rows.toLocalIterator():
        raw = text.encode()
        if shard and (len(shard) >= SHARD_ITEMS or size + len(raw) > SHARD_BYTES):
            yield shard
            shard, size = [], 0
        shard.append((item_id, raw))
        size += len(raw)
    yield shard


def contamination(docs: DataFrame, items: DataFrame, keep: list[str], text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs``: its columns ``keep`` and (n_words,
    hit_spans, hit_items) with the merged word spans (start, end) inside
    occurrences of benchmark windows and the sorted ids (as text) of the items
    that occur.

    A null or empty text, and one of separators only, has no words: no spans
    as a document, no window as an item. A null item id counts as ''. Items
    with equal texts or ids are all reported (an id once). Repeated documents
    are rows of their own; an empty benchmark hits nothing. Columns of ``docs``
    that are not in ``keep``, or have the name of a result, are left out.
    """
    spark = docs.sparkSession
    keep = [c for c in keep if c not in ("n_words", "hit_spans", "hit_items", "hit_row", "hit_text")]
    kept = docs.select(*keep, F.lit(0).cast("long").alias("hit_row"), F.col(text_col).alias("hit_text"))
    at = len(keep)
    fields = [f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in [*keep, "hit_row"]]
    schema = ", ".join([*fields, "n_words long", "hit_spans array<struct<start:int,end:int>>", "hit_items array<string>"])
    shards = _shards(items, item_id, item_text)
    first, second = next(shards), next(shards, None)
    if second is not None:  # several shards meet again by a row number of a written table
        kept = materialize(kept.withColumn("hit_row", F.monotonically_increasing_id()), "decontaminate")

    def against(shard) -> DataFrame:
        shared = spark.sparkContext.broadcast(shard)
        made: list[Matcher] = []

        def rows(batch: pa.RecordBatch) -> dict:
            if not made:
                made.append(Matcher(shared.value, window))
            out: dict = {c: batch.column(i) for i, c in enumerate([*keep, "hit_row"])}
            out |= {"n_words": [], "hit_spans": [], "hit_items": []}
            for text in text_bytes(batch.column(at + 1)):
                words = words_of(text)
                spans, found = made[0].find(words)
                out["n_words"].append(len(words))
                out["hit_spans"].append([{"start": a, "end": b} for a, b in spans])
                out["hit_items"].append(sorted(found))
            return out

        return map_batches(kept, rows, schema)

    found = against(first)
    if second is None:
        return found.drop("hit_row")
    for shard in (second, *shards):
        found = found.unionByName(against(shard))
    found = found.groupBy("hit_row").agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("hit_spans"))).alias("hit_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_items")))).alias("hit_items"))
    return (kept.select(*keep, "hit_row").join(found, "hit_row")
            .select(*keep, "n_words", _merged(F.col("hit_spans")).alias("hit_spans"), "hit_items"))


def _merged(spans):
    """Sorted spans without overlaps (as ``merge``), in SQL."""
    start = F.array().cast("array<struct<start:int,end:int>>")

    def add(done, span):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= span["start"]), joined
                      ).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(spans, start, add)


def decontaminate_query(spark, sf_dir: str) -> DataFrame:
    """Op 8: every document against the whole benchmark."""
    from threadlens.llm.common import read

    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), ["doc_id"])
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"))


#: DuckDB: every window of ten words (or the whole text of fewer) joined by equality.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
p AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM i WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, k, m, array_to_string(w[k : k + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k
        FROM d, (SELECT DISTINCT m FROM p) lengths WHERE len(w) >= m)),
o AS (SELECT doc_id, k, dw.m AS m, item_id FROM dw JOIN p ON dw.m = p.m AND dw.win = p.win),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit
      FROM (SELECT doc_id, unnest(range(k, k + m)) AS pos FROM o) GROUP BY doc_id),
n AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
             string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
      FROM o GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""
