"""Spelling variants by a dictionary of trie-node pairs.

The words form a trie, and their reversals another; each node of either trie
(a prefix, or a suffix) has a number. A word of n letters is n + 1 pairs of
the nodes before and behind a gap, and n pairs that skip one letter. Two words
differ by one replaced letter when they skip a letter to the same pair, and by
one inserted letter when a skip of the longer one is a gap of the shorter one.
So one grouping by integer pairs finds all words at one edit exactly, without
a string comparison.

Tries are numbered along the sorted words: a word has the numbers of the word
before it as far as both agree and new ones from there on. The sort is split
at cut words; a prefix that occurs on both sides of a cut is a prefix of the
cut word, and those few are numbered beforehand, so ranges need nothing of
each other. A pair holds at most one word for each letter of the alphabet at a
skip and one word at a gap, however many words there are.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import ASCII_LOWER, map_batches, materialize, read, texts

#: Words of the query: runs of these letters, this long and this frequent at least.
LETTERS = "[A-Za-zÀ-ÿ]+"
MIN_LENGTH = 7
MIN_COUNT = 2
#: A word's form occurs at least this many times as often.
RATIO = 10
#: One document in so many has a word of its own edited (the query's input).
EDITED = 31
#: Letters of a cut word, and nodes numbered within a range.
CUT_LETTERS = 64
RANGE_BITS = 40
#: Different words that a task counts before it passes them on.
COUNTED = 200_000
#: Characters searched for words at once.
PART = 1 << 20


def common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def cut_words(words: DataFrame, ranges: int) -> list[str]:
    """Words that split the sorted ``words`` into about equal ranges: quantiles
    of a sample of at most about 100 words a range (its rate follows from the
    exact number of words), cut to CUT_LETTERS. They decide who sorts what,
    never the result."""
    n = words.count()
    if ranges < 2 or n < ranges:
        return []
    rate = min(1.0, 100 * ranges / n)
    share = F.xxhash64("word") / F.lit(2.0 ** 64) + 0.5
    sample = sorted(r[0] for r in words.filter(share < rate).select(F.substring("word", 1, CUT_LETTERS)).collect())
    return sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)} - {""}) if sample else []


def _cut_nodes(cuts: list[str]) -> dict[str, int]:
    """Numbers of all prefixes of the cut words."""
    nodes: dict[str, int] = {"": 0}
    for c in cuts:
        for i in range(1, len(c) + 1):
            nodes.setdefault(c[:i], len(nodes))
    return nodes


def number_nodes(words: DataFrame, column: str, ranges: int) -> DataFrame:
    """``words`` (column word, and others) with ``column``: the numbers of the
    trie nodes on the path of each word, the root first (its length + 1)."""
    cuts = cut_words(words, ranges)
    shared = words.sparkSession.sparkContext.broadcast((cuts, _cut_nodes(cuts)))

    def range_of(batch: pa.RecordBatch) -> dict:
        found = [bisect_right(shared.value[0], w) for w in batch.column(0).to_pylist()]
        return {f.name: batch.column(i) for i, f in enumerate(batch.schema)} | {"range": found}

    names = ["word", *[c for c in words.columns if c != "word"]]
    kept = words.select(*names)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    ranged = (map_batches(kept, range_of, ", ".join([*fields, "range int"]))
              .repartitionById(len(cuts) + 1, F.col("range")).sortWithinPartitions("range", "word"))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = ", ".join([*fields, f"`{column}` array<bigint>"])
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, cut_nodes = shared.value
        longest = max(map(len, cuts), default=0)
        now, last, path, made = -1, "", [], 0
        for batch in batches:
            at = batch.schema.get_field_index("range")
            out = []
            for w, r in zip(batch.column(0).to_pylist(), batch.column(at).to_pylist()):
                if r != now:
                    now, last, path, made = r, "", [0], 0
                same = common(last, w)
                path = path[:same + 1]
                for i in range(same + 1, len(w) + 1):
                    node = cut_nodes.get(w[:i]) if i <= longest else None
                    if node is None:
                        made += 1
                        node = (r + 1 << RANGE_BITS) + made
                    path.append(node)
                last = w
                out.append(path)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(out, arrow.field(column).type)], schema=arrow)

    return ranged.mapInArrow(run, schema)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, near, near_n) for each row of ``words`` (word, n;
    different words, none null): the number of words that differ by exactly
    one inserted, deleted or replaced code point, and the one of largest n
    (ties: the smallest in code-point order); 0 and nulls if there is none."""
    spark = words.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    forward = materialize(number_nodes(words.select("word", "n"), "prefix", ranges), "variants-prefix")
    back = forward.select(F.reverse("word").alias("word"), "n", "prefix")
    both = number_nodes(back, "suffix", ranges).withColumn("word", F.reverse("word"))

    # gap i lies before letter i; the suffix path starts at the word's end
    size = F.length("word")
    place = F.sequence(F.lit(0), size)
    letter = lambda i: F.substring("word", i + 1, F.lit(1))
    suffix = lambda i: F.element_at("suffix", size - i + 1)  # noqa: E731  (node of the letters from i on)
    prefix = lambda i: F.element_at("prefix", i + 1)
    gaps = F.transform(place, lambda i: F.struct(prefix(i).alias("p"), suffix(i).alias("s"), F.lit(0).alias("kind")))
    # of equal letters in a row only the first one's skip meets gaps (kind 1): the others give the same word again
    repeats = lambda i: (i > 0) & (letter(i) == letter(i - 1))
    skips = F.transform(F.slice(place, F.lit(1), size), lambda i: F.struct(
        prefix(i).alias("p"), suffix(i + 1).alias("s"), F.when(repeats(i), 2).otherwise(1).alias("kind")))
    pairs = both.select("word", "n", F.explode(F.concat(gaps, skips)).alias("pair"))
    member = F.struct((-F.col("n")).alias("n"), "word", F.col("pair.kind").alias("kind"))
    met = (pairs.groupBy("pair.p", "pair.s").agg(F.sort_array(F.collect_list(member)).alias("members"))
           .filter(F.size("members") > 1))
    # a word at a skip is near the others at it, and near the word at the gap if its skip is the first of equal letters
    of_kind = lambda test: F.filter("members", lambda m: test(m["kind"]))
    met = met.select("members", of_kind(lambda k: k > 0).alias("skips"), of_kind(lambda k: k == 1).alias("firsts"))
    other = lambda among, m: F.when(among[0]["word"] == m["word"], F.get(among, F.lit(1))).otherwise(among[0])
    members, skips, firsts = F.col("members"), F.col("skips"), F.col("firsts")
    near_of = lambda m: (F.when(m["kind"] == 0, F.struct(F.size(firsts).alias("k"), F.get(firsts, F.lit(0)).alias("b")))
                         .when(m["kind"] == 1, F.struct((F.size(members) - 1).alias("k"), other(members, m).alias("b")))
                         .otherwise(F.struct((F.size(skips) - 1).alias("k"), other(skips, m).alias("b"))))
    found = F.transform("members", lambda m: F.struct(m["word"].alias("word"), near_of(m).alias("near")))
    each = met.select(F.explode(found).alias("f")).filter("f.near.k > 0").select(
        "f.word", "f.near.k", F.struct("f.near.b.n", "f.near.b.word").alias("b"))
    best = each.groupBy("word").agg(F.sum("k").alias("n_near"), F.min("b").alias("best"))
    return words.select("word", "n").join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.col("best.word").alias("near"), (-F.col("best.n")).alias("near_n"))


def variant_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each different word of
    ``words`` (word, n).

    A word's form is its near word of largest n, if that is at least ``ratio``
    (2 or more) times the word's own; following forms ends at the root, the
    word itself if it has no form. Rows with a null word or count are left
    out; repeated words add up; other columns are ignored; no rows give none.
    A word may have any length and letters; its paths need memory in
    proportion to its length.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its variant")
    counted = words.filter(F.col("word").isNotNull() & F.col("n").isNotNull()).groupBy("word").agg(
        F.sum(F.col("n").cast("long")).alias("n"))
    counted = materialize(counted, "variants-words")
    near = near_words(counted)
    form = F.col("near_n") >= ratio * F.col("n")
    formed = materialize(near.select("word", "n", "n_near", F.when(form, F.col("near")).alias("form"),
                                     F.when(form, F.col("near_n")).alias("form_n")), "variants-forms")
    # each form multiplies n by the ratio, so the largest count bounds the length of a chain
    low, high = counted.agg(F.min("n"), F.max("n")).first()
    longest = 0
    while high and max(low, 1) * ratio ** (longest + 1) <= high:
        longest += 1
    links = formed.filter(F.col("form").isNotNull()).select(F.col("word").alias("of"), F.col("form").alias("to"))
    for _ in range(longest.bit_length()):  # each round doubles the steps that a link spans
        on = links.select(F.col("of").alias("mid"), F.col("to").alias("end"))
        links = materialize(links.join(on, F.col("to") == F.col("mid"), "left")
                            .select("of", F.coalesce("end", "to").alias("to")), "variants-links")
    rooted = formed.join(links, formed.word == links.of, "left")
    return rooted.select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def ascii_lower(text: str) -> str:
    """A-Z to a-z, other characters as they are."""
    return text.lower() if text.isascii() else text.encode().translate(ASCII_LOWER).decode()


def words_of(text: str, pattern: re.Pattern) -> Iterator[list[str]]:
    """Maximal runs of ``pattern``'s letters, in bounded parts of the text."""
    if len(text) <= PART:
        yield pattern.findall(text)
        return
    part = []
    for m in pattern.finditer(text):
        part.append(m.group())
        if len(part) >= PART // 8:
            yield part
            part = []
    yield part


def count_words(docs: DataFrame, letters: str = LETTERS, edited: int = EDITED, min_length: int = MIN_LENGTH,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of whole texts, lower-cased in A-Z, of at least
    ``min_length`` code points, with their occurrences in all documents. With
    ``edited``, words whose crc32 of ``<id>:<word>`` it divides lose one
    letter first (a null id is an empty one; 0: no edits). Null texts have no
    words."""
    def rows(batch: pa.RecordBatch) -> Iterator[Counter]:
        pattern, total = re.compile(letters), Counter()
        for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
            head = crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for part in words_of(ascii_lower(text), pattern):
                for word, n in Counter(part).items():
                    if edited:
                        h = crc32(word.encode(), head)
                        if h % edited == 0:
                            i = h % len(word)
                            word = word[:i] + word[i + 1:]
                    if len(word) >= min_length:
                        total[word] += n
                if len(total) >= COUNTED:
                    yield total
                    total = Counter()
        yield total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for total in rows(batch):
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()),
                                                  pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    kept = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def variants_query(spark, sf_dir: str) -> DataFrame:
    """Op 12 over the words of ``documents``."""
    words = count_words(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return variant_groups(words.filter(F.col("n") >= MIN_COUNT))
