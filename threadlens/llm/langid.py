"""Language identification by word-first backoff (in the manner of HeLI).

The model has relative frequencies per language of words and of character
n-grams. A known word scores by its log frequency in each language; a word
that no language knows falls back to its n-grams of the longest length that
any language knows one of, down to single characters, and scores by their
mean. A language that lacks the word (or n-gram) gets a fixed penalty. A
text's score for a language is the mean over its words; the best mean wins.

The model is fitted on labelled rows: at most about ``SAMPLE_DOCS`` documents
for each language (a hash of text and id decides, the rate follows from the
language's exact number of labelled rows), and keeps the ``MAX_WORDS`` most
frequent words and ``MAX_GRAMS`` n-grams of each length and language. Every
label is learnt. So its size is bounded by parameters times the number of
labels and it can be broadcast; it is sparse, an entry holds the languages that
have it. Counting runs as a
Spark aggregate; prediction is a map over all rows without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.llm.common import map_batches, texts

#: Bounds of the fit: labelled documents, kept words and kept n-grams (of each length) per language.
SAMPLE_DOCS = 4000
MAX_WORDS = 50_000
MAX_GRAMS = 20_000
LONGEST = 5
#: Score of a word or n-gram in a language that lacks it (negative log10 frequency).
PENALTY = 7.0
UNDETERMINED = "und"
_LETTERS = regex.compile(r"\p{L}+")
#: Scores of unseen words that a worker remembers (single numbers; words at most), and words scored at once.
_NUMBERS, _MEMORY, _BLOCK = 4_000_000, 200_000, 50_000


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return _LETTERS.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of the word between blanks (single characters: of the word alone)."""
    padded = word if n == 1 else f" {word} "
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    """``langs`` in ascending order; the entry with index i of ``words`` or of
    ``grams`` (by length) is in the languages ``at[starts[i]:starts[i + 1]]``,
    where it scores PENALTY less ``gains`` there."""

    langs: list[str]
    words: dict[str, int]
    grams: list[dict[str, int]]
    starts: np.ndarray
    at: np.ndarray
    gains: np.ndarray
    rows: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def _gain(self, entries: list[int]) -> np.ndarray:
        """Sum of the entries' gains per language."""
        found = np.asarray(entries, np.int64)
        first = self.starts[found]
        sizes = self.starts[found + 1] - first
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) + np.repeat(first - ends + sizes, sizes)
        return np.bincount(self.at[places], self.gains[places], len(self.langs))

    def backoff(self, word: str) -> np.ndarray:
        """Gains of an unseen word."""
        for n in range(LONGEST, 0, -1):
            known = self.grams[n]
            at = [known[g] for g in grams_of(word, n) if g in known]
            if at:
                return self._gain(at) / len(at)
        return np.zeros(len(self.langs))

    def text_scores(self, text: str) -> np.ndarray | None:
        """Mean score per language (lower is better); None without a letter."""
        words = words_of(text)
        if not words or not self.langs:
            return None
        room = max(4, min(_MEMORY, _NUMBERS // len(self.langs)))
        size = min(_BLOCK, room // 4)
        total = np.zeros(len(self.langs))
        for a in range(0, len(words), size):
            block = words[a:a + size]
            if self.table is None or len(self.rows) + len(block) > room:
                self.rows, self.table = {}, np.empty((room, len(self.langs)))
            known = list(map(self.words.get, block))
            seen = [i for i in known if i is not None]
            if seen:
                total += self._gain(seen)
            if len(seen) < len(block):
                total += self.table[[self._row(w) for i, w in zip(known, block) if i is None]].sum(0)
        return PENALTY - total / len(words)

    def _row(self, word: str) -> int:
        """Row of an unseen word in the table of gains."""
        i = self.rows.get(word)
        if i is None:
            i = self.rows[word] = len(self.rows)
            self.table[i] = self.backoff(word)
        return i

    def predict(self, text: str) -> tuple[str, float]:
        """Language and score: the share of the best language among all by
        frequency per word (1 / languages: no evidence; 1: certain). Ties go
        to the first language in order."""
        mean = self.text_scores(text)
        if mean is None:
            return UNDETERMINED, 0.0
        best = int(mean.argmin())
        share = 10.0 ** (mean[best] - mean)
        return self.langs[best], float(1.0 / share.sum())


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        sample_docs: int = SAMPLE_DOCS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """Learn from the rows of ``docs`` that have a text and a language. The id
    only spreads the sample over copies of one text. Equal counts rank by the
    entry itself. Without such rows the model has no language and finds every
    text undetermined."""
    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"),
                           F.xxhash64(F.col(id_col), F.col(text_col)).alias("spread")).filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.col("spread") / F.lit(2.0 ** 64) + 0.5
    sample = labelled.join(F.broadcast(sizes), "lang").filter(share < F.lit(float(sample_docs)) / F.col("n")).select("text", "lang")

    def counts(batch: pa.RecordBatch) -> dict:
        found: Counter = Counter()
        for text, lang in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
            for word, c in Counter(words_of(text)).items():
                found[lang, 0, word] += c
        for (lang, _, word), c in list(found.items()):  # n-grams once for each different word
            for n in range(1, LONGEST + 1):
                for g in grams_of(word, n):
                    found[lang, n, g] += c
        keys = list(found)
        return {"lang": [k[0] for k in keys], "n": [k[1] for k in keys], "entry": [k[2] for k in keys],
                "c": list(found.values())}

    counted = (map_batches(sample, counts, "lang string, n int, entry string, c long")
               .groupBy("lang", "n", "entry").agg(F.sum("c").alias("c")))
    totals = counted.groupBy("lang", "n").agg(F.sum("c").alias("total"))
    by_count = W.partitionBy("lang", "n").orderBy(F.desc("c"), "entry")
    kept = (counted.withColumn("rank", F.row_number().over(by_count))
            .filter(F.col("rank") <= F.when(F.col("n") == 0, max_words).otherwise(max_grams))
            .join(totals, ["lang", "n"])
            .select("lang", "n", "entry", (-F.log10(F.col("c") / F.col("total"))).alias("score")))
    rows = kept.toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    lang = np.searchsorted(langs, rows.column("lang").to_numpy()) if langs else np.zeros(0, np.int64)
    order, score = rows.column("n").to_numpy(), rows.column("score").to_numpy()
    entries = rows.column("entry").to_pylist()
    tables: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
    entry = np.empty(len(entries), np.int64)
    size = 0
    for n in range(LONGEST + 1):  # entries in their own order, whatever the order of the rows
        places = np.flatnonzero(order == n).tolist()
        for e in sorted({entries[i] for i in places}):
            tables[n][e] = size
            size += 1
        for i in places:
            entry[i] = tables[n][entries[i]]
    by_entry = np.lexsort((lang, entry))
    starts = np.searchsorted(entry[by_entry], np.arange(size + 1))
    gains = np.maximum(PENALTY - score, 0.0)[by_entry]
    return Model(list(langs), tables[0], tables, starts, lang[by_entry].astype(np.int32), gains)


def identify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred and score (columns of
    these names are replaced). A text that is null, empty or without a letter
    is 'und' with score 0. Prediction sees the text only; every row, repeated
    or not, gets its own result; no rows give no rows."""
    # plain data: a broadcast of the class would need this package on the executors
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.langs, model.words, model.grams, model.starts, model.at, model.gains))
    made: list[Model] = []
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    kept = docs.select(*keep, F.col(text_col).alias("lang_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]

    def rows(batch: pa.RecordBatch) -> dict:
        if not made:
            made.append(Model(*shared.value))
        found = [made[0].predict(t) for t in texts(batch.column(len(keep)))]
        return {c: batch.column(i) for i, c in enumerate(keep)} | {
            "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    return map_batches(kept, rows, ", ".join([*fields, "lang_pred string", "score double"]))


def held_out(id_col: str = "doc_id"):
    """Documents that a fit must not see: crc32 of the id's text mod 3 is 1 (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def langid_query(spark, sf_dir: str) -> DataFrame:
    """Op 10: learn from two thirds of the labelled documents, predict all."""
    from threadlens.llm.common import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out()))
    marked = docs.select("doc_id", "text", held_out().alias("held_out"))
    return identify(marked, model, ["doc_id", "held_out"])
