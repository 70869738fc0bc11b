"""F1 with a store: each different text is embedded once, whatever number of
documents, jobs and runs ask for it.

The store is a parquet folder (text_key, embedding, error, at), a partition
for each model. A run finds the texts that the model has not embedded by an
anti join of digests, shuffles and embeds these only, appends them in one
committed write, and joins the vectors to the documents by digest. A job that
ends between two runs costs nothing that was committed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.functions.text import MIN_TOKEN_CHARS, TOKEN_SPLIT
from threadlens.operators.features import EMBED_DIM, BatchEmbedder
from threadlens.sources.sinks import materialize

STORE_SCHEMA = "text_key string, embedding array<float>, error string, at timestamp, model string"


def read_store(spark: SparkSession, path: str, model: str) -> DataFrame:
    """The stored rows of ``model``; none where there is no store."""
    try:
        rows = spark.read.schema(STORE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], STORE_SCHEMA)
    return rows.filter(F.col("model") == model)


def embed_stored(docs: DataFrame, text_col: str, path: str, model: str, embedder: BatchEmbedder,
                 out_col: str = "embedding", error_col: str = "embedding_error") -> DataFrame:
    """``docs`` with the vector of each row's text and the reason where there is
    none (columns of these names are replaced).

    ``embedder`` takes a series of texts and returns one of vectors. Where a
    batch raises, its texts are tried one by one, and a text that fails alone
    has a null vector and the error's text; so has one without a vector or with
    a value that isn't finite. Failed texts are tried again by the next run.
    A null text is embedded as the empty one."""
    spark = docs.sparkSession
    keyed = docs.drop(out_col, error_col).withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    keyed = keyed.withColumn("__key", F.sha2("__text", 256))
    keys = materialize(keyed.select(F.col("__key").alias("text_key")).distinct(), "embed-keys")
    done = read_store(spark, path, model).filter(F.col("embedding").isNotNull()).select("text_key")
    new = materialize(keys.join(done, "text_key", "left_anti"), "embed-new")
    texts = (keyed.select(F.col("__key").alias("text_key"), "__text").join(new, "text_key", "left_semi")
             .dropDuplicates(["text_key"]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors, errors = _embedded(embedder, frame["__text"])
            yield pd.DataFrame({"text_key": frame["text_key"].to_numpy(), "embedding": vectors, "error": errors})

    made = texts.mapInPandas(run, "text_key string, embedding array<float>, error string")
    (made.withColumn("at", F.current_timestamp()).withColumn("model", F.lit(model))
     .write.mode("append").partitionBy("model").parquet(path))

    # a text has several rows after failures, or where two runs met: a vector goes first, then the latest
    row = F.struct("embedding", "error")
    stored = (read_store(spark, path, model).join(keys, "text_key", "left_semi")
              .groupBy(F.col("text_key").alias("__key"))
              .agg(F.max_by(row, F.struct(F.col("embedding").isNotNull(), "at")).alias("__row")))
    return (keyed.join(stored, "__key", "left")
            .withColumn(out_col, F.col("__row.embedding")).withColumn(error_col, F.col("__row.error"))
            .drop("__key", "__text", "__row"))


def _embedded(embedder: BatchEmbedder, texts: pd.Series) -> tuple[list, list]:
    """(vectors, errors) of a batch; None where there is none."""
    try:
        found = list(embedder(texts))
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
    except Exception as e:  # the caller's function: its failure is a result, not the job's end
        if len(texts) > 1:
            alone = [_embedded(embedder, texts.iloc[i:i + 1]) for i in range(len(texts))]
            return [v for vs, _ in alone for v in vs], [r for _, rs in alone for r in rs]
        return [None], [f"{type(e).__name__}: {e}"]
    vectors, errors = [], []
    for v in found:
        v = None if v is None else np.asarray(v, np.float32)
        bad = "no vector" if v is None else None if np.isfinite(v).all() else "a value is not finite"
        vectors.append(None if bad else v)
        errors.append(bad)
    return vectors, errors


def hashed_bag(texts: pd.Series) -> pd.Series:
    """A batch embedder: the vectors of ``features.hashed_embedding`` in Python."""
    import hashlib

    out = []
    for text in texts:
        sums = np.zeros(EMBED_DIM)
        for term in regex.split(TOKEN_SPLIT, text.lower()):
            if len(term) >= MIN_TOKEN_CHARS:
                h = int(hashlib.md5(term.encode()).hexdigest()[:8], 16)
                sums[h % EMBED_DIM] += 1 if h // EMBED_DIM % 2 == 0 else -1
        norm = np.sqrt((sums * sums).sum())
        out.append((sums / norm if norm > 0 else sums).astype(np.float32))
    return pd.Series(out)
