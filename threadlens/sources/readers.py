"""Readers. All lazy; column selection happens before any action so
only the requested columns are read from the files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession

from threadlens.functions.clean import SENTINEL, as_text
from threadlens.sources.tables import DOC_TOPIC_SCHEMA


def select_cols(df: DataFrame, columns: list[str], sentinel: str = SENTINEL) -> DataFrame:
    """S1 + P1 + P2 on a frame: keep ``columns`` in that order, null → sentinel,
    every value as text. A requested column that is absent is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}; available: {df.columns}")
    return df.select(*[as_text(c, sentinel).alias(c) for c in columns])


def read_cols(spark: SparkSession, path: str, columns: list[str], fmt: str = "parquet",
              sentinel: str = SENTINEL, where: Column | None = None, **options) -> DataFrame:
    """Read named columns of one table (one "sheet").

    ``where`` is a predicate on the *raw* columns, applied before the sentinel
    fill so the scan can use it (e.g. ``not_blocked('final_state')`` shows up
    in ``PushedFilters``; after ``coalesce`` it would not)."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
    for k, v in options.items():
        reader = reader.option(k, v)
    raw = reader.load(path)
    if where is not None:
        raw = raw.filter(where)
    return select_cols(raw, columns, sentinel)


def read_doc_topic(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The doc_topic hand-off with its declared schema (no inference)."""
    reader = spark.read.schema(DOC_TOPIC_SCHEMA)
    if fmt == "csv":
        return reader.option("header", "true").csv(path)
    return reader.parquet(path)


def union_sheets(frames: list[DataFrame]) -> DataFrame:
    """S3 + U1: all sheets as one frame, matched by column name; a column a
    sheet lacks is null there."""
    if not frames:
        raise ValueError("no sheets to union")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
