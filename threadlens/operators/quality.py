"""Data-quality measures (A1, A2, A6–A10), returned as small tables instead of
printed. Each is one aggregate pass with partial (map-side) aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.functions.clean import BLOCKED_STATE, OUTLIER_TOPIC


def distinct_counts(df: DataFrame, columns: list[str], source: str) -> DataFrame:
    """A1: distinct non-null values per column, long form (source, column_name,
    n_distinct). Exact; use ``approx_distinct_counts`` for HyperLogLog."""
    row = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in columns])
    return _long(row, columns, "n_distinct").select(
        F.lit(source).alias("source"), "column_name", "n_distinct")


def approx_distinct_counts(df: DataFrame, columns: list[str], rsd: float = 0.01) -> DataFrame:
    row = df.agg(*[F.approx_count_distinct(F.col(c), rsd).alias(c) for c in columns])
    return _long(row, columns, "n_distinct")


#: Own parameter: 2^14 registers a sketch (at most 16 KB), and the relative
#: standard error of HyperLogLog with that number, 1.04 / sqrt(2^14) = 0.8%.
SKETCH_LG_K = 14
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_LG_K / 2)


def distinct_sketches(df: DataFrame, by: list[str], columns: list[str], lg_k: int = SKETCH_LG_K) -> DataFrame:
    """A1 in mergeable form: (by..., column_name, sketch) of the non-null values
    of each column. Text and whole-number columns. Stored by day, say, they
    give the distinct count of any set of days without the rows; a day that is
    stored twice counts once, as a union does."""
    rows = df.groupBy(*by).agg(*[F.hll_sketch_agg(F.col(c), lg_k).alias(c) for c in columns])
    return rows.unpivot(by, columns, "column_name", "sketch")


def merged_distinct(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by..., column_name, n_distinct): estimates from the union of the stored
    sketches of each group (standard error ``SKETCH_ERROR``)."""
    union = sketches.groupBy(*by, "column_name").agg(F.hll_union_agg("sketch").alias("sketch"))
    return union.select(*by, "column_name", F.hll_sketch_estimate("sketch").alias("n_distinct"))


def blocked_count(comments: DataFrame, state_col: str = "final_state") -> DataFrame:
    """A2: number of blocked comments and of all comments."""
    return comments.agg(
        F.count_if(F.col(state_col) == BLOCKED_STATE).alias("n_blocked"),
        F.count(F.lit(1)).alias("n_comments"))


def missing_topic_stats(df: DataFrame, topic_col: str = "Topic") -> DataFrame:
    """Rows without a topic (null or -1) out of all rows."""
    t = F.coalesce(F.col(topic_col), F.lit(OUTLIER_TOPIC))
    return df.agg(F.count_if(t == OUTLIER_TOPIC).alias("n_missing_topic"),
                  F.count(F.lit(1)).alias("n_rows"))


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column, long form (column_name, n_null)."""
    cols = df.columns
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return _long(row, cols, "n_null")


def null_fractions(df: DataFrame, digits: int = 6) -> DataFrame:
    """Share of nulls per column, long form (column_name, null_fraction)."""
    cols = df.columns
    row = df.agg(*[F.round(F.avg(F.col(c).isNull().cast("double")), digits).alias(c) for c in cols])
    return _long(row, cols, "null_fraction")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of identical rows (one row)."""
    row = uniqueness(df)
    return row.select((F.col("n_rows") - F.col("n_distinct")).alias("n_duplicates"))


def uniqueness(df: DataFrame) -> DataFrame:
    """A10: (n_rows, n_distinct, is_unique) of whole rows (one row). It costs a
    shuffle of a digest of each row."""
    digest = F.sha2(F.to_json(F.struct(*df.columns)), 256)
    counted = df.select(digest.alias("__key")).groupBy("__key").agg(F.count(F.lit(1)).alias("__n"))
    sums = counted.agg(F.coalesce(F.sum("__n"), F.lit(0)).cast("bigint").alias("n_rows"),
                       F.count(F.lit(1)).alias("n_distinct"))
    return sums.withColumn("is_unique", F.col("n_rows") == F.col("n_distinct"))


def assert_no_duplicates(df: DataFrame) -> None:
    """A10 as a check that raises."""
    row = uniqueness(df).first()
    if not row["is_unique"]:
        raise AssertionError(f"{row['n_rows'] - row['n_distinct']} rows repeat another one")


def _long(row: DataFrame, cols: list[str], value_name: str) -> DataFrame:
    return row.unpivot([], cols, "column_name", value_name)
