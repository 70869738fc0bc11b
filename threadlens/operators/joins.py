"""Join operators.

No broadcast hints: small sides are broadcast by Spark when their measured
size is under ``spark.sql.autoBroadcastJoinThreshold`` (AQE re-checks it on the
real shuffle output), otherwise the join shuffles and AQE splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.sources.sinks import materialize


def join_keys(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
              how: str = "left") -> DataFrame:
    """Equi-join on differently named keys; both key columns are kept, as in a
    pandas merge with ``left_on``/``right_on`` (J1, J3, J5)."""
    return left.join(right, left[left_key] == right[right_key], how)


def join_on(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Equi-join on a shared key name; the key appears once."""
    return left.join(right, on=key, how=how)


def semi_join(df: DataFrame, keys: DataFrame, key: str, keys_key: str | None = None) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``keys``. The key side is reduced
    to distinct keys first (partial aggregation), so a hot key on that side
    costs one row per map task."""
    k = keys.select(F.col(keys_key or key).alias(key)).distinct()
    return df.join(k, on=key, how="left_semi")


def key_overlap(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Number of distinct key values present on both sides (one row)."""
    both = left.select(F.col(left_key).alias("k")).intersect(right.select(F.col(right_key).alias("k")))
    return both.agg(F.count(F.lit(1)).alias("overlap"))


def positional_align(left: DataFrame, left_col: str, right: DataFrame, right_col: str,
                     left_order: list[str], right_order: list[str],
                     left_name: str, right_name: str) -> DataFrame:
    """Put two columns side by side by position; the shorter one is padded
    with nulls. Positions come from a distributed index (see ``with_position``),
    then a full outer join on the position."""
    a = with_position(left.select(left_col, *[c for c in left_order if c != left_col]), left_order)
    b = with_position(right.select(right_col, *[c for c in right_order if c != right_col]), right_order)
    a = a.select("position", F.col(left_col).alias(left_name))
    b = b.select("position", F.col(right_col).alias(right_name))
    return a.join(b, "position", "full")


def with_position(df: DataFrame, order: list[str]) -> DataFrame:
    """1-based position of each row in ``order`` without moving all rows to one
    task: range-sort, count rows per partition, turn the (few) partition counts
    into offsets, add the offset to the index inside the partition."""
    sorted_df = df.orderBy(*order)
    tagged = (sorted_df
              .withColumn("__pid", F.spark_partition_id())
              .withColumn("__mid", F.monotonically_increasing_id()))
    tagged = materialize(tagged, "positions")  # pin the ids: later scans see the same rows
    counts = tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(
        "__pid",
        (F.sum("__n").over(_all_partitions_window()) - F.col("__n")).alias("__off"))
    local = F.col("__mid") - F.shiftleft(F.col("__pid").cast("bigint"), 33)
    # one row per partition: without the hint the rows would be shuffled to meet it
    out = tagged.join(F.broadcast(offsets), "__pid").withColumn("position", F.col("__off") + local + 1)
    return out.drop("__pid", "__mid", "__off")


def _all_partitions_window():
    from pyspark.sql import Window

    # one row per partition only: this window sees #partitions rows
    return Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
