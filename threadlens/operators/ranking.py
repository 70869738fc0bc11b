"""Order-dependent operators with an explicit, total order.

pandas keeps row order and breaks ties by it; Spark has no row order, so each
operator takes the full order it must follow.

Skew: ``top_k_per_group`` filters ``row_number() <= k`` right next to the
window, which Catalyst turns into a partial per-group limit *before* the
shuffle (``WindowGroupLimit Partial``), so a group holding a third of all rows
sends at most ``k`` rows per map task. ``dense_rank_desc`` ranks the distinct
values of a group instead of its rows, so a hot group costs at most
``sqrt(2 * rows)`` entries in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(df: DataFrame, group_cols: list[str], order: list[Column], k: int,
                    rank_col: str | None = None) -> DataFrame:
    """Rows with the ``k`` first positions of ``order`` inside each group."""
    w = Window.partitionBy(*group_cols).orderBy(*order)
    name = rank_col or "__rn"
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
    return out if rank_col else out.drop(name)


def keep_first(df: DataFrame, key_cols: list[str], order: list[Column]) -> DataFrame:
    """First row of each key by ``order`` (not ``dropDuplicates``,
    which keeps an arbitrary row)."""
    return top_k_per_group(df, key_cols, order, 1)


def dense_rank_desc(df: DataFrame, group_cols: list[str], value_col: str,
                    rank_col: str = "rank") -> DataFrame:
    """Dense rank of ``value_col`` (largest = 1) within each group.

    Ranks the distinct (group, value) pairs and joins the rank back; the
    join is a many-to-one equi-join whose hot keys AQE splits."""
    levels = df.select(*group_cols, value_col).distinct()
    w = Window.partitionBy(*group_cols).orderBy(F.col(value_col).desc())
    ranked = levels.withColumn(rank_col, F.row_number().over(w))
    return df.join(ranked, [*group_cols, value_col], "inner")
