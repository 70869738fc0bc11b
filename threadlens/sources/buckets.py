"""S4 as bucketed tables: a hand-off that later jobs join and group by its keys
without a shuffle (J1, J3, A5).

A table is a folder of parquet files, hashed into a fixed number of buckets by
its keys and sorted by them. The session's catalog only has to know its bucket
rule, so any session can open the folder again by ``open_bucketed``.

A bucket is read by one task, and no re-planning splits it. So the keys must be
ones that repeat little: message ids (unique in comments and in reactions), or
the (user, conversation) pairs of counts that were summed up before. A hot
conversation or user is no such key; joins on those stay ordinary joins.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from threadlens.plans.users import user_conversation_counts

#: Keys of the two hand-offs of counts and messages.
COUNT_KEYS = ["user_id", "conversation_id"]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _table_name(path: str) -> str:
    return "bucketed_" + hashlib.sha256(path.rstrip("/").encode()).hexdigest()[:16]


def open_bucketed(spark: SparkSession, path: str, schema: StructType, keys: list[str], n_buckets: int) -> DataFrame:
    """The bucketed table at ``path`` (made empty where there is none). Schema,
    keys and number of buckets must be those it was written with."""
    name = _table_name(path)
    columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    by = ", ".join(map(_quoted, keys))
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
              f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {n_buckets} BUCKETS LOCATION '{place}'")
    spark.catalog.refreshTable(name)  # files that another session added
    return spark.table(name)


def append_bucketed(df: DataFrame, path: str, keys: list[str], n_buckets: int) -> DataFrame:
    """Add the rows of ``df`` to the bucketed table at ``path`` and return the
    whole table. The one shuffle is paid here: it follows the bucket rule, so
    each task writes one file."""
    spark = df.sparkSession
    open_bucketed(spark, path, df.schema, keys, n_buckets)
    df.repartition(n_buckets, *keys).sortWithinPartitions(*keys).write.insertInto(_table_name(path))
    return open_bucketed(spark, path, df.schema, keys, n_buckets)


def forget_bucketed(spark: SparkSession, path: str) -> None:
    """Take the table out of the session's catalog; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {_table_name(path)}")


def load_user_counts(history: DataFrame, path: str, n_buckets: int) -> DataFrame:
    """Add one load of the comment history to the counts kept at ``path``: the
    load's A5 counts, so a pair has at most one row a load."""
    return append_bucketed(user_conversation_counts(history), path, COUNT_KEYS, n_buckets)


def user_counts_of_loads(loads: DataFrame) -> DataFrame:
    """A5 over all loads of ``load_user_counts``, without a shuffle."""
    return loads.groupBy(*COUNT_KEYS).agg(F.sum("count").alias("count"))
