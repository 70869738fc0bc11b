"""Writers. Output goes to a shared location (parquet or CSV with a
header); the per-topic "sheets" are one partition folder per topic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from threadlens.functions.clean import sheet_name


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write a result (doc_topic, topic summary, ...)."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w = w.option("header", "true")
    w.format(fmt).save(path)
    return path


def write_topic_sheets(df: DataFrame, path: str, topic_col: str = "Topic") -> str:
    """One "sheet" per topic. The sheet name is the trimmed topic text cut
    to 31 characters; rows with a null or blank name are skipped. The plan runs
    once; that it wrote a sheet is checked on the written folder."""
    named = (df.withColumn("sheet_name", sheet_name(topic_col))
               .filter(F.col("sheet_name").isNotNull() & (F.col("sheet_name") != "")))
    # no repartition by topic: a large topic would land in one task; each task
    # writes its own file per topic folder instead
    named.write.mode("overwrite").partitionBy("sheet_name").parquet(path)
    if read_topic_sheets(df.sparkSession, path, named.schema).isEmpty():
        raise ValueError("no sheet was written: no row has a topic")
    return path


def read_topic_sheets(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Read the sheets back. With ``schema`` (the written frame's schema) the
    folder name ``sheet_name`` stays text instead of being inferred."""
    reader = spark.read
    if schema is not None:
        fields = [f for f in schema.fields if f.name != "sheet_name"]
        reader = reader.schema(StructType(fields + [StructField("sheet_name", StringType(), True)]))
    return reader.parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    For an intermediate result that several branches of a job read: the
    branches scan the written table (with column pruning) instead of each
    recomputing its joins, and the lineage is cut, so a lost executor costs a
    re-read rather than a recomputation."""
    from threadlens.session import scratch_path

    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
