"""Lazy access to the given parquet tables and the schemas of the logical
tables the jobs work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

GIVEN_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                "events", "documents", "embeddings", "pages", "benchmark", "labels",
                "conversations")

# Column lists of the logical tables (fixed values; names match the reference's
# sheets so a user of its workbook maps columns one to one).
COMMENT_COLS = ["conversation_id", "conv_message_id", "author_id", "written_date",
                "text_content", "final_state"]
REACTION_COLS = ["message_id", "total_views", "total_likes"]
ARTICLE_COLS = ["title", "published_date", "description", "canonical_url",
                "conversation_id", "thumbnail_url"]
HISTORY_COLS = ["user_id", "conversation_id", "message_id"]
DOC_TOPIC_COLS = ["Topic", "Document_description"]


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


DOC_TOPIC_SCHEMA = T.StructType([
    T.StructField("Topic", T.IntegerType(), True),
    T.StructField("Document_description", T.StringType(), True),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table; lazy, so column pruning and filters reach the scan."""
    if name not in GIVEN_TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
