"""Logical input tables derived from the given test tables.

The reference reads a workbook with sheets for comments, reactions, articles
and comment history, plus a doc_topic file written by its topic model. The
given tables are mapped onto those sheets by fixed rules (FIXTURES.md §2);
``fixture_sql.py`` holds the same rules for DuckDB. Values come out as text
with nulls as the sentinel, exactly what ``read_cols`` yields, so every job
below sees the reference's data model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.functions.clean import OUTLIER_TOPIC, not_blocked
from threadlens.sources.readers import select_cols
from threadlens.sources.tables import table

# Fixed values of the fixture mapping. No row is dropped: keys that shall not
# meet are shifted instead.
KEY_SHIFT = 1_000_000_000      # moves a key out of the other side's range
REACTION_SHIFT_MODULUS = 7     # orders with o_orderkey % 7 = 0 react to no comment
ARTICLE_SHIFT_REMAINDER = 9    # documents with doc_id % 10 = 9 are articles without a comment
HOT_CONVERSATION = 5           # conversation of every event with event_id % 4 = 0
HOT_MODULUS = 4
USER_CONVERSATIONS = 7         # the other events of a user fall into 7 conversations
LIKES_MODULUS = 500            # total_likes = o_custkey % 500
PENDING_STATUS = "P"           # pending orders have likes 'missing'
ERROR_EVENT = "error"          # error events are the blocked comments
LABELS = 10                    # documents without an embedding have label doc_id % 10
OUTLIER_LABEL = 9              # embedding label that stands for the outlier topic
OTHER_MODEL_STEP = 3           # the second model moves the labels of even documents on by 3
HISTORY_SHIFT_MODULUS = 3      # users with user_id % 3 = 0 write in shifted conversations


def _conversation():
    k = F.get_json_object(F.col("props"), "$.k").cast("int")
    return F.when(F.col("event_id") % HOT_MODULUS == 0, F.lit(HOT_CONVERSATION)).otherwise(
        F.col("user_id") * USER_CONVERSATIONS + k % USER_CONVERSATIONS).cast("bigint")


def comments_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments before read_cols."""
    return _comments_of(table(spark, sf_dir, "events"))


def _comments_of(ev: DataFrame) -> DataFrame:
    return ev.select(
        _conversation().cast("string").alias("conversation_id"),
        F.col("event_id").cast("string").alias("conv_message_id"),
        F.col("user_id").cast("string").alias("author_id"),
        F.date_format(F.col("ts"), "yyyy-MM-dd HH:mm:ss").alias("written_date"),
        F.col("props").alias("text_content"),
        F.when(F.col("event_type") == ERROR_EVENT, F.lit("blocked"))
         .otherwise(F.col("event_type")).alias("final_state"),
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(comments_raw(spark, sf_dir))


def open_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments without the blocked ones. The filter is on the raw column, so
    the scan gets it (``PushedFilters``)."""
    ev = table(spark, sf_dir, "events").filter(not_blocked("event_type", ERROR_EVENT))
    return _texts(_comments_of(ev))


def reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    shift = F.when(F.col("o_orderkey") % REACTION_SHIFT_MODULUS == 0, F.lit(KEY_SHIFT)).otherwise(F.lit(0))
    return _texts(o.select(
        (F.col("o_orderkey") + shift).cast("string").alias("message_id"),
        F.format_string("%.2f", F.col("o_totalprice")).alias("total_views"),
        F.when(F.col("o_orderstatus") == PENDING_STATUS, F.lit("missing"))
         .otherwise((F.col("o_custkey") % LIKES_MODULUS).cast("string")).alias("total_likes"),
    ))


def articles_raw(spark: SparkSession, sf_dir: str, url: bool = True) -> DataFrame:
    """Articles before read_cols. Without ``url`` the pages table is not read
    (for jobs that use no URL)."""
    d = table(spark, sf_dir, "documents")
    if url:
        d = d.join(table(spark, sf_dir, "pages").select("page_id", "url"), F.col("doc_id") == F.col("page_id"), "left")
    else:
        d = d.withColumn("url", F.lit(None).cast("string"))
    shift = F.when(F.col("doc_id") % 10 == ARTICLE_SHIFT_REMAINDER, F.lit(KEY_SHIFT)).otherwise(F.lit(0))
    return d.select(
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("title"),
        F.lit(None).cast("string").alias("published_date"),
        F.col("text").alias("description"),
        F.col("url").alias("canonical_url"),
        (F.col("doc_id") + shift).cast("string").alias("conversation_id"),
        F.lit(None).cast("string").alias("thumbnail_url"),
    )


def articles(spark: SparkSession, sf_dir: str, url: bool = True) -> DataFrame:
    return _texts(articles_raw(spark, sf_dir, url))


def doc_topic(spark: SparkSession, sf_dir: str, other_model: bool = False) -> DataFrame:
    """One row per document text: the label of the smallest doc_id having that
    text (label 9 → -1). ``other_model`` gives the second model's labels."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    label = F.coalesce(F.col("label"), (F.col("doc_id") % LABELS).cast("int"))
    if other_model:
        label = F.when(F.col("doc_id") % 2 == 0, (label + OTHER_MODEL_STEP) % LABELS).otherwise(label)
    j = d.join(e, d.doc_id == e.vec_id, "left").select("doc_id", "text", label.alias("label"))
    # first label per text by doc_id: an aggregate (partial + final), no window
    first = j.groupBy("text").agg(F.min_by("label", "doc_id").alias("label"))
    return first.select(
        F.when(F.col("label") == OUTLIER_LABEL, F.lit(OUTLIER_TOPIC))
         .otherwise(F.col("label")).cast("int").alias("Topic"),
        F.col("text").alias("Document_description"),
    )


def comments_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    shift = F.when(F.col("user_id") % HISTORY_SHIFT_MODULUS == 0, F.lit(KEY_SHIFT)).otherwise(F.lit(0))
    return _texts(ev.select(
        F.col("user_id").cast("string").alias("user_id"),
        (_conversation() + shift).cast("string").alias("conversation_id"),
        F.col("event_id").cast("string").alias("message_id"),
    ))


def _texts(df: DataFrame) -> DataFrame:
    # what read_cols yields: the named columns, nulls as the sentinel, text
    return select_cols(df, df.columns)
