"""Each user's most engaged conversation that has a topic.

Plan: one aggregate (user, conversation) → count, written once; dense rank of
the counts per user (over all conversations, before the topic filter, as in
the reference); topic per conversation from the report (largest Topic wins, as
the reference's dict built from ascending sheets does); first conversation with
a topic per user by (count desc, conversation_id asc), with a partial limit
before the shuffle; all users kept with a left join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.operators.ranking import dense_rank_desc, top_k_per_group
from threadlens.sources.sinks import materialize


def user_conversation_counts(history: DataFrame) -> DataFrame:
    """A5: comments per (user_id, conversation_id); the sentinel user is a group."""
    return history.groupBy("user_id", "conversation_id").agg(F.count(F.lit(1)).alias("count"))


def top_conversations(history: DataFrame) -> DataFrame:
    """O2: all (user, conversation) pairs, most comments first; ties by
    user_id, conversation_id. A range-partitioned sort."""
    return user_conversation_counts(history).orderBy(F.col("count").desc(), "user_id", "conversation_id")


def rank_conversations(counts: DataFrame) -> DataFrame:
    ranked = dense_rank_desc(counts, ["user_id"], "count", "rank")
    return ranked.select("user_id", "conversation_id", "count", F.col("rank").cast("int").alias("rank"))


def user_conversation_rank(history: DataFrame) -> DataFrame:
    """Counts with the dense rank (1 = most comments) per user."""
    return rank_conversations(user_conversation_counts(history))


def convo_topic_map(report_rows: DataFrame) -> DataFrame:
    """Topic per conversation from the report rows; the largest Topic wins."""
    return (report_rows.filter(F.col("conversation_id").isNotNull())
            .groupBy("conversation_id").agg(F.max(F.col("Topic").cast("int")).alias("topic")))


def top_topic_per_user(history: DataFrame, report_rows: DataFrame) -> DataFrame:
    """One row per user (user_id, conversation_id, count, rank, topic);
    users without a conversation that has a topic get nulls. The history is
    read once: the written counts also list its users."""
    counts = materialize(user_conversation_counts(history), "user_conversation_counts")
    with_topic = rank_conversations(counts).join(convo_topic_map(report_rows), "conversation_id")
    best = top_k_per_group(with_topic, ["user_id"], [F.col("count").desc(), F.col("conversation_id").asc()], 1)
    users = counts.select("user_id").distinct()
    return users.join(best, "user_id", "left").select("user_id", "conversation_id", "count", "rank", "topic")
