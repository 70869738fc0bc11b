"""Which article descriptions people engage with, and the compiled
comment/reaction/article/topic table of the report.

Inputs are the logical tables (text columns, nulls as the sentinel):
comments, reactions, articles, doc_topic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions.clean import clean_count, not_blocked, topic_or_outlier
from threadlens.operators.joins import join_keys, join_on
from threadlens.sources.sinks import materialize

# Column order of the compiled table (fixed: the report's layout).
COMPILED_COLS = ["title", "description", "published_date", "canonical_url", "thumbnail_url",
                 "Topic", "written_date", "conversation_id", "conv_message_id", "author_id",
                 "text_content", "final_state", "message_id", "total_views", "total_likes"]


def filter_blocked(comments: DataFrame) -> DataFrame:
    """P3."""
    return comments.filter(not_blocked("final_state"))


def comments_reactions_left(comments: DataFrame, reactions: DataFrame) -> DataFrame:
    """Non-blocked comments LEFT JOIN reactions on conv_message_id = message_id."""
    return join_keys(filter_blocked(comments), reactions, "conv_message_id", "message_id", "left")


def comments_articles_left(comments: DataFrame, reactions: DataFrame, articles: DataFrame) -> DataFrame:
    """J1 then J2: ... LEFT JOIN articles on conversation_id (the reference's
    chain before ``dropna``)."""
    return join_on(comments_reactions_left(comments, reactions), articles, "conversation_id", "left")


def text_key(c) -> Column:
    """Digest that stands for a whole text in joins and aggregates (SURVEY's
    hash key for J5): equal digests are equal texts."""
    return F.sha2(F.col(c) if isinstance(c, str) else c, 256)


def with_article_key(articles: DataFrame) -> DataFrame:
    """Articles with ``article_key``, a digest of the whole row: it travels
    through joins and windows in place of the article's texts."""
    return articles.withColumn("article_key", text_key(F.to_json(F.struct(*articles.columns))))


def engaged_descriptions(comments: DataFrame, reactions: DataFrame, articles: DataFrame) -> DataFrame:
    """Distinct descriptions of articles that have a non-blocked comment
    with a reaction.

    The reference left-joins comments, reactions and articles and drops rows
    with any null; inputs carry no nulls (sentinel), so that keeps exactly the
    matched rows, and only ``description`` is used: two semi joins and a
    distinct. Written this way Catalyst reads three columns and shuffles only
    keys (it does not turn ``dropna`` over outer joins into this itself)."""
    reacted = filter_blocked(comments).select("conversation_id", "conv_message_id").join(
        reactions.select(F.col("message_id").alias("conv_message_id")).distinct(),
        "conv_message_id", "left_semi")
    convs = reacted.select("conversation_id").distinct()
    return (articles.select("conversation_id", "description")
            .join(convs, "conversation_id", "left_semi")
            .select("description").distinct())


def reactions_right_join(comments: DataFrame, reactions: DataFrame) -> DataFrame:
    """Non-blocked comments RIGHT JOIN reactions (keeps reactions without
    a comment)."""
    return join_keys(filter_blocked(comments), reactions, "conv_message_id", "message_id", "right")


def description_topic_join(articles: DataFrame, doc_topic: DataFrame) -> DataFrame:
    """Articles LEFT JOIN doc_topic on description = Document_description.
    The join key is the texts' digest, so only the articles carry their text."""
    topics = doc_topic.select("Topic", text_key("Document_description").alias("__key"))
    keyed = articles.withColumn("__key", text_key("description"))
    j = keyed.join(topics.withColumn("__found", F.lit(True)), "__key", "left")
    return j.withColumn("Document_description", F.when(F.col("__found"), F.col("description"))).drop("__key", "__found")


def topics_of_articles(articles: DataFrame, doc_topic: DataFrame) -> DataFrame:
    """(conversation_id, title, Topic, article_key) of the articles that have
    a topic of 0 or more; no long text."""
    topics = doc_topic.filter(F.col("Topic") >= 0).select("Topic", text_key("Document_description").alias("__key"))
    return (with_article_key(articles)
            .select("conversation_id", "title", "article_key", text_key("description").alias("__key"))
            .join(topics, "__key").drop("__key"))


def joined_outer(comments: DataFrame, reactions: DataFrame, articles: DataFrame,
                 doc_topic: DataFrame) -> DataFrame:
    """J3–J5 as written by the reference (outer joins). Reactions without a
    comment have no key for the later joins: they are split off first and
    united at the end, instead of meeting in one task as null keys."""
    open_comments = filter_blocked(comments)
    matched = join_keys(open_comments, reactions, "conv_message_id", "message_id", "inner")
    lone = reactions.join(open_comments.select(F.col("conv_message_id").alias("message_id")), "message_id", "left_anti")
    j = description_topic_join(join_on(matched, articles, "conversation_id", "left"), doc_topic)
    return j.unionByName(lone, allowMissingColumns=True)


def topic_of_reactions(comments: DataFrame, reactions: DataFrame, articles: DataFrame,
                       doc_topic: DataFrame) -> DataFrame:
    """One row (Topic) for each row of ``joined_outer``: keys only."""
    keys = articles.select("conversation_id", text_key("description").alias("__key"))
    topics = doc_topic.select("Topic", text_key("Document_description").alias("__key"))
    comments = filter_blocked(comments).select("conversation_id", "conv_message_id")
    reactions = reactions.select("message_id")
    matched = join_keys(comments, reactions, "conv_message_id", "message_id", "inner").select("conversation_id")
    lone = reactions.join(comments.select(F.col("conv_message_id").alias("message_id")), "message_id", "left_anti")
    known = matched.join(keys.join(topics, "__key", "left").drop("__key"), "conversation_id", "left").select("Topic")
    return known.unionByName(lone.select(F.lit(None).cast("int").alias("Topic")))


#: What ``compile_keys`` keeps of a comment and its reaction, and of its article.
KEY_COLS = ["article_key", "title", "Topic", "written_date", "conversation_id", "conv_message_id", "author_id",
            "text_content", "final_state", "message_id", "total_views", "total_likes"]


def compile_keys(comments: DataFrame, reactions: DataFrame, articles: DataFrame, doc_topic: DataFrame) -> DataFrame:
    """D2 without the article's texts: rows with a topic (>= 0), counts
    cleaned, the article as its key.

    ``Topic >= 0`` removes every row an outer join would add, so the data
    path is inner joins, ordered small-first: articles with a topic, then the
    comments of those conversations, then their reactions. The big
    comment-reaction join only sees comments of topic'd articles."""
    with_comments = join_on(filter_blocked(comments), topics_of_articles(articles, doc_topic), "conversation_id", "inner")
    j = join_keys(with_comments, reactions, "conv_message_id", "message_id", "inner")
    return j.select(*[
        topic_or_outlier("Topic").alias("Topic") if c == "Topic"
        else clean_count(c).alias(c) if c in ("total_views", "total_likes")
        else F.col(c)
        for c in KEY_COLS])


def _complete(rows: DataFrame, keyed: DataFrame) -> DataFrame:
    found = keyed.drop("title", "conversation_id").dropDuplicates(["article_key"])
    return rows.join(found, "article_key").select(*COMPILED_COLS)


def with_articles(rows: DataFrame, articles: DataFrame) -> DataFrame:
    """Some rows of ``compile_keys`` with their article's columns, in report order.

    The rows (no text) are written first, so their keys have a known size:
    where it is small the articles are filtered before any shuffle, and only
    the texts of kept articles travel."""
    rows = materialize(rows, "kept-rows")
    kept = articles.join(rows.select("conversation_id").distinct(), "conversation_id", "left_semi")
    keyed = with_article_key(kept.select(*articles.columns))
    return _complete(rows, keyed.join(rows.select("article_key").distinct(), "article_key", "left_semi"))


def compile_engagement(comments: DataFrame, reactions: DataFrame, articles: DataFrame,
                       doc_topic: DataFrame) -> DataFrame:
    """Rows with a topic (>= 0), counts cleaned, 15 columns in report order."""
    return _complete(compile_keys(comments, reactions, articles, doc_topic), with_article_key(articles))


def compile_engagement_outer(comments: DataFrame, reactions: DataFrame, articles: DataFrame,
                             doc_topic: DataFrame) -> DataFrame:
    """D2 written literally (outer joins, then the filter). Same result as
    ``compile_engagement``; kept as the reference form for tests."""
    j = joined_outer(comments, reactions, articles, doc_topic)
    j = j.withColumn("Topic", topic_or_outlier("Topic")).filter(F.col("Topic") >= 0)
    return j.select(*[
        clean_count(c).alias(c) if c in ("total_views", "total_likes") else F.col(c)
        for c in COMPILED_COLS])


def clean_reaction_counts(reactions: DataFrame) -> DataFrame:
    """P8 on the reactions table."""
    return reactions.select("message_id", clean_count("total_views").alias("total_views"),
                            clean_count("total_likes").alias("total_likes"))
