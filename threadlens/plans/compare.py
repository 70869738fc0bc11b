"""Comparing the outputs of two topic models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.operators.joins import positional_align
from threadlens.plans.engagement import text_key


def compare_models(main: DataFrame, other: DataFrame,
                   main_name: str = "main_model", other_name: str = "other_model") -> DataFrame:
    """The two models' document descriptions side by side by position
    (1-based, in description order); the shorter list is padded with null."""
    order = ["Document_description", "Topic"]
    return positional_align(main, "Document_description", other, "Document_description",
                            order, order, main_name, other_name)


def topic_coverage(doc_topics: dict[str, DataFrame], articles: DataFrame) -> DataFrame:
    """Per model, how many article rows get a topic (doc_topic RIGHT JOIN
    articles, rows without nulls, counted).

    Articles are counted by the digest of their text, then joined once with
    the digests of all models; a model without a match has a row of 0."""
    counted = articles.select(text_key("description").alias("__key")).groupBy("__key").agg(F.count(F.lit(1)).alias("__n"))
    models = None
    for name, dt in doc_topics.items():
        found = dt.filter(F.col("Topic").isNotNull()).select(
            text_key("Document_description").alias("__key"), F.lit(name).alias("__model"))
        models = found if models is None else models.unionByName(found)
    n_of = lambda name: F.coalesce(F.sum(F.when(F.col("__model") == name, F.col("__n"))), F.lit(0))
    sums = counted.join(models, "__key").agg(F.array(*[
        F.struct(F.lit(name).alias("model"), n_of(name).alias("n_articles_with_topic")) for name in doc_topics]).alias("rows"))
    return sums.select(F.inline("rows"))
