"""Property tests of SURVEY §5 on the given tables (sf0.001)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from threadlens.catalog import QUERIES
from threadlens.operators.density import density_clusters
from threadlens.plans import engagement as E
from threadlens.sources import fixtures as FX


def test_top_comments_at_most_four_per_conversation(spark):
    top = QUERIES["top_comments"](spark, SF_SMALL)
    assert top.groupBy("conversation_id").count().filter("count > 4").count() == 0
    assert top.groupBy("conversation_id", "conv_message_id").count().filter("count > 1").count() == 0


def test_dense_rank_has_no_gaps(spark):
    ranked = QUERIES["user_conversation_rank"](spark, SF_SMALL)
    per_user = ranked.groupBy("user_id").agg(F.max("rank").alias("m"),
                                             F.count_distinct("rank").alias("d"),
                                             F.count_distinct("count").alias("c"))
    assert per_user.filter("m <> d OR d <> c").count() == 0
    w = Window.partitionBy("user_id").orderBy(F.col("rank"))
    bad = ranked.withColumn("prev", F.lag("count").over(w)).filter("prev < count")
    assert bad.count() == 0


def test_topic_sheets_read_back_equal_input(spark):
    sheets = QUERIES["topic_sheets"](spark, SF_SMALL)
    report = QUERIES["topic_report"](spark, SF_SMALL)
    assert sorted(map(tuple, sheets.select(*report.columns).collect()), key=str) == \
        sorted(map(tuple, report.collect()), key=str)


def test_engaged_descriptions_have_reacted_comments(spark):
    c, r, a = FX.comments(spark, SF_SMALL), FX.reactions(spark, SF_SMALL), FX.articles(spark, SF_SMALL)
    engaged = E.engaged_descriptions(c, r, a)
    support = (E.filter_blocked(c).join(r, F.col("conv_message_id") == F.col("message_id"))
               .join(a, "conversation_id").select("description").distinct())
    assert engaged.subtract(support).count() == 0 and support.subtract(engaged).count() == 0


def test_density_clusters_stable_under_input_order_and_sizes(spark):
    pts = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    kw = dict(block_size=32, cell_target=64, max_pivots=16)
    a = dict(density_clusters(pts, 1.2, 5, 5, **kw).collect())
    shuffled = pts.repartition(7, F.rand(11))
    b = dict(density_clusters(shuffled, 1.2, 5, 5, **kw).collect())
    assert a == b
    sizes = {}
    for label in a.values():
        sizes[label] = sizes.get(label, 0) + 1
    assert all(n >= 5 for label, n in sizes.items() if label != -1)
