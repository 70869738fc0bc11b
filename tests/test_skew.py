"""Hot keys: one conversation holds a third of all comments and one user a
third of the history. Results must equal the oracle on the same data, and
with broadcasts off AQE must split the skewed join."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from threadlens.oracle import BEST, COMMENTS_NB, COMPILED, COUNTS, JOINED_OUTER, RANKED, REPORT_CTES, TOPIC_MAP
from threadlens.plans import engagement as E, report as R, users as U
from threadlens.sources import fixtures as FX
from threadlens.sources.fixture_sql import with_ctes
from threadlens.testing import compare

HOT_CONVERSATION = "10"   # an article with a topic, so its rows reach the join
HOT_USER = "1"

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def skew_session(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _hot(df, key, value):
    third = F.abs(F.xxhash64(*df.columns)) % 3 == 0
    return df.withColumn(key, F.when(third, F.lit(value)).otherwise(F.col(key)))


def _tables(spark, tmp_path):
    paths = {}
    frames = {
        "comments": _hot(FX.comments(spark, SF_MID), "conversation_id", HOT_CONVERSATION),
        "reactions": FX.reactions(spark, SF_MID),
        "articles": FX.articles(spark, SF_MID),
        "doc_topic": FX.doc_topic(spark, SF_MID),
        "comments_history": _hot(FX.comments_history(spark, SF_MID), "user_id", HOT_USER),
    }
    for name, df in frames.items():
        paths[name] = str(tmp_path / name)
        # several files: AQE splits a skewed partition by ranges of map tasks
        df.repartition(8).write.parquet(paths[name])
    return {k: spark.read.parquet(p) for k, p in paths.items()}, paths


def _duckdb(paths):
    import duckdb

    con = duckdb.connect()
    for name, p in paths.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p}/*.parquet')")
    return con


def test_hot_conversation_and_user(skew_session, tmp_path):
    spark = skew_session
    t, paths = _tables(spark, tmp_path)
    con = _duckdb(paths)
    hot_share = t["comments"].filter(F.col("conversation_id") == HOT_CONVERSATION).count() / t["comments"].count()
    assert hot_share > 0.3

    compiled = E.compile_engagement(t["comments"], t["reactions"], t["articles"], t["doc_topic"])
    res = compare(compiled, con, with_ctes([], "SELECT * FROM compiled", [COMMENTS_NB, JOINED_OUTER, COMPILED]))
    assert res["values_match"], res
    plan = compiled._jdf.queryExecution().executedPlan().toString().replace(" ", "")
    assert "skew=true" in plan or "isSkewJoin=true" in plan, plan

    ranked = U.user_conversation_rank(t["comments_history"])
    res = compare(ranked, con, with_ctes([], "SELECT * FROM ranked", [COUNTS, RANKED]))
    assert res["values_match"], res


def test_hot_keys_in_report_and_users(skew_session, tmp_path):
    spark = skew_session
    t, paths = _tables(spark, tmp_path)
    con = _duckdb(paths)
    compiled = E.compile_engagement(t["comments"], t["reactions"], t["articles"], t["doc_topic"])
    top = R.top_comments(compiled)
    res = compare(top, con, with_ctes([], "SELECT * FROM top_comments", REPORT_CTES))
    assert res["values_match"], res
    per_user = U.top_topic_per_user(t["comments_history"], top)
    res = compare(per_user, con, with_ctes([], "SELECT * FROM per_user",
                                           REPORT_CTES + [COUNTS, RANKED, TOPIC_MAP, BEST]))
    assert res["values_match"], res
