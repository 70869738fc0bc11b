"""Bucketed hand-offs: no shuffle where they are joined and grouped, loads add
up, and a session that didn't write them can open them."""

import pytest

from conftest import SF_SMALL
from threadlens.plans import engagement as E, users as U
from threadlens.sources import fixtures as FX
from threadlens.sources.buckets import (COUNT_KEYS, append_bucketed, forget_bucketed, load_user_counts, open_bucketed,
                                        user_counts_of_loads)


@pytest.fixture(scope="module")
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def messages(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("handoffs")
    return (append_bucketed(FX.comments(spark, SF_SMALL), f"{base}/comments", ["conv_message_id"], 6),
            append_bucketed(FX.reactions(spark, SF_SMALL), f"{base}/reactions", ["message_id"], 6))


@pytest.mark.parametrize("join", [E.comments_reactions_left, E.reactions_right_join])
def test_joins_of_hand_offs_do_not_shuffle(spark, no_broadcast, messages, join):
    assert "Exchange" in executed(join(FX.comments(spark, SF_SMALL), FX.reactions(spark, SF_SMALL)))
    plan = executed(join(*messages))
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_counts_of_loads(spark, no_broadcast, tmp_path):
    path = f"{tmp_path}/counts"
    rows = [("u%d" % (i % 5), "c%d" % (i % 3), str(i)) for i in range(60)] + [("hot", "c0", str(i)) for i in range(40)]
    history = spark.createDataFrame(rows, "user_id string, conversation_id string, message_id string")
    first, second = history.filter("message_id < '3'"), history.filter("message_id >= '3'")
    load_user_counts(first, path, 3)
    loads = load_user_counts(second, path, 3)
    got = user_counts_of_loads(loads)
    assert sorted(got.collect()) == sorted(U.user_conversation_counts(history).collect())
    assert "Exchange" not in executed(got)
    # a hot pair is one row a load, whatever its comments
    assert loads.filter("user_id = 'hot'").count() == 2


def test_opened_again(spark, tmp_path):
    path = f"{tmp_path}/it's a folder"
    counts = spark.createDataFrame([("a", "x", 2), (None, "y", 1)], "user_id string, conversation_id string, count long")
    written = append_bucketed(counts, path, COUNT_KEYS, 4)
    schema = written.schema
    forget_bucketed(spark, path)
    again = open_bucketed(spark.newSession(), path, schema, COUNT_KEYS, 4)
    assert sorted(again.collect(), key=str) == sorted(counts.collect(), key=str)
    empty = append_bucketed(counts.limit(0), f"{tmp_path}/empty", COUNT_KEYS, 4)
    assert empty.count() == 0 and empty.columns == counts.columns
