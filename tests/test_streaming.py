from pyspark.sql import functions as F

from conftest import SF_SMALL
from threadlens.plans.users import user_conversation_counts
from threadlens.sources import fixtures as FX
from threadlens.streaming import start_user_conversation_counts


def test_stream_counts_equal_batch(spark, tmp_path):
    hist = FX.comments_history(spark, SF_SMALL)
    src = str(tmp_path / "history")
    # two arrivals of files
    hist.filter(F.col("message_id").cast("long") % 2 == 0).write.parquet(src + "/part=0")
    hist.filter(F.col("message_id").cast("long") % 2 == 1).write.parquet(src + "/part=1")
    seen = {}

    def sink(batch, _bid):
        for r in batch.collect():
            seen[(r.user_id, r.conversation_id)] = r["count"]

    q = start_user_conversation_counts(spark, src + "/*", hist.schema, sink,
                                       checkpoint_location=str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    want = {(r.user_id, r.conversation_id): r["count"] for r in user_conversation_counts(hist).collect()}
    assert seen == want
