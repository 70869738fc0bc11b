"""A5 over a file stream: the batch operator applied to a streaming frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from threadlens.plans.users import user_conversation_counts
from threadlens.sources.readers import select_cols
from threadlens.sources.tables import HISTORY_COLS


def user_conversation_counts_stream(spark: SparkSession, history_dir: str, schema: StructType,
                                    fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming frame of (user_id, conversation_id, count) over the files
    arriving in ``history_dir`` (a declared schema is required for streams)."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return user_conversation_counts(select_cols(reader.load(history_dir), HISTORY_COLS))


def start_user_conversation_counts(spark: SparkSession, history_dir: str, schema: StructType,
                                   sink, checkpoint_location: str,
                                   output_mode: str = "update", available_now: bool = True) -> StreamingQuery:
    """Start the query; ``sink(batch_df, batch_id)`` receives the changed
    counts of each micro-batch (``foreachBatch``). ``checkpoint_location`` is a
    lasting shared folder: a restart goes on from it."""
    counts = user_conversation_counts_stream(spark, history_dir, schema)
    writer = (counts.writeStream.outputMode(output_mode).foreachBatch(sink)
              .option("checkpointLocation", checkpoint_location))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
