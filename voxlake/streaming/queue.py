"""Structured Streaming over patches: each micro-batch is a buffer that is shuffled by hash and drained."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery


def shuffled(batch: DataFrame, batch_id: int, seed: int, keys: list[str]) -> DataFrame:
    """The batch with its buffer number and each row's place in it."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))
    return batch.withColumn("buffer", F.lit(batch_id).cast("long")).withColumn("place", F.row_number().over(Window.partitionBy("buffer").orderBy(order, *keys)) - 1)


def patch_queue(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, *, keys: list[str], seed: int = 0, files_per_buffer: int = 1) -> StreamingQuery:
    """Reads patch files as they come, files_per_buffer at a time, and writes every shuffled buffer once.

    A batch that is run again after a failure overwrites its own folder, so each patch is written once.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_buffer).parquet(source)

    def drain(batch: DataFrame, batch_id: int) -> None:
        shuffled(batch, batch_id, seed, keys).write.mode("overwrite").parquet(f"{sink}/buffer={batch_id}")

    return stream.writeStream.foreachBatch(drain).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, *, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of an event stream by window and type, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def event_counts(events: DataFrame, folder: str, **params) -> StreamingQuery:
    """Runs event_windows over all that an event stream has; folder/counts holds the counts after each micro-batch, all windows of them.

    A batch that is run again overwrites the same table, so nothing is counted twice.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/counts")

    counted = event_windows(events, **params).writeStream.outputMode("complete").foreachBatch(store)
    return counted.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
