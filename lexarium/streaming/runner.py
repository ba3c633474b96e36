"""Structured Streaming over files of events: windowed counts with a watermark, and running state per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F


def events(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Events as they arrive; zone-less times are read in the session's zone, as watermarks need it."""
    found = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by event-time window; rows later than the watermark are dropped by design."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n")


def running_pairs(stream: DataFrame) -> DataFrame:
    """Running (user_id, event_type) counts in state, one row an update."""

    def step(key, frames: Iterator[pd.DataFrame], state):
        n = (state.get[0] if state.exists else 0) + sum(len(p) for p in frames)
        state.update((n,))
        yield pd.DataFrame({"user_id": [key[0]], "event_type": [key[1]], "n": [n]})

    return stream.groupBy("user_id", "event_type").applyInPandasWithState(step, "user_id long, event_type string, n long", "n long", "update", "NoTimeout")


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Process what is there into a table in memory, then stop: for looking at small streams."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def run_to_files(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Process what is there into Parquet files, exactly once: the sink's log and the checkpoint make a rerun take only new input."""
    stream.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_updates(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Process what is there, one folder of updated rows for each batch; a batch that is run again replaces its own."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{folder}/n{batch:09d}")

    stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def latest(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The last update of each key of a folder that ``run_updates`` filled."""
    rows = spark.read.parquet(f"{folder}/*")
    return rows.groupBy(*keys).agg(*(F.max_by(c, "batch").alias(c) for c in rows.columns if c not in (*keys, "batch")))
