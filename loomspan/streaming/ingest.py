"""Streaming forms of ingestion; the running fold's is :func:`loomspan.operators.folds.fold_stream`.

The batch operators define the results; these bring the same rows in as they arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def records_stream(
    spark: SparkSession, path: str, schema: str, watermark: str | None = None, ts: str = "ts"
) -> DataFrame:
    """Parquet files as they appear, each trial once.

    With a watermark the state of ids older than it is dropped; without, every id is kept,
    which only a bounded set of trials allows.
    """
    stream = spark.readStream.schema(schema).parquet(path)
    if watermark:
        return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["trial_id"])
    return stream.dropDuplicates(["trial_id"])


def new_only(batch: DataFrame, done: DataFrame) -> DataFrame:
    """Idempotent append for ``foreachBatch``: ids already stored are left out."""
    return batch.dropDuplicates(["trial_id"]).join(done.select("trial_id"), "trial_id", "left_anti")


def event_counts(events: DataFrame, ts: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Windowed counts and exact sums; rows later than ``late`` are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), "event_type").agg(
        F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(20,6)")).alias("total")
    )
