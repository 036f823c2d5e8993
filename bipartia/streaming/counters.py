"""Counters over a stream of events: each file that arrives is added to windowed totals."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bipartia.sources.tables import shared_dir


def window_counts(events: DataFrame, late: str = "2 hours", size: str = "1 day") -> DataFrame:
    """Streaming: events and total value for each window and type. Events later than ``late`` may be left out."""
    at = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    out = at.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("begins"), "event_type", "n", "total")


def run_once(counts: DataFrame, spark: SparkSession) -> DataFrame:
    """Run a streaming aggregate over what has arrived, with state and progress in the shared folder, and read its table.

    Each batch stores the windows that it changed; the last state of a window is its total. Windows that the watermark has
    passed are dropped from the state, which stays as large as the windows still open.
    """
    at = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/table/batch={number}")

    query = counts.writeStream.outputMode("update").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).foreachBatch(store).start()
    query.awaitTermination()
    keys = [c for c in counts.columns if c not in ("n", "total")]
    last = F.max_by(F.struct("n", "total"), "batch").alias("x")
    return spark.read.parquet(f"{at}/table").groupBy(*keys).agg(last).select(*keys, "x.*")
