"""Coverage that grows: a stream of intervals kept as deltas of depth by tile of their start, each interval counted once.

State is a table of deltas (contig, pos, d) on disk. Each micro-batch is appended under its own number, so that a batch
that runs again replaces itself; readers add up what is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidespan.operators.intervals import deltas, runs_of_deltas


def append_batch(path: str, keys: list[str]):
    def write(batch: DataFrame, batch_id: int) -> None:
        deltas(batch, keys).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def start(stream: DataFrame, path: str, checkpoint: str, keys: list[str]):
    """A running query that keeps path up to date. Each batch is pre-aggregated to net changes before it is written."""
    return stream.writeStream.foreachBatch(append_batch(path, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_runs(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Depth runs of everything counted so far; partial answers while the stream goes on."""
    changes = spark.read.parquet(f"{path}/batch=*").groupBy(*keys, "pos").agg(F.sum("d").alias("d")).where("d <> 0")
    return runs_of_deltas(changes, keys)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours", ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """Events by kind and tumbling window, dropped when later than the watermark (a stream) or not at all (a table)."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    w = F.window(ts, width)
    return events.groupBy(w.alias("w"), F.col(kind)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")
