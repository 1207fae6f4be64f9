"""Reads and coverage kept as columns: reads in order of position, so that a range is read from the row groups it touches; coverage runs as differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_reads(reads: DataFrame, path: str) -> None:
    """reads (contig, s, e, ...) ordered by contig and start, and the longest read of each contig beside them."""
    reads.repartitionByRange("contig", "s").sortWithinPartitions("contig", "s", "e").write.parquet(f"{path}/reads")
    reads.groupBy("contig").agg(F.max(F.col("e") - F.col("s")).alias("longest")).write.parquet(f"{path}/longest")


def read_range(spark, path: str, contig: str, start: int, end: int) -> DataFrame:
    """The reads that overlap [start, end) of a contig. A read begins no further before the range than the longest one is long, so both bounds of the start reach the scan, and files and row groups outside are skipped."""
    longest = spark.read.parquet(f"{path}/longest").where(F.col("contig") == contig).first()
    reads = spark.read.parquet(f"{path}/reads")
    if longest is None:
        return reads.limit(0)
    near = (F.col("contig") == contig) & (F.col("s") < end) & (F.col("s") > start - int(longest["longest"]))
    return reads.where(near & (F.col("e") > start))


BLOCK = 4096


def encoded_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block, first, gaps, lengths, steps) of depth runs (keys, s, e, depth): by blocks of starts, the gap before each run, its length and how its depth differs from the run before, so that numbers are small."""
    w = Window.partitionBy(*keys, "block").orderBy("s")
    x = runs.withColumn("block", F.floor(F.col("s") / BLOCK))
    x = x.withColumns({"gap": F.coalesce(F.col("s") - F.lag("e").over(w), F.lit(0)), "step": F.col("depth") - F.coalesce(F.lag("depth").over(w), F.lit(0))})
    part = F.sort_array(F.collect_list(F.struct("s", "gap", (F.col("e") - F.col("s")).alias("length"), "step"))).alias("_r")
    lists = x.groupBy(*keys, "block").agg(part)
    take = lambda c: F.transform("_r", lambda r: r[c])
    return lists.select(*keys, "block", F.get("_r", F.lit(0))["s"].alias("first"), take("gap").alias("gaps"), take("length").alias("lengths"), take("step").alias("steps"))


def decoded_runs(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """The runs that encoded_runs() was given."""
    both = F.arrays_zip("gaps", "lengths", "steps")
    x = blocks.select(*keys, "block", "first", F.posexplode(both).alias("i", "r"))
    w = Window.partitionBy(*keys, "block").orderBy("i")
    end = F.col("first") + F.sum(F.col("r.gaps") + F.col("r.lengths")).over(w)
    return x.select(*keys, (end - F.col("r.lengths")).cast("int").alias("s"), end.cast("int").alias("e"), F.sum("r.steps").over(w).alias("depth"))
