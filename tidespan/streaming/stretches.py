"""Counted stretches that grow, as a stream with state.

An interval belongs to the tile of its start. Each tile is a key with its state: net changes of depth at the tile's own
positions, and those that its intervals spill beyond its end. A micro-batch adds to the tiles it touches and gives their new
state; the sink keeps the last one of each tile, under the batch's number, so a batch that runs again replaces itself. Since
an interval has one owner, no split of the input into batches, restarts or tiles counts it twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidespan.operators.intervals import runs_of_deltas

TILE = 4096
STATE = "positions binary, changes binary, intervals long"
GROWN = "contig string, tile long, owned_pos array<long>, owned_d array<long>, spilled_pos array<long>, spilled_d array<long>, intervals long"


def added(positions: np.ndarray, changes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Net changes by position, without those that cancel."""
    at, which = np.unique(positions, return_inverse=True)
    total = np.zeros(len(at), np.int64)
    np.add.at(total, which.ravel(), changes)
    return at[total != 0], total[total != 0]


def grown(stream: DataFrame, tile: int = TILE) -> DataFrame:
    """The new state of every tile that a micro-batch of intervals (contig, s, e) touches."""

    def grow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pos, change, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        if state.exists:
            p, c, n = state.get
            pos, change = [np.frombuffer(p, np.int64)], [np.frombuffer(c, np.int64)]
        for b in batches:
            pos += [b["s"].to_numpy(np.int64), b["e"].to_numpy(np.int64)]
            change += [np.ones(len(b), np.int64), -np.ones(len(b), np.int64)]
            n += len(b)
        at, total = added(np.concatenate(pos), np.concatenate(change))
        state.update((at.tobytes(), total.tobytes(), n))
        own = at < (key[1] + 1) * tile
        yield pd.DataFrame({"contig": [key[0]], "tile": [key[1]], "owned_pos": [at[own]], "owned_d": [total[own]], "spilled_pos": [at[~own]], "spilled_d": [total[~own]], "intervals": [n]})

    rows = stream.where("s < e").select("contig", F.floor(F.col("s") / tile).cast("long").alias("tile"), F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))
    return rows.groupBy("contig", "tile").applyInPandasWithState(grow, GROWN, STATE, "update", GroupStateTimeout.NoTimeout)


def start(stream: DataFrame, path: str, checkpoint: str, tile: int = TILE):
    """A running query that takes what there is and keeps path up to date; start it again with the same checkpoint for more."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return grown(stream, tile).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tiles(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each tile: GROWN."""
    names = [f.split(" ")[0] for f in GROWN.split(", ")]
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    last = rows.groupBy("contig", "tile").agg(F.max_by(F.struct(*names[2:]), "batch").alias("x"))
    return last.select("contig", "tile", "x.*")


def stretch_runs(spark: SparkSession, path: str) -> DataFrame:
    """(contig, s, e, depth) of all that was counted: each tile's own changes and what others spill into it."""
    t = tiles(spark, path)
    part = lambda p, d: t.select("contig", F.inline(F.arrays_zip(F.col(p).alias("pos"), F.col(d).alias("d"))))
    both = part("owned_pos", "owned_d").toDF("contig", "pos", "d").unionByName(part("spilled_pos", "spilled_d").toDF("contig", "pos", "d"))
    return runs_of_deltas(both.groupBy("contig", "pos").agg(F.sum("d").alias("d")).where("d <> 0"), ["contig"])
