"""Connected components of an edge table, by repeated minimum labels and pointer jumping. Nothing reaches the driver but a flag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidespan.session import discard, store


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge; component is its least reachable node. Edges may repeat, loop, or be given one way."""
    one = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = store(one.union(one.select("v", "u")).distinct(), "edges")
    labels = store(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("component")).withColumnRenamed("u", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("component").alias("near"))
        hop = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", "component", F.least("component", "near").alias("m"))
        jump = labels.select(F.col("node").alias("m"), F.col("component").alias("far"))
        new = store(hop.join(jump, "m").select("node", F.least("m", "far").alias("component"), (F.least("m", "far") != F.col("component")).alias("_moved")), "labels")
        done = new.where("_moved").isEmpty()
        discard(labels)
        labels = new.drop("_moved")
        labels._stored_at = new._stored_at
        if done:
            discard(both)
            return labels
