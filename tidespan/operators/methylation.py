"""Methylation over stretches: smoothed columns of a window, stretches that differ between haplotypes, and differences of islands between samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidespan.operators.intervals import point_join, ranked

#: Sites of a smoothed column, how far they may lie, calls below which it is pale; sites in a row, difference and calls of a stretch; calls at a site in both samples, and sites of an island.
COLUMN_SITES, COLUMN_REACH, PALE = 6, 1000, 3
RUN, DIFFERENCE, RUN_CALLS = 5, 0.5, 10
PAIRED_CALLS, ISLAND_SITES = 5, 3
CHUNK = 1024


def smoothed(sites: DataFrame, columns: DataFrame, on: str) -> DataFrame:
    """(on, px, sites, calls, share, pale) of columns (on, px, a, b) over sites (on, pos, m, t): modified calls over all calls of the sites under a column; with fewer than six of them the nearest ones beside it, of equals the left one, up to six and within 1,000 bases. Columns without any site are left out."""
    near = F.explode(F.sequence(F.floor((F.col("a") - COLUMN_REACH) / COLUMN_REACH), F.floor((F.col("b") - 1 + COLUMN_REACH) / COLUMN_REACH)))
    asked = columns.withColumn("_bin", near)
    hit = asked.join(sites.select(on, "pos", "m", "t", F.floor(F.col("pos") / COLUMN_REACH).alias("_bin")), [on, "_bin"])
    far = F.when(F.col("pos") < F.col("a"), F.col("a") - F.col("pos")).when(F.col("pos") >= F.col("b"), F.col("pos") - F.col("b") + 1).otherwise(0)
    hit = hit.withColumn("_far", far).where(F.col("_far") <= COLUMN_REACH)
    k = F.row_number().over(Window.partitionBy(on, "px").orderBy("_far", "pos"))
    kept = hit.withColumn("_k", k).where((F.col("_far") == 0) | (F.col("_k") <= COLUMN_SITES))
    out = kept.groupBy(on, "px").agg(F.count(F.lit(1)).alias("sites"), F.sum("t").alias("calls"), F.sum("m").alias("_m"))
    return out.select(on, "px", "sites", "calls", F.try_divide(F.col("_m").cast("double"), F.col("calls")).alias("share"), (F.col("calls") < PALE).alias("pale"))


def allele_specific(sites: DataFrame, on: str) -> DataFrame:
    """(on, ps, s, e, sites, share1, share2) of stretches where the haplotypes differ: five sites in a row, of one phase set and covered on both haplotypes, whose pooled shares differ by half with ten calls on either side; runs of one sign that overlap are one stretch, with shares of its own sites.

    sites: (on, pos, ps, m1, t1, m2, t2), every site once. Neighbours are told by rank; runs are looked for in chunks of ranks that each hold the first sites of the next.
    """
    r = ranked(sites, [on], "pos").withColumn("_bad", (~((F.col("t1") > 0) & (F.col("t2") > 0) & F.col("ps").isNotNull())).cast("int"))
    chunk = F.floor(F.col("rank") / CHUNK)
    both = F.when(F.col("rank") % CHUNK < RUN - 1, F.array(chunk - 1, chunk)).otherwise(F.array(chunk))
    x = r.withColumn("_chunk", F.explode(both))
    ahead = Window.partitionBy(on, "_chunk").orderBy("rank").rowsBetween(0, RUN - 1)
    total = {c: F.sum(c).over(ahead) for c in ("m1", "t1", "m2", "t2")}
    x = x.withColumns({f"_{c}": v for c, v in total.items()} | {"_n": F.count(F.lit(1)).over(ahead), "_off": F.sum("_bad").over(ahead), "_low": F.min("ps").over(ahead), "_high": F.max("ps").over(ahead)})
    delta = F.col("_m1") / F.col("_t1") - F.col("_m2") / F.col("_t2")
    good = (F.floor(F.col("rank") / CHUNK) == F.col("_chunk")) & (F.col("_n") == RUN) & (F.col("_off") == 0) & (F.col("_low") == F.col("_high")) & (F.col("_t1") >= RUN_CALLS) & (F.col("_t2") >= RUN_CALLS)
    runs = x.where(good).where(F.abs(delta) >= DIFFERENCE).select(on, "ps", "rank", F.signum(delta).alias("sign"))
    # a run covers its rank and the next four: where two of one sign lie nearer than that they overlap
    w = Window.partitionBy(on, "ps", "sign").orderBy("rank")
    parts = runs.withColumn("_new", (F.col("rank") - F.lag("rank", 1, -RUN).over(w) >= RUN).cast("int")).withColumn("_part", F.sum("_new").over(w))
    spans = parts.groupBy(on, "ps", "sign", "_part").agg(F.min("rank").alias("_from"), (F.max("rank") + RUN).alias("_to"))
    inside = point_join(r.drop("ps"), spans, [on], "rank", ("_from", "_to"), 64)
    g = inside.groupBy(on, "ps", "sign", "_part").agg(F.min("pos").alias("s"), (F.max("pos") + 1).alias("e"), F.count(F.lit(1)).alias("sites"), *[F.sum(c).alias(c) for c in ("m1", "t1", "m2", "t2")])
    return g.select(on, "ps", "s", "e", "sites", (F.col("m1") / F.col("t1")).alias("share1"), (F.col("m2") / F.col("t2")).alias("share2"))


def island_differences(sites: DataFrame, islands: DataFrame, on: str, primary: str) -> DataFrame:
    """(island, sample, sites, share, other, difference) of islands (island, on, is_, ie) between the primary sample and each other one, by sites (sample, on, pos, m, t) with five calls in both: the mean of their shares, from three such sites on; difference is the primary's less the other's."""
    deep = sites.where(F.col("t") >= PAIRED_CALLS).withColumn("_share", F.col("m") / F.col("t"))
    own = deep.where(F.col("sample") == primary).select(on, "pos", F.col("_share").alias("_own"))
    pairs = deep.where(F.col("sample") != primary).join(own, [on, "pos"])
    hit = point_join(pairs, islands, [on], "pos", ("is_", "ie"), 512)
    g = hit.groupBy("island", "sample").agg(F.count(F.lit(1)).alias("sites"), F.avg("_own").alias("share"), F.avg("_share").alias("other"))
    return g.where(F.col("sites") >= ISLAND_SITES).withColumn("difference", F.col("share") - F.col("other"))
