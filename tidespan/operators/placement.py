"""Placement of clipped read ends on reference windows, by 20-mers that occur once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bases of the seed, bases compared at most, bases for each of which one mismatch is let pass.
SEED, PROBE, EDIT_EVERY = 20, 60, 20


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTN", "TGCAN")


def place_clips(clips: DataFrame, windows: DataFrame, on: str) -> DataFrame:
    """(on, clip, s, e, strand) of clips (on, clip, seq, right) on the window (on, start, seq) of their own: the 20 bases next to the breakpoint occur once over both strands, and of up to 60 one in 20 may differ. right: the clip lies right of its read, so its first bases are next to the breakpoint. N at the ends of a clip are left out; clips with other N, or under 20 bases, have no place."""
    c = clips.select(on, "clip", "right", F.btrim("seq", F.lit("N")).alias("seq")).where((F.length("seq") >= SEED) & ~F.contains("seq", F.lit("N")))
    c = c.withColumn("n", F.least(F.length("seq"), F.lit(PROBE)))
    c = c.withColumn("probe", F.when(F.col("right"), F.substring("seq", F.lit(1), F.col("n"))).otherwise(F.right("seq", F.col("n"))))
    c = c.withColumn("_seed", F.when(F.col("right"), F.substring("probe", 1, SEED)).otherwise(F.right("probe", F.lit(SEED))))
    # a clip's seed is looked for in its window itself, ahead and turned: no row a base of the window is made, and none carries it on
    w = windows.where(F.length("seq") >= SEED).select(on, "start", F.col("seq").alias("text"))
    right, n = F.col("right"), F.col("n")
    letters = lambda x: F.split(x, "")

    def looked(strand: str, seed: Column, probe: Column, leads: Column) -> tuple[Column, Column]:
        """How often the seed occurs (2: more than once), and where the whole probe lies with its first place, if it fits; leads: the seed is its first bases."""
        first = F.position(seed, F.col("text"))
        hits = F.when(first == 0, 0).when(F.position(seed, F.col("text"), first + 1) == 0, 1).otherwise(2)
        lo = first - 1 - F.when(leads, 0).otherwise(n - SEED)
        same = F.zip_with(letters(F.substring("text", lo + 1, n)), letters(probe), lambda a, b: a == b)
        fits = (lo >= 0) & (lo + n <= F.length("text")) & (F.size(F.filter(same, lambda x: ~x)) <= F.floor(n / EDIT_EVERY))
        s = F.col("start") + lo
        return hits, F.when((hits == 1) & fits, F.struct(s.alias("s"), (s + n).alias("e"), F.lit(strand).alias("strand")))

    plus, there = looked("+", F.col("_seed"), F.col("probe"), right)
    minus, back = looked("-", reverse_complement(F.col("_seed")), reverse_complement(F.col("probe")), ~right)
    met = c.join(w, on).select(on, "clip", (plus + minus).alias("hits"), F.coalesce(there, back).alias("at")).where("hits > 0")
    once = met.groupBy(on, "clip").agg(F.sum("hits").alias("hits"), F.first("at").alias("at")).where("hits = 1 and at is not null")
    return once.select(on, "clip", "at.*")
