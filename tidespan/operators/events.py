"""Shares of splicing events at introns: every event that competes for an intron's reads, cryptic exons made of two junctions and retention among them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the longest cryptic exon between two junctions of one intron.
CRYPTIC_EXON = 500


def introns_of(exons: DataFrame, on: str) -> DataFrame:
    """(on, k, is_, ie) of a model's exons (on, xs, xe), numbered from the left; exons that touch or overlap leave none."""
    w = Window.partitionBy(on).orderBy("xs", "xe")
    x = exons.select(on, F.row_number().over(w).alias("k"), F.col("xe").alias("is_"), F.lead("xs").over(w).alias("ie"))
    return x.where("ie > is_")


def competitors(junctions: DataFrame, exons: DataFrame, on: str, keys: list[str]) -> DataFrame:
    """(keys, k, is_, ie, s, e, n, what, k1, k2): junctions (keys, s, e, n) at the introns they share an end with. what: canonical, skip (both ends are exons' with at least one between; k1 and k2 are the introns beside), left or right (one end here, the other inside), other."""
    w = Window.partitionBy(on).orderBy("xs", "xe")
    numbered = exons.select(on, F.row_number().over(w).alias("x"), "xs", "xe")
    # of exons with one end the last counts
    ends = numbered.groupBy(on, F.col("xe").alias("s")).agg(F.max("x").alias("_li"))
    starts = numbered.groupBy(on, F.col("xs").alias("e")).agg(F.max("x").alias("_ri"))
    j = junctions.select(*keys, "s", "e", "n").join(ends, [on, "s"], "left").join(starts, [on, "e"], "left")
    skip = F.coalesce(F.col("_ri") > F.col("_li") + 1, F.lit(False))
    j = j.select(*keys, "s", "e", "n", skip.alias("_skip"), F.when(skip, F.col("_li")).alias("k1"), F.when(skip, F.col("_ri") - 1).alias("k2"))
    introns = introns_of(exons, on)
    by_start = j.join(introns.withColumnRenamed("is_", "s"), [on, "s"]).withColumn("is_", F.col("s"))
    by_end = j.join(introns.withColumnRenamed("ie", "e"), [on, "e"]).withColumn("ie", F.col("e")).where("s <> is_")
    both = by_start.unionByName(by_end)
    what = (
        F.when((F.col("s") == F.col("is_")) & (F.col("e") == F.col("ie")), "canonical")
        .when(F.col("_skip"), "skip")
        .when((F.col("s") == F.col("is_")) & (F.col("e") < F.col("ie")), "left")
        .when((F.col("e") == F.col("ie")) & (F.col("s") > F.col("is_")), "right")
        .otherwise("other")
    )
    rows = both.withColumn("what", what)
    # an intron between a skip's ends is met by it only where it shares an end: its two neighbours
    return rows.where((F.col("what") != "skip") | (F.col("k") == F.col("k1")) | (F.col("k") == F.col("k2"))).drop("_skip")


def cryptic_pairs(rows: DataFrame, keys: list[str], longest: int = CRYPTIC_EXON) -> DataFrame:
    """(keys, k, ls, le, rs, re, pair) of left and right junctions of introns: lefts by their reads, each with the right one of most reads, then the nearest, that starts after it within the longest exon and has no partner yet. Greedy within an intron and a sample, which is a group's work."""
    kept = [*keys, "k", "s", "e", "n", "what"]
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in [*keys, "k"]), "ls int, le int, rs int, re int, pair double"])

    def run(t: pa.Table) -> pa.Table:
        r = t.select(["s", "e", "n", "what"]).to_pylist()
        free = {(x["s"], x["e"]): x["n"] for x in r if x["what"] == "right"}
        out = []
        for x in sorted((x for x in r if x["what"] == "left"), key=lambda x: (-x["n"], x["s"], x["e"])):
            fits = [(-n, s, e) for (s, e), n in free.items() if 0 < s - x["e"] <= longest]
            if fits:
                n, s, e = min(fits)
                del free[s, e]
                out.append((x["s"], x["e"], s, e, (x["n"] - n) / 2))
        own = {c: pa.array([t.column(c)[0].as_py()] * len(out), t.schema.field(c).type) for c in [*keys, "k"]}
        return pa.table(own | {c: pa.array([o[i] for o in out], pa.float64() if c == "pair" else pa.int32()) for i, c in enumerate(("ls", "le", "rs", "re", "pair"))})

    sides = rows.where(F.col("what").isin("left", "right")).select(*kept)
    return sides.groupBy(*keys, "k").applyInArrow(run, schema)


def event_shares(junctions: DataFrame, exons: DataFrame, on: str, keys: list[str], spanning: DataFrame | None = None) -> DataFrame:
    """(keys, k, s, e, event, weight, total, share) of every event at every intron k of the model.

    An intron's total is its canonical reads, those of other junctions with one of its ends, half of the two junctions of each
    cryptic exon, the junctions that skip an exon beside it, and half the unspliced reads over both its boundaries. canonical,
    alternative, cryptic_exon (on both of its arcs) and retention are shares of it; a skip is one value over the totals of its
    two introns; canonical junctions whose only competitor on both sides is one skip carry the inclusion level of both
    introns. spanning: (keys, side, pos, n); an intron needs both of its boundaries counted to have a retention.
    """
    rows = competitors(junctions, exons, on, keys)
    at = [*keys, "k"]
    pairs = cryptic_pairs(rows, keys)
    arcs = pairs.select(*at, F.inline(F.array(F.struct(F.col("ls").alias("s"), F.col("le").alias("e"), "pair"), F.struct(F.col("rs").alias("s"), F.col("re").alias("e"), "pair"))))
    rows = rows.join(arcs, [*at, "s", "e"], "left")
    n = F.col("n").cast("double")
    event = F.when(F.col("what") == "canonical", "canonical").when(F.col("what") == "skip", "skip").when(F.col("pair").isNotNull(), "cryptic_exon").otherwise("alternative")
    rows = rows.select(*at, "is_", "ie", "s", "e", "k1", "k2", event.alias("event"), F.coalesce("pair", n).alias("weight"))
    introns = introns_of(exons, on)
    seen = rows.select(*at, "is_", "ie").distinct()
    if spanning is not None:
        side = lambda name, c, out: spanning.where(F.col("side") == name).select(*keys, F.col("pos").alias(c), F.col("n").alias(out))
        held = introns.join(side("intronStart", "is_", "_rs"), [on, "is_"]).join(side("intronEnd", "ie", "_re"), [*keys, "ie"])
        held = held.select(*at, "is_", "ie", (F.col("_rs") + F.col("_re")).cast("double").alias("unspliced"))
        seen = seen.join(held, [*at, "is_", "ie"], "full")
    else:
        seen = seen.withColumn("unspliced", F.lit(None).cast("double"))
    # one arc of a cryptic exon carries the weight of both
    once = F.when(F.col("event") == "cryptic_exon", F.col("weight") / 2).otherwise(F.col("weight"))
    only = lambda what, x: F.sum(F.when(F.col("event") == what, x).otherwise(0))
    sums = rows.groupBy(*at).agg(F.sum(once).alias("_w"), only("canonical", F.col("weight")).alias("_c"), only("skip", F.lit(1)).alias("_skips"), F.count_if(F.col("event").isin("alternative", "cryptic_exon")).alias("_rest"))
    pool = seen.join(sums, at, "left").fillna({"_w": 0.0, "_c": 0.0, "_skips": 0, "_rest": 0})
    half = F.coalesce(F.col("unspliced"), F.lit(0.0)) / 2
    pool = pool.withColumns({"total": F.col("_w") + half, "_pure": (F.col("_skips") == 1) & (F.col("_rest") == 0) & (half == 0)})
    of = lambda x: pool.select(*keys, F.col("k").alias(f"k{x}"), F.col("total").alias(f"_t{x}"), F.col("_c").alias(f"_c{x}"), F.col("_pure").alias(f"_p{x}"))
    skips = rows.where("event = 'skip' and k = k1").join(of(1), [*keys, "k1"]).join(of(2), [*keys, "k2"])
    level = F.try_divide(F.col("_c1") + F.col("_c2"), F.col("_c1") + F.col("_c2") + 2 * F.col("weight"))
    shared = skips.where("_p1 and _p2").select(*keys, F.explode(F.array("k1", "k2")).alias("k"), level.alias("_level"), (F.col("_c1") + F.col("_c2") + 2 * F.col("weight")).alias("_den"))
    base = rows.where("event <> 'skip'").join(pool.select(*at, "total"), at).join(shared, at, "left").where("total > 0")
    by_skip = (F.col("event") == "canonical") & F.col("_level").isNotNull()
    base = base.select(*at, "s", "e", "event", "weight", F.when(by_skip, F.col("_den")).otherwise(F.col("total")).alias("total"), F.when(by_skip, F.col("_level")).otherwise(F.col("weight") / F.col("total")).alias("share"))
    den = F.col("_t1") + F.col("_t2")
    skipped = skips.where(den > 0).select(*keys, F.col("k1").alias("k"), "s", "e", "event", "weight", den.alias("total"), (2 * F.col("weight") / den).alias("share"))
    kept = pool.where("unspliced is not null").select(*at, F.col("is_").alias("s"), F.col("ie").alias("e"), F.lit("retention").alias("event"), half.alias("weight"), "total", F.coalesce(F.try_divide(half, F.col("total")), F.lit(0.0)).alias("share"))
    return base.unionByName(skipped).unionByName(kept)
