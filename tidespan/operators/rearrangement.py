"""Structural evidence, rule by rule: deletions and clips in CIGARs, links elsewhere, discordant pairs and their pooling; junctions and breakpoints of evidence; what segments hold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidespan.functions.reads import blocks_of
from tidespan.operators.evidence import clustered
from tidespan.operators.intervals import islands, overlap_join

#: Least deletion, least clip, least support, bin of pairs; least distance of mates that face away, and how far they may overlap; clips of a pair that crosses a junction.
LEAST_DELETION, LEAST_CLIP, SUPPORT, PAIR_BIN = 50, 20, 3, 500
OUTWARD, OVERLAP, CROSSING_CLIP, FAR = 300, 20, 10, 1000
RESCUE_CLIP = 8


def large_deletions(reads: DataFrame, on: str) -> DataFrame:
    """(on, s, e, count) of deletions of 50 bases or more in CIGARs of reads (on, start, ops), by exact span."""
    x = reads.where(F.exists("ops", lambda o: (o["op"] == "D") & (o["n"] >= LEAST_DELETION)))
    b = x.select(on, F.inline(F.filter(blocks_of(F.col("start"), F.col("ops")), lambda b: (b["op"] == "D") & (b["e"] - b["s"] >= LEAST_DELETION))))
    return b.groupBy(on, "s", "e").agg(F.count(F.lit(1)).alias("count"))


def clip_clusters(reads: DataFrame, on: str) -> DataFrame:
    """(on, side, pos, count, hard) of reads (on, start, ops, sa) without an SA tag, clipped by 20 bases or more at the same place; soft clips count before hard ones; from three reads on."""
    n = lambda ops, op: F.aggregate(F.filter(ops, lambda o: o["op"] == op), F.lit(0), lambda a, o: a + o["n"])
    aligned = F.transform("ops", lambda o: o["op"].isin("M", "I", "=", "X", "D", "N"))
    first = F.array_position(aligned, F.lit(True)).cast("int")
    size = F.aggregate(F.filter("ops", lambda o: o["op"].isin("M", "D", "N", "=", "X")), F.lit(0), lambda a, o: a + o["n"])
    x = reads.where("sa is null").withColumns({"_first": first, "_end": F.col("start") + size}).where("_first > 0")
    before, after = F.slice("ops", F.lit(1), F.col("_first") - 1), F.slice("ops", F.col("_first"), F.size("ops"))
    end = lambda side, ops, pos: F.struct(F.lit(side).alias("side"), pos.cast("int").alias("pos"), n(ops, "S").alias("soft"), n(ops, "H").alias("hard"))
    ends = x.select(on, F.inline(F.array(end("left", before, F.col("start")), end("right", after, F.col("_end"))))).where((F.col("soft") >= LEAST_CLIP) | (F.col("hard") >= LEAST_CLIP))
    return supported(ends.groupBy(on, "side", "pos").agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("soft") < LEAST_CLIP).alias("hard")))


def supported(evidence: DataFrame) -> DataFrame:
    """Insertions, links elsewhere and clips need three reads."""
    return evidence.where(F.col("count") >= SUPPORT)


def elsewhere_links(rows: DataFrame, on: str) -> DataFrame:
    """(on, kind, pos, target, count, far_pos, far_count) of rows (on, kind, pos, target, at, ord): split reads at their break and pairs in bins of 500 that go on on another contig. The far position with the most votes is kept, of equals the one first met; from three on."""
    pos = F.when(F.col("kind") == "pair", F.floor(F.col("pos") / PAIR_BIN) * PAIR_BIN).otherwise(F.col("pos")).cast("int").alias("pos")
    key = [on, "kind", "pos", "target"]
    votes = rows.select(on, "kind", pos, "target", "at", "ord").groupBy(*key, "at").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    far = F.max(F.when(F.col("at").isNotNull(), F.struct("n", (-F.col("first")).alias("early"), "at"))).alias("_far")
    links = votes.groupBy(*key).agg(F.sum("n").alias("count"), far)
    return supported(links).select(*key, "count", F.col("_far.at").alias("far_pos"), F.col("_far.n").alias("far_count"))


def pair_kind(median: Column) -> Column:
    """deletion, duplication, inversion or null of a pair, from columns rev, mate_rev, fwd_start, rev_start, rev_end, fwd_clip, rev_clip (of the ends that would cross a junction) and span: orientation first, with pairs that cross a junction by where their mates lie; then the distance."""
    crossing = (F.col("fwd_clip") >= CROSSING_CLIP) & (F.col("rev_clip") >= CROSSING_CLIP) & (F.abs(F.col("fwd_start") - F.col("rev_end")) >= LEAST_DELETION)
    outward = (F.col("rev_start") < F.col("fwd_start")) & (F.col("rev_end") <= F.col("fwd_start") + OVERLAP)
    return (
        F.when(F.col("rev") == F.col("mate_rev"), "inversion")
        .when(crossing, F.when(F.col("fwd_start") > F.col("rev_end"), "deletion").otherwise("duplication"))
        .when(outward, F.when(F.col("fwd_start") - F.col("rev_start") > F.greatest(F.lit(OUTWARD), 2 * median), "duplication"))
        .when(F.col("span") > F.greatest(5 * median, F.lit(FAR)), "deletion")
    )


def pooled_discordant(pairs: DataFrame, key: str) -> DataFrame:
    """(key, kind, s, e, count) of discordant pairs (key, kind, lo, hi, a, b): counted in bins of 500 that hold their extent; the strongest bins first, those of the kind within 500 at both ends join. The arc lies at the pairs' own estimates a and b: outermost of duplications, innermost of deletions, upper medians of inversions; where these cross, at the outermost bins."""

    def run(t: pa.Table) -> pa.Table:
        s, e, a, b = (np.asarray(t.column(c)) for c in ("s", "e", "a", "b"))
        kind = t.column("kind")[0].as_py()
        bins, member, count = np.unique(np.stack([s, e], axis=1), axis=0, return_inverse=True, return_counts=True)
        free = np.ones(len(bins), bool)
        out = []
        for k in np.lexsort((bins[:, 1], bins[:, 0], -count)).tolist():
            if not free[k]:
                continue
            own = free & (np.abs(bins - bins[k]) <= PAIR_BIN).all(axis=1)
            free &= ~own
            rows = own[member.ravel()]
            x, y = np.sort(a[rows]), np.sort(b[rows])
            at = {"duplication": (x[0], y[-1]), "deletion": (x[-1], y[0])}.get(kind, (x[len(x) >> 1], y[len(y) >> 1]))
            out.append((*(at if at[1] > at[0] else (bins[own, 0].min(), bins[own, 1].max())), int(count[own].sum())))
        return pa.table({key: pa.array([t.column(key)[0].as_py()] * len(out), pa.string()), "kind": [kind] * len(out), "s": pa.array([int(o[0]) for o in out], pa.int32()), "e": pa.array([int(o[1]) for o in out], pa.int32()), "count": pa.array([o[2] for o in out], pa.int64())})

    s, e = (F.floor(F.col("lo") / PAIR_BIN) * PAIR_BIN).cast("int"), (F.ceil(F.col("hi") / PAIR_BIN) * PAIR_BIN).cast("int")
    rows = pairs.select(key, "kind", s.alias("s"), e.alias("e"), "a", "b").where("kind is not null and e > s")
    return islands(rows, [key, "kind"], "s", PAIR_BIN).groupBy(key, "kind", "_island").applyInArrow(run, f"{key} string, kind string, s int, e int, count long")


#: Families of arcs that are one event where they lie within the tolerance.
FAMILIES = {"deletion": "deletion", "split": "deletion", "duplication": "duplication", "inversion": "inversion"}


def family_events(arcs: DataFrame, key: str) -> DataFrame:
    """(key, kind, s, e, count, merged): one arc an event, of arcs (key, kind, s, e, n); deletions in CIGARs and split reads of that type are one family."""
    family = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in FAMILIES.items()])
    both = arcs.withColumn("_family", F.concat(F.col(key), F.lit("\n"), family)).select(F.col("_family").alias("family"), "s", "e", "n").where("family is not null")
    parts = F.split("family", "\n")
    return clustered(both, "family").select(F.get(parts, F.lit(0)).alias(key), F.get(parts, F.lit(1)).alias("kind"), "s", "e", "count", "merged")


def breakpoints(arcs: DataFrame) -> DataFrame:
    """Arcs of the four kinds that clips can be rescued at."""
    return arcs.where(F.col("kind").isin(*FAMILIES))


def evidence_junctions(arcs: DataFrame, least: int = SUPPORT) -> DataFrame:
    """(kind, a_pos, a_side, b_pos, b_side, reads, key) of arcs (kind, s, e, count, type, plus, minus): a deletion joins the tail at its start with the head at its end, a duplication the other way round, an inversion its tails and its heads, each with the reads of its orientation, or both with all where none is known. Pairs (discordant) go by their type."""
    side = lambda a, x, b, y, n: F.struct(a.alias("a_pos"), F.lit(x).alias("a_side"), b.alias("b_pos"), F.lit(y).alias("b_side"), n.alias("reads"))
    s, e, n = F.col("s"), F.col("e"), F.col("count")
    plus, minus = F.coalesce("plus", F.lit(0)), F.coalesce("minus", F.lit(0))
    known = (F.col("kind") == "inversion") & ((plus > 0) | (minus > 0))
    ways = lambda m, k: F.array(side(s, "tail", e, "tail", m), side(s, "head", e, "head", k))
    what = F.when(F.col("kind") == "split", "deletion").when(F.col("kind") == "discordant", F.coalesce("type", F.lit("deletion"))).otherwise(F.col("kind"))
    rows = (
        F.when(what == "deletion", F.array(side(s, "tail", e, "head", n)))
        .when(what == "duplication", F.array(side(e, "tail", s, "head", n)))
        .when(known, F.filter(ways(plus.cast("long"), minus.cast("long")), lambda x: x["reads"] > 0))
        .when(what == "inversion", ways(n, n))
    )
    key = F.concat(F.col("kind"), F.lit(":"), s.cast("string"), F.lit("-"), e.cast("string"))
    return arcs.where((n >= least) & (e > s)).select(what.alias("kind"), key.alias("key"), F.inline(rows))


def segment_content(segments: DataFrame, exons: DataFrame, on: str, cds_start: int, cds_end: int) -> DataFrame:
    """(segment, whole, cut, coding, frame) of segments (segment, on, s, e) that touch a gene model (on, rank, xs, xe): ranks of exons inside and of exons that an end cuts, coding bases of those inside, and whether they keep the frame."""
    extent = exons.groupBy(on).agg(F.min("xs").alias("_a"), F.max("xe").alias("_b"))
    touched = overlap_join(segments, extent, [on], ("s", "e"), ("_a", "_b"), 4096).select("segment")
    hit = overlap_join(segments, exons, [on], ("s", "e"), ("xs", "xe"), 256)
    inside = (F.col("xs") >= F.col("s")) & (F.col("xe") <= F.col("e"))
    coding = F.greatest(F.lit(0), F.least("xe", F.lit(cds_end)) - F.greatest("xs", F.lit(cds_start)))
    ranks = lambda c: F.array_join(F.sort_array(F.collect_list(F.when(c, F.col("rank")))), ",")
    x = hit.groupBy("segment").agg(ranks(inside).alias("whole"), ranks(~inside).alias("cut"), F.sum(F.when(inside, coding).otherwise(0)).alias("coding"))
    x = touched.join(x, "segment", "left").select("segment", F.coalesce("whole", F.lit("")).alias("whole"), F.coalesce("cut", F.lit("")).alias("cut"), F.coalesce("coding", F.lit(0)).cast("long").alias("coding"))
    return x.withColumn("frame", F.when(F.col("coding") == 0, "none").when(F.col("coding") % 3 != 0, "shifted").otherwise("kept"))


def clip_checks(reads: DataFrame, on: str) -> DataFrame:
    """(on, realignable, rescuable, longest) of reads (on, ops, sa, seq): whether a soft clip without SA tag is long enough to be placed, or to be rescued at a known breakpoint, and the longest insertion from 50 bases on; of reads that carry their bases."""
    longest = lambda op: F.array_max(F.transform(F.filter("ops", lambda o: o["op"] == op), lambda o: o["n"]))
    has = F.col("seq").isNotNull() & (F.col("seq") != "")
    clip = F.when(has & F.col("sa").isNull(), longest("S"))
    x = reads.select(on, clip.alias("_clip"), F.when(has, longest("I")).alias("_ins"))
    agg = x.groupBy(on).agg(F.coalesce(F.max("_clip"), F.lit(0)).alias("_c"), F.coalesce(F.max("_ins"), F.lit(0)).alias("_i"))
    return agg.select(on, (F.col("_c") >= LEAST_CLIP).alias("realignable"), (F.col("_c") >= RESCUE_CLIP).alias("rescuable"), F.when(F.col("_i") >= LEAST_DELETION, F.col("_i")).otherwise(0).alias("longest"))


def merged_arcs(layers: list[DataFrame], key: str) -> DataFrame:
    """One arc an event over the arcs (key, s, e, n) of several layers or samples: equal arcs are added, then clustered as one list."""
    both = layers[0].select(key, "s", "e", "n")
    for x in layers[1:]:
        both = both.unionByName(x.select(key, "s", "e", "n"))
    return clustered(both.groupBy(key, "s", "e").agg(F.sum("n").alias("n")), key)
