"""Copy-number calls: names, filters, annotation joins, topology, rule scores. Ends of calls are inclusive where said so."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidespan.operators.intervals import alike_in_length, by_id, given_back, meetings, outermost, point_join, ranked
from tidespan.session import store

LAB_COVER, RECURRENT_SHARE, BIG_KB = 0.8, 0.5, 1000
#: Shares by which regions are looked for one after the other, down to the one that counts.
SHARES = (0.95, 0.85, 0.7, RECURRENT_SHARE)


def chromosome(name: Column) -> Column:
    """chr1 to chr22, chrX, chrY, chrM, whatever the case and prefix; else null."""
    bare = F.regexp_extract(F.upper(F.trim(name)), "^(?:CHR)?([1-9]|1[0-9]|2[0-2]|X|Y|M)$", 1)
    return F.when(bare != "", F.concat(F.lit("chr"), bare))


def kind_of_text(text: Column) -> Column:
    """loss, gain or null of a free-text type; accents do not matter."""
    plain = F.translate(F.lower(text), "éèêàâïîôùûç", "eeeaaiiouuc")
    return F.when(plain.rlike("del|loss|perte|\\bx[01]\\b"), "loss").when(plain.rlike("amp|gain|dup|\\bx[3-9]\\b"), "gain")


def passes(kinds: list[str] | None = None, min_size: int = 0, min_probes: int = 0, query: str = "", probes: str | None = None) -> Column:
    """Filter of calls (kind, size, chrom): unknown numbers of probes pass."""
    keep = F.col("size") >= min_size
    if kinds is not None:
        keep = keep & F.col("kind").isin(kinds)
    if probes is not None:
        keep = keep & (F.col(probes).isNull() | (F.col(probes) >= min_probes))
    if query:
        keep = keep & F.contains(F.lower("chrom"), F.lit(query.lower()))
    return keep


def lab_matches(calls: DataFrame, entries: DataFrame, width: int = 64) -> DataFrame:
    """For each call (call, chrom, kind, s, e) the compatible entry (entry, chrom, ls, le, type) of its chromosome that covers most of it, from 80 % on; ends inclusive, the first entry at ties."""
    alike = ["chrom", "kind", "s", "e"]
    # what covers so much of a call holds its middle
    a = calls.select(*alike).distinct().where("s <= e").withColumn("_mid", F.floor((F.col("s") + F.col("e")) / 2))
    # an entry inside an earlier one is never the best
    like = entries.groupBy("chrom", "ls", "le", "type").agg(F.min("entry").alias("entry")).withColumn("_le", F.col("le") + 1)
    outer = outermost(like, ["chrom"], "ls", "_le", ["entry"], "type").groupBy("chrom", "ls", "_le", "type").agg(F.min("entry").alias("entry"))
    # numbered by entry, and written, as the numbers are joined on: the best is the greatest number of shared bases and a place
    b = store(ranked(outer, ["chrom"], "entry", "ls", "_le", "type").select("chrom", "ls", "_le", "type", "entry", "rank"), "outer-entries")
    placed = b.groupBy("chrom", "ls", "_le", "type").agg(F.min("rank").alias("rank"))
    pairs = point_join(a, placed, ["chrom"], "_mid", ("ls", "_le"), width).where((F.col("type") == "both") | (F.col("type") == F.col("kind")))
    n, low = F.col("e") - F.col("s") + 1, (1 << 32) - 1
    shared = (F.least(F.col("e") + 1, "_le") - F.greatest("s", "ls")).cast("long")
    found = pairs.where(shared / n >= LAB_COVER).groupBy(*alike).agg(F.max(F.shiftleft(shared, 32) + (low - F.col("rank"))).alias("_b"))
    best = found.select(*alike, (F.shiftright("_b", 32) / n).alias("pct"), (low - F.col("_b").bitwiseAND(F.lit(low))).alias("rank")).join(b.select("chrom", "rank", "entry"), ["chrom", "rank"]).select(*alike, "entry", "pct")
    first = lambda rows: rows.groupBy("call").agg(F.max(F.struct("pct", (-F.col("entry")).alias("k"))).alias("_b")).select("call", (-F.col("_b.k")).alias("entry"), F.col("_b.pct").alias("pct"))
    return by_id(calls, lambda rows: given_back(best, rows, alike, "call").select("call", "entry", "pct"), first)


def reciprocal(a: tuple[str, str], b: tuple[str, str]) -> Column:
    (s, e), (s2, e2) = a, b
    shared = F.greatest(F.lit(0), F.least(e, e2) - F.greatest(s, s2))
    return shared.cast("double") / F.greatest(F.col(e) - F.col(s), F.col(e2) - F.col(s2), F.lit(1))


def population_matches(events: DataFrame, population: DataFrame, *more: str) -> DataFrame:
    """Events (call, chrom, kind, s, e) with the population variants (sv, chrom, type, os, oe, is_, ie) of their chromosome whose outer extent they touch: the better reciprocal overlap of both extents, whether the inner one covers the event, and whether types agree. more: columns of the variants that are handed out as well."""
    like = ["chrom", "type", "os", "oe", "is_", "ie", *more]
    # what a pair shows is worked out once for all pairs that are alike, and handed to each where they meet
    asked = events.groupBy("chrom", "kind", "s", "e").agg(F.collect_list("call").alias("call"))
    pairs, _ = meetings(asked, population.select(*like, "sv"), ["chrom"], ("s", "e"), ("os", "oe"), each="sv")
    ro = F.greatest(reciprocal(("s", "e"), ("is_", "ie")), reciprocal(("s", "e"), ("os", "oe")))
    covers, same_type = (F.col("is_") <= F.col("s")) & (F.col("ie") >= F.col("e")), (F.col("type") == F.col("kind")) | F.col("type").isin("both", "unknown")
    seen = pairs.select("call", "sv", ro.alias("ro"), covers.alias("covers"), same_type.alias("same_type"), *more)
    return seen.withColumn("sv", F.explode("sv")).withColumn("call", F.explode("call"))


def ordered_matches(matches: DataFrame) -> DataFrame:
    """matches (call, sv, ro, same_type, freq) with their place: those of the same type first, then by reciprocal overlap and frequency."""
    w = Window.partitionBy("call").orderBy(F.desc("same_type"), F.desc("ro"), F.desc(F.coalesce("freq", F.lit(0.0))), "sv")
    return matches.withColumn("place", F.row_number().over(w))


def recurrent(calls: DataFrame, regions: DataFrame, most: int = 4) -> DataFrame:
    """The four best regions (region, chrom, rs, re) of a call's chromosome that share at least half of themselves and of the call.

    Regions that share much of a call are looked for first, and what shares less only for calls that have not met enough by then.
    """
    # calls that are alike are asked for once; of regions that are alike no more than the first few can be among the best
    alike, like = ["chrom", "s", "e"], ["chrom", "rs", "re"]
    first = regions.where("rs < re").withColumn("_k", F.row_number().over(Window.partitionBy(*like).orderBy("region"))).where(F.col("_k") <= most).select(*like, "region")
    asked = calls.where("s < e").select(*alike).distinct()
    least = F.least("of_region", "of_call")
    best = lambda rows, keys: rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(least), "region"))).where(F.col("_k") <= most).drop("_k")
    out = None
    for k, share in enumerate(SHARES):
        pairs, at = alike_in_length(asked, first, ["chrom"], ("s", "e"), ("rs", "re"), share)
        shared = (F.least("e", "re") - F.greatest("s", "rs")).cast("double")
        pairs = pairs.withColumns({"of_region": shared / (F.col("re") - F.col("rs")), "of_call": shared / (F.col("e") - F.col("s"))})
        found = best(pairs.where((F.col("of_region") >= share) & (F.col("of_call") >= share)), [*at, "s", "e"]).select(*alike, "region", "of_region", "of_call")
        if share > SHARES[-1]:
            # written, as both those that are done and those that go on are taken of it
            found = store(found.withColumn("_met", F.count(F.lit(1)).over(Window.partitionBy(*alike))).where(F.col("_met") >= most).drop("_met"), f"best-regions-{k}")
            asked = asked.join(found.select(*alike).distinct(), alike, "left_anti")
        out = found if out is None else out.unionByName(found)
    return by_id(calls, lambda rows: given_back(out, rows, alike, "call").select("call", "region", "of_region", "of_call"), lambda rows: best(rows, ["call"]))


def topology(calls: DataFrame, arms: DataFrame, terminal: int = 500_000, cover: float = 0.9) -> DataFrame:
    """(call, p_end, q_end, span): which chromosome ends a call (call, chrom, s, e) lies on, and whether it covers an arm or the whole. arms: (chrom, arm, a, z, measured), a p and a q of each chromosome; one that arrays don't measure (the short arm of an acrocentric) counts with the other, and never alone."""
    reach = arms.groupBy("chrom").agg(F.min("a").alias("_begin"), F.max("z").alias("_end"))
    each = calls.join(arms, "chrom")
    part = F.greatest(F.lit(0), F.least("e", "z") - F.greatest("s", "a")) / F.greatest(F.col("z") - F.col("a"), F.lit(1))
    each = each.withColumn("_held", F.when(F.col("measured"), part >= cover))
    g = each.groupBy("call", "chrom", "s", "e").agg(F.count_if(F.col("_held") & (F.col("arm") == "p")).alias("_p"), F.count_if(F.col("_held") & (F.col("arm") == "q")).alias("_q"), F.count_if(~F.coalesce("_held", F.lit(True))).alias("_short"))
    span = F.when((F.col("_short") == 0) & (F.col("_p") + F.col("_q") > 0), "chr").when(F.col("_p") > 0, "p").when(F.col("_q") > 0, "q")
    return g.join(reach, "chrom").select("call", (F.col("s") <= F.col("_begin") + terminal).alias("p_end"), (F.col("e") >= F.col("_end") - terminal).alias("q_end"), span.alias("span"))


@dataclass(frozen=True)
class Rule:
    id: str
    level: str
    kind: str
    when: str


#: Rules in their order, over facts of a call (n genes; hi3, hi2, ts3, ts2, cut3: a gene with that score, whole for gains; cut3: cut and of score 3; size_kb).
RULES = (
    Rule("L1", "high", "loss", "hi3"),
    Rule("L5", "high", "loss", "n >= 35 or size_kb > {big}"),
    Rule("L6", "moderate", "loss", "hi2"),
    Rule("L12", "moderate", "loss", "n >= 25 and n < 35"),
    Rule("L13", "low", "loss", "n > 0"),
    Rule("G1", "high", "gain", "ts3"),
    Rule("G3", "high", "gain", "n >= 50 or size_kb > {big}"),
    Rule("G4", "moderate", "gain", "ts2"),
    Rule("G5", "moderate", "gain", "cut3"),
    Rule("G7", "moderate", "gain", "n >= 35 and n < 50"),
    Rule("G8", "low", "gain", "n > 0"),
)
RANK = {"low": 1, "moderate": 2, "high": 3}


def scored(facts: DataFrame, rules: tuple = RULES, big_kb: int = BIG_KB) -> DataFrame:
    """Adds level and reasons (id, level): the highest level met; low reasons go where a higher one is there; a call that meets none is low."""
    met = F.array_compact(
        F.array(
            *[
                F.when((F.col("kind") == r.kind) & F.coalesce(F.expr(r.when.format(big=big_kb)), F.lit(False)), F.struct(F.lit(r.id).alias("id"), F.lit(r.level).alias("level"), F.lit(RANK[r.level]).alias("rank")))
                for r in rules
            ]
        )
    )
    none = F.array(F.struct(F.when(F.col("kind") == "loss", "L0").otherwise("G0").alias("id"), F.lit("low").alias("level"), F.lit(1).alias("rank")))
    df = facts.withColumn("_met", met).withColumn("_met", F.when(F.size("_met") > 0, F.col("_met")).otherwise(none))
    df = df.withColumn("_top", F.array_max(F.transform("_met", lambda r: r["rank"])))
    level = F.when(F.col("_top") == 3, "high").when(F.col("_top") == 2, "moderate").otherwise("low")
    reasons = F.filter("_met", lambda r: (F.col("_top") == 1) | (r["rank"] > 1))
    return df.withColumns({"level": level, "reasons": reasons}).drop("_met", "_top")


def call_views(calls: DataFrame, genes: DataFrame, scores: DataFrame) -> DataFrame:
    """(call, level, reasons, genes, whole) of calls, their genes (call, symbol, whole) and their scores (call, level, reasons): what a call's row shows; calls without genes or score keep theirs empty."""
    g = genes.groupBy("call").agg(F.sort_array(F.collect_set("symbol")).alias("genes"), F.count_if("whole").alias("whole"))
    empty = F.array().cast("array<string>")
    x = calls.join(g, "call", "left").join(scores, "call", "left")
    return x.withColumns({"genes": F.coalesce("genes", empty), "reasons": F.coalesce("reasons", empty), "whole": F.coalesce("whole", F.lit(0)), "level": F.coalesce("level", F.lit("none"))})
