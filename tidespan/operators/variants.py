"""Variant sites from read operations: substitutions, and insertions and deletions by length, with a depth that counts deleted reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidespan.functions.reads import blocks_of
from tidespan.operators.intervals import point_join, runs_of_deltas

#: Reads that an allele needs, lengths from which on a key holds no more.
LEAST_ALT = 3


def parts_of(reads: DataFrame, keys: list[str], *also: str) -> DataFrame:
    """(keys, op, s, e, qs, qe, seq) of the operations of reads (keys, start, ops, seq), and the columns `also`."""
    return reads.select(*keys, "seq", *also, F.inline(blocks_of(F.col("start"), F.col("ops"))))


def weighted_runs(parts: DataFrame, keys: list[str]) -> DataFrame:
    """depth_runs() of parts that stand for _n reads each."""
    ends = F.array(F.struct(F.col("s").alias("pos"), F.col("_n").alias("d")), F.struct(F.col("e").alias("pos"), (-F.col("_n")).alias("d")))
    changes = parts.where("s < e").select(*keys, F.inline(ends)).groupBy(*keys, "pos").agg(F.sum("d").alias("d")).where("d <> 0")
    return runs_of_deltas(changes, keys)


def allele_counts_by_kind(parts: DataFrame, keys: list[str], least_length: int = 1) -> DataFrame:
    """(keys, pos, kind, alt, length, n): snv by base (of X operations), ins and del by length, at the base an insertion precedes or a deletion begins with. A part stands for _n reads."""
    long = F.when(F.col("op") == "I", F.col("qe") - F.col("qs")).when(F.col("op") == "D", F.col("e") - F.col("s"))
    indels = parts.where(F.col("op").isin("I", "D") & (long >= least_length)).select(*keys, "_n", F.col("s").alias("pos"), F.when(F.col("op") == "I", "ins").otherwise("del").alias("kind"), F.concat(F.when(F.col("op") == "I", "+").otherwise("-"), long.cast("string")).alias("alt"), long.alias("length"))
    x = parts.where(F.col("op") == "X").select(*keys, "_n", "seq", "s", "qs", F.explode(F.sequence(F.col("s"), F.col("e") - 1)).alias("pos"))
    snvs = x.select(*keys, "_n", "pos", F.lit("snv").alias("kind"), F.substring("seq", F.col("qs") + F.col("pos") - F.col("s") + 1, F.lit(1)).alias("alt"), F.lit(0).alias("length"))
    return snvs.unionByName(indels).groupBy(*keys, "pos", "kind", "alt", "length").agg(F.sum("_n").alias("n"))


def called_variants(reads: DataFrame, keys: list[str], min_vaf: float = 0.05, least_length: int = 1, width: int = 64, weight: str | None = None) -> DataFrame:
    """(keys, pos, kind, alt, length, alt_count, depth, vaf) of alleles with three reads and min_vaf of the depth.

    The depth of a substitution is that of aligned bases; of an insertion or deletion, it also counts reads whose own deletion
    spans the position, and is never less than the allele's reads. Depths are runs from one sweep each, met by position; an
    allele where no run lies has no other depth than its own reads. Reads of a library whose substitutions are M have none here.
    weight: a column that tells how many reads a row stands for; reads that are alike are one row from here on.
    """
    alike = reads.groupBy(*keys, "start", "ops", "seq").agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
    parts = parts_of(alike, keys, "_n")
    counts = allele_counts_by_kind(parts, keys, least_length).where(F.col("n") >= LEAST_ALT)
    aligned = parts.where(F.col("op").isin("M", "=", "X"))
    base = weighted_runs(aligned, keys)
    with_deleted = weighted_runs(parts.where(F.col("op").isin("M", "=", "X", "D")), keys)
    snv = point_join(counts.where("kind = 'snv'"), base, keys, "pos", ("s", "e"), width).select(*counts.columns, "depth")
    indel = counts.where("kind <> 'snv'")
    deep = point_join(indel, with_deleted, keys, "pos", ("s", "e"), width).select(*keys, "pos", "kind", "alt", "depth")
    indel = indel.join(deep, [*keys, "pos", "kind", "alt"], "left").select(*counts.columns, F.greatest(F.coalesce("depth", F.lit(0)), F.col("n")).alias("depth"))
    both = snv.unionByName(indel).withColumn("vaf", F.col("n") / F.col("depth"))
    return both.where(F.col("vaf") >= min_vaf).select(*keys, "pos", "kind", "alt", "length", F.col("n").alias("alt_count"), "depth", "vaf")
