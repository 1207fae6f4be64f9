"""Transcripts and sequences: loci, codons, transcript coordinates, exons of a call, decay of a messenger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidespan.operators.intervals import overlap_join, point_join

#: The bases in table order, and the amino acids of their 64 codons.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: The codons in the same order, a blank behind each.
CODONS = "".join(f"{a}{b}{c} " for a in BASES for b in BASES for c in BASES)


def amino_acid(codon: Column) -> Column:
    """One-letter amino acid; * for a stop; X where a base is not one of A, C, G, T (U)."""
    at = F.instr(F.lit(CODONS), F.translate(codon, "acgtuU", "ACGTTT"))
    return F.when((F.length(codon) == 3) & (at % 4 == 1), F.substring(F.lit(AMINO_ACIDS), F.floor(at / 4).cast("int") + 1, F.lit(1))).otherwise(F.lit("X"))


def protein(cds: Column) -> Column:
    """Whole codons of a coding sequence, translated one by one."""
    n = F.floor(F.length(cds) / 3).cast("int")
    return F.when(n < 1, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: amino_acid(F.substring(cds, i * 3 + 1, F.lit(3)))), ""))


def locus(text: Column) -> Column:
    """Struct (chrom, s, e), 0-based half-open, of "chr1:1,234-5,678", "1:1234" or the like; null fields where it is none."""
    clean = F.regexp_replace(F.trim(text), "[, ]", "")
    pattern = "(?i)^(?:chr)?([0-9]{1,2}|[XYM])[:_]([0-9]+)(?:(?:-|\\.\\.|_)([0-9]+))?$"
    c, a, b = (F.regexp_extract(clean, pattern, i) for i in (1, 2, 3))
    first, last = a.try_cast("long"), F.coalesce(F.nullif(b, F.lit("")), a).try_cast("long")
    ok = c != ""
    return F.struct(F.when(ok, F.concat(F.lit("chr"), F.upper(c))).alias("chrom"), F.when(ok, F.least(first, last) - 1).alias("s"), F.when(ok, F.greatest(first, last)).alias("e"))


def transcript_layout(exons: DataFrame, on: str, plus: bool = True) -> DataFrame:
    """Adds t1, t2: the exon's first and last position on the transcript, from 1."""
    w = Window.partitionBy(on).orderBy(F.col("xs") if plus else F.desc("xs"))
    return exons.withColumn("t2", F.sum(F.col("xe") - F.col("xs")).over(w)).withColumn("t1", F.col("t2") - (F.col("xe") - F.col("xs")) + 1)


def to_transcript(points: DataFrame, layout: DataFrame, on: str, plus: bool = True) -> DataFrame:
    """Positions (on, pos) on exons with their transcript position t; others are left out."""
    t = F.col("t1") + (F.col("pos") - F.col("xs") if plus else F.col("xe") - 1 - F.col("pos"))
    return point_join(points, layout, [on], "pos", ("xs", "xe")).withColumn("t", t)


def exon_effect(calls: DataFrame, exons: DataFrame, on: str, cds_start: int, cds_end: int) -> DataFrame:
    """What a loss (call, contig, s, e) inside a gene does to its frame: intact where no exon is touched, whole where all lie in it, undetermined where an exon is cut, utr, start or stop where it takes one, else in or out of frame by its coding bases."""
    hit = overlap_join(calls, exons, [on], ("s", "e"), ("xs", "xe"))
    inside = (F.col("xs") >= F.col("s")) & (F.col("xe") <= F.col("e"))
    coding = F.greatest(F.lit(0), F.least("xe", "e", F.lit(cds_end)) - F.greatest("xs", "s", F.lit(cds_start)))
    touched = hit.groupBy("call", on, "s", "e").agg(F.count(F.lit(1)).alias("exons"), F.count_if(inside).alias("_inside"), F.sum(coding).alias("coding"))
    every = exons.groupBy(on).agg(F.count(F.lit(1)).alias("_all"))
    f = calls.select("call", on, "s", "e").join(every, on).join(touched, ["call", on, "s", "e"], "left").fillna(0, ["exons", "_inside", "coding"])
    has = lambda p: (F.col("s") <= p) & (F.col("e") > p)
    effect = (
        F.when(F.col("exons") == 0, "intact")
        .when(F.col("_inside") == F.col("_all"), "whole")
        .when(F.col("exons") > F.col("_inside"), "undetermined")
        .when(F.col("coding") == 0, "utr")
        .when(has(cds_start), "start")
        .when(has(cds_end - 1), "stop")
        .when(F.col("coding") % 3 == 0, "in frame")
        .otherwise("out of frame")
    )
    return f.select("call", on, "exons", "coding", effect.alias("effect"))


def nmd(start_lost: Column, stop: Column, canonical_stop: Column, last_junction: Column, coding_start: Column) -> Column:
    """Fate of a messenger by its stop codon's transcript position: start lost, no stop, canonical, last exon, close to the last junction (55), close to the start (150), else degraded."""
    return (
        F.when(start_lost, "start lost")
        .when(stop.isNull(), "no stop")
        .when(stop == canonical_stop, "canonical")
        .when(last_junction.isNull() | (stop > last_junction), "last exon")
        .when(last_junction - stop <= 55, "near last junction")
        .when(stop - coding_start < 150, "near start")
        .otherwise("degraded")
    )


def deletion_frame(removed: Column, hits_codon: Column) -> Column:
    """Frame effect of a junction that removes coding bases: utr where it removes none, out where it hits the start or stop codon or not whole codons, else in."""
    return F.when(removed == 0, "utr").when(hits_codon | (removed % 3 != 0), "out").otherwise("in")


def insertion_frame(in_coding: Column, length: Column) -> Column:
    """Frame effect of bases that a junction adds: utr where its anchor lies outside the coding part, else by their number."""
    return F.when(~in_coding, "utr").when(length % 3 != 0, "out").otherwise("in")
