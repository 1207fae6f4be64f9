"""Queries without an oracle see their whole tables."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidespan import catalog
from tidespan.operators import evidence
from tidespan.plans import carriers as ca

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


def rows(df):
    return Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def test_events_of_all_reads(spark):
    iv = ca.intervals(spark, SF)
    arcs = iv.groupBy("contig", "s", "e").agg(F.count(F.lit(1)).alias("n"))
    kind = F.element_at(F.array(F.lit("deletion"), F.lit("duplication"), F.lit("inversion")), (F.col("s") % 3 + 1).cast("int"))
    ends = iv.groupBy("contig", F.col("s").alias("pos")).agg(F.count(F.lit(1)).alias("n"))
    assert rows(catalog.QUERIES["e30_cluster_events"](spark, SF)) == rows(evidence.clustered(arcs, "contig"))
    assert rows(catalog.QUERIES["e31_pool_pair_arcs"](spark, SF)) == rows(evidence.pooled_pairs(arcs.withColumn("kind", kind), "contig"))
    assert rows(catalog.QUERIES["e32_breakend_clusters"](spark, SF)) == rows(evidence.breakends(ends, "contig"))


def test_every_read_has_a_row_and_a_mate(spark):
    reads = [(r["contig"], r["s"], r["e"]) for r in ca.intervals(spark, SF).collect()]
    got = catalog.QUERIES["w08_row_packing"](spark, SF).collect()
    assert Counter((r["contig"], r["s"], r["e"]) for r in got) == Counter(reads)
    # the first row whose last read ends before the read starts
    for contig in {c for c, _, _ in reads}:
        last: list = []
        placed = Counter()
        for s, e in sorted((s, e) for c, s, e in reads if c == contig):
            k = next((k for k, x in enumerate(last) if x < s), len(last))
            last[k : k + 1] = [e]
            placed[s, e, k] += 1
        assert placed == Counter((r["s"], r["e"], r["row"]) for r in got if r["contig"] == contig)
    assert catalog.QUERIES["d02_mate_pairs"](spark, SF).count() == 2 * len(reads)


def test_paths_of_all_junctions(spark):
    got = catalog.QUERIES["h01_rebuilt_paths"](spark, SF).where("path = 0").collect()
    part = spark.read.parquet(f"{SF}/part.parquet").where("p_size >= 5").collect()
    bounds = {(r["p_brand"], 1000 + r["p_size"] * 30 + x) for r in part for x in (0, 500)}
    # pieces are cut at breakends of all junctions, so none reaches over one
    assert got and not [(r, x) for r in got for b, x in bounds if b == r["event"] and r["s"] < x < r["e"]]
