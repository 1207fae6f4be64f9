"""Phasing, molecules, depth verdicts and annotation joins on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidespan.operators import annotation as an
from tidespan.operators import intervals, molecules, phasing
from tidespan.plans import carriers as ca
from tidespan.plans.carriers import CALLS, EXONS, GENES, IV
from tidespan.session import dealt, store, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


FRAGMENTS = f"""with {IV}, al as (select contig, name, cast(site % 40 as bigint) as site, allele = 'R' as alt from iv), fr as (select contig, name, site, bool_and(alt) as alt from al group by all having bool_and(alt) = bool_or(alt))"""


def fragments(spark, d: str) -> DataFrame:
    al = ca.intervals(spark, d).select("contig", "name", (F.col("site") % 40).alias("site"), (F.col("allele") == "R").alias("alt"))
    return phasing.fragment_alleles(al, ["contig"])


@query(
    "e40_phase_links",
    FRAGMENTS + """, k as (select *, row_number() over (partition by contig, name order by site) as r from fr)
    select a.contig, a.site as a, b.site as b, count(*) filter (where a.alt = b.alt) as same, count(*) filter (where a.alt <> b.alt) as diff from k a join k b on a.contig = b.contig and a.name = b.name and b.r > a.r and b.r <= a.r + 32 group by all""",
)
def e40(spark, d: str) -> DataFrame:
    return phasing.links(fragments(spark, d), ["contig"])


@query("e40_phase_blocks")
def e40b(spark, d: str) -> DataFrame:
    # alleles of two drawn haplotypes, so that links agree
    al = ca.intervals(spark, d).select("contig", "name", (F.col("site") % 40).alias("site"), ((F.col("name") % 2 == 0) == (F.col("site") % 40 % 3 == 0)).alias("alt"))
    # both are read several times: written, lines are joined once; dealt, no task of the join also counts and orders what it joins
    fr = store(phasing.fragment_alleles(dealt(al, "contig", "name"), ["contig"]), "fragment-alleles")
    link = store(phasing.links(dealt(fr, "contig", "name"), ["contig"]), "links")
    return phasing.blocks(fr.select("contig", "site").distinct(), link, "contig")


@query(
    "e41_pair_verdicts",
    FRAGMENTS + """, p as (select a.contig, a.site as a, b.site as b, count(*) filter (where a.alt and b.alt) as bb, count(*) filter (where a.alt and not b.alt) as only_a, count(*) filter (where not a.alt and b.alt) as only_b, count(*) filter (where not a.alt and not b.alt) as nn
      from fr a join fr b on a.contig = b.contig and a.name = b.name and a.site < b.site group by all),
    v as (select contig, site, avg(alt::int) as f from fr group by all), c as (select contig, site, case when f > 0.75 then 'hom' when f < 0.25 then 'low' else 'het' end as c from v),
    x as (select p.*, bb + case when ca.c = 'low' or cb.c = 'low' then 0 else nn end as cis, case when ca.c = 'low' and cb.c <> 'low' then only_a when cb.c = 'low' and ca.c <> 'low' then only_b else only_a + only_b end as trans, ca.c = 'hom' or cb.c = 'hom' as hom
      from p join c ca on ca.contig = p.contig and ca.site = a join c cb on cb.contig = p.contig and cb.site = b)
    select contig, a, b, cis, trans, case when hom then 'hom' when cis + trans < 3 then 'few' when trans <= 0.2 * (cis + trans) then 'cis' when cis <= 0.2 * (cis + trans) then 'trans' else 'conflict' end as call from x""",
)
def e41(spark, d: str) -> DataFrame:
    fr = fragments(spark, d)
    a = fr.select("contig", "name", F.col("site").alias("a"), F.col("alt").alias("x"))
    b = fr.select("contig", "name", F.col("site").alias("b"), F.col("alt").alias("y"))
    x, y = F.col("x"), F.col("y")
    p = a.join(b, ["contig", "name"]).where("a < b").groupBy("contig", "a", "b").agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("none"))
    c = fr.groupBy("contig", "site").agg(phasing.site_class(F.avg(F.col("alt").cast("int"))).alias("c"))
    p = p.join(c.select("contig", F.col("site").alias("a"), F.col("c").alias("class_a")), ["contig", "a"]).join(c.select("contig", F.col("site").alias("b"), F.col("c").alias("class_b")), ["contig", "b"])
    cis, trans, call = phasing.pair_verdict(F.col("class_a"), F.col("class_b"))
    return p.select("contig", "a", "b", cis.alias("cis"), trans.alias("trans"), call.alias("call"))


@query(
    "e38_haplotype_consensus",
    f"""with {IV}, x as (select contig, strand as hap, cast(site % 200 as bigint) as site, count(*) as depth, count(*) filter (where allele = 'R') as alt from iv group by all)
    select *, case when depth < 3 then 'uncovered' when greatest(alt / depth::double, 1 - alt / depth::double) < 0.8 then 'mixed' when alt / depth::double >= 0.5 then 'variant' else 'reference' end as state from x""",
)
def e38(spark, d: str) -> DataFrame:
    r = ca.intervals(spark, d).select("contig", F.col("strand").alias("hap"), (F.col("site") % 200).alias("site"), (F.col("allele") == "R").alias("alt"))
    return phasing.haplotype_consensus(r, ["contig"])


@query(
    "e05_exon_depth",
    f"""with {IV}, {EXONS}, p as (select contig, rank, unnest(range(xs, xe)) as pos, xs, xe from exons), q as (select p.contig, p.rank, p.pos, count(i.s) as depth from p left join iv i on i.contig = p.contig and i.s <= p.pos and p.pos < i.e group by all),
    r as (select x.contig, x.rank, count(*) as reads from exons x join iv i on i.contig = x.contig and i.s < x.xe and i.e > x.xs group by all)
    select q.contig, q.rank, median(depth) as median, round(avg(depth), 6) as mean, coalesce(any_value(reads), 0) as reads from q left join r on r.contig = q.contig and r.rank = q.rank group by q.contig, q.rank""",
)
def e05(spark, d: str) -> DataFrame:
    rows, x = ca.intervals(spark, d), ca.exons(spark, d)
    runs = intervals.depth_runs(rows, ["contig"])
    hit = intervals.overlap_join(runs, x, ["contig"], ("s", "e"), ("xs", "xe"), 64)
    # one row a run and exon: the median by weights, without a row a position; uncovered bases count as depth 0
    n = F.least("e", "xe") - F.greatest("s", "xs")
    cut = hit.select("contig", "rank", "depth", n.alias("n"))
    gaps = cut.groupBy("contig", "rank").agg(F.sum("n").alias("_n"))
    zero = x.join(gaps, ["contig", "rank"], "left").select("contig", "rank", F.lit(0).cast("long").alias("depth"), (F.col("xe") - F.col("xs") - F.coalesce("_n", F.lit(0))).alias("n"))
    every = cut.union(zero).where("n > 0")
    stats = every.groupBy("contig", "rank").agg(F.percentile("depth", 0.5, F.col("n").cast("int")).alias("median"), F.round(F.sum(F.col("depth") * F.col("n")) / F.sum("n"), 6).alias("mean"))
    reads = intervals.overlap_join(rows, x, ["contig"], ("s", "e"), ("xs", "xe"), 64).groupBy("contig", "rank").agg(F.count(F.lit(1)).alias("reads"))
    return stats.join(reads, ["contig", "rank"], "left").fillna({"reads": 0})


@query(
    "e17_exon_usage",
    f"""with {IV}, u as (select sample, cast(site % 12 as integer) as exon, count(*)::double as depth, count(*) as reads from iv group by all), m as (select a.sample, a.exon, median(b.depth) as ref, sum(b.reads) as ref_reads from u a join u b on b.sample = a.sample and b.exon <> a.exon group by all)
    select u.sample, u.exon, round(depth / ref, 6) as usage, round(depth / ref * sqrt(1.0 / reads + 1.0 / ref_reads), 6) as sd from u join m on m.sample = u.sample and m.exon = u.exon""",
)
def e17(spark, d: str) -> DataFrame:
    u = ca.intervals(spark, d).groupBy("sample", (F.col("site") % 12).cast("int").alias("exon")).agg(F.count(F.lit(1)).cast("double").alias("depth"), F.count(F.lit(1)).alias("reads"))
    # a gene's exons are few: leave-one-out medians by a join within the sample
    other = u.select("sample", F.col("exon").alias("x2"), F.col("depth").alias("d2"), F.col("reads").alias("r2"))
    m = u.join(other, "sample").where("x2 <> exon").groupBy("sample", "exon").agg(F.percentile("d2", 0.5).alias("ref"), F.sum("r2").alias("ref_reads"))
    j = u.join(m, ["sample", "exon"])
    usage = F.when(F.col("ref") > 0, F.col("depth") / F.col("ref"))
    return j.select("sample", "exon", F.round(usage, 6).alias("usage"), F.round(usage * F.sqrt(1 / F.col("reads") + 1 / F.col("ref_reads")), 6).alias("sd"))


@query(
    "d13_genes_of_calls",
    f"""with {CALLS}, {GENES}, g as (select gene % 200 as symbol, gene as tx, {ca.CHROMS}[gene % 5 + 1] as chrom, gs * 10 as a, ge * 10 + 300 as b, gene % 5 = 0 as listed from genes), x as (select call, s, e, symbol, tx, a, b, row_number() over (partition by call, symbol order by listed desc, b - a desc, tx) as k from calls join g on g.chrom = calls.chrom and a < e and b > s)
    select call, symbol, max(case when k = 1 then tx end) as tx, bool_or(k = 1 and a >= s and b <= e) as whole, bool_or((a + 40 > s and a < e) or (b > s and b - 60 < e)) as exons from x group by all""",
)
def d13(spark, d: str) -> DataFrame:
    g = ca.genes(spark, d).select((F.col("gene") % 200).alias("symbol"), F.col("gene").alias("tx"), ca.part_chrom("gene"), (F.col("gs") * 10).alias("a"), (F.col("ge") * 10 + 300).alias("b"), (F.col("gene") % 5 == 0).alias("listed"))
    exon = lambda s, e: F.struct(s.alias("xs"), e.alias("xe"))
    exons = g.select("tx", "symbol", "chrom", F.inline(F.array(exon(F.col("a"), F.col("a") + 40), exon(F.col("b") - 60, F.col("b")))))
    return an.genes_of_calls(ca.calls(spark, d), g, exons)


@query(
    "e53_rearrangement_hints",
    f"""with {CALLS}, t as (select patient, chrom, kind, call, s <= 87000 as p, e >= 112000 as q from calls where e - s >= 100 and (s <= 87000 or e >= 112000))
    select distinct l.call as loss, g.call as gain, case when l.chrom <> g.chrom then 'translocation' else 'pericentric' end as hint from t l join t g on l.patient = g.patient and l.kind = 'loss' and g.kind = 'gain' and (l.chrom <> g.chrom or (l.p and g.q and not (l.q or g.p)) or (l.q and g.p and not (l.p or g.q)))""",
)
def e53(spark, d: str) -> DataFrame:
    t = ca.calls(spark, d).where("e - s >= 100").withColumns({"p": F.col("s") <= 87000, "q": F.col("e") >= 112000}).where("p or q")
    side = lambda k, x: t.where(F.col("kind") == k).select("patient", F.col("call").alias(k), F.col("chrom").alias(f"{x}c"), F.col("p").alias(f"{x}p"), F.col("q").alias(f"{x}q"))
    j = side("loss", "l").join(side("gain", "g"), "patient")
    opposite = (F.col("lp") & F.col("gq") & ~F.col("lq") & ~F.col("gp")) | (F.col("lq") & F.col("gp") & ~F.col("lp") & ~F.col("gq"))
    return j.where((F.col("lc") != F.col("gc")) | opposite).select("loss", "gain", F.when(F.col("lc") != F.col("gc"), "translocation").otherwise("pericentric").alias("hint")).distinct()


@query(
    "e33_depth_verdicts",
    f"""with {IV}, b as (select contig, cast(s // 200 as integer) as segment, s // 200 in (46, 47, 57, 58) as flank, cast(s % 200 // 20 as integer) as i, count(*)::double as depth from iv where s between 9000 and 11999 group by all),
    l as (select contig, case when count(*) filter (where flank) >= 10 then median(depth) filter (where flank) else median(depth) end as level from b group by contig), r as (select b.contig, segment, i, depth / level * 2 as r from b join l on l.contig = b.contig where level > 0),
    m as (select *, r - avg(r) over (partition by contig, segment) as dv, avg(r) over (partition by contig, segment) as m from r), g as (select *, lag(dv) over (partition by contig, segment order by i) as lv from m),
    s as (select contig, segment, count(*) as n, any_value(m) as observed, sum(dv * dv) as q, sum(coalesce(dv * lv, 0)) as p from g group by all), t as (select *, greatest(0.0, least(0.95, case when q > 0 then p / q else 0 end)) as rho from s),
    u as (select *, sqrt(q / greatest(1, n - 1)) / sqrt(greatest(1.0, n * (1 - rho) / (1 + rho))) as se from t) select contig, segment, n, round(observed, 6) as observed, round(se, 6) as se, abs(observed - 2) <= greatest(0.25, 3 * se) as fits from u where n >= 3""",
)
def e33(spark, d: str) -> DataFrame:
    rows = ca.intervals(spark, d).where("s between 9000 and 11999")
    seg = F.floor(F.col("s") / 200).cast("int")
    b = rows.groupBy("contig", seg.alias("segment"), F.floor(F.col("s") % 200 / 20).cast("int").alias("i")).agg(F.count(F.lit(1)).cast("double").alias("depth"))
    b = b.withColumns({"flank": F.col("segment").isin(46, 47, 57, 58), "expected": F.lit(2.0)})
    v = molecules.depth_verdict(b, ["contig"])
    return v.select("contig", "segment", "n", F.round("observed", 6).alias("observed"), F.round("se", 6).alias("se"), "fits")


@query("f02_fragment_sampling")
def f02(spark, d: str) -> DataFrame:
    r = ca.intervals(spark, d).select("contig", F.col("name").cast("string").alias("name"), "line", "s", "e")
    return molecules.thinned(r, 1500)


@query("b09_modified_bases")
def b09(spark, d: str) -> DataFrame:
    p = table(spark, d, "part")
    seq = F.translate(F.md5("p_name"), "0123456789abcdef", "ACGTACGTACGTACGT")
    n = F.length(seq) - F.length(F.replace(seq, F.lit("C"), F.lit("")))
    reads = p.select(F.col("p_partkey").alias("id"), seq.alias("seq"), (F.col("p_partkey") % 2 == 0).alias("reverse"), F.when(n >= 3, F.lit("C+m?,0,1;C+h?,0;")).alias("mm"), F.array(F.lit(200), F.lit(30), F.lit(90)).alias("ml"))
    return molecules.decode_modifications(reads)


@query("m08_cpg_sites", "with q as (select p_partkey, translate(md5(p_name || p_partkey), '0123456789abcdef', 'ACGTCGCGACGTCGCG') as q from part) select p_partkey, cast(i - 1 as integer) as pos from q, range(1, 32) r(i) where q[i:i + 1] = 'CG'")
def m08(spark, d: str) -> DataFrame:
    q = F.translate(F.md5(F.concat("p_name", F.col("p_partkey").cast("string"))), "0123456789abcdef", "ACGTCGCGACGTCGCG")
    x = table(spark, d, "part").select("p_partkey", q.alias("q"))
    at = F.filter(F.sequence(F.lit(0), F.length("q") - 2), lambda i: F.substring(F.col("q"), i + 1, F.lit(2)) == "CG")
    return x.select("p_partkey", F.explode(at).alias("pos"))


@query(
    "e10_pooled_insertions",
    f"""with {IV}, x as (select contig, sample, cast(s // 50 * 50 as integer) as pos, count(*) as n, round(avg(e - s)) as len from iv group by all) select contig, pos, cast(sum(n) as bigint) as n, round(sum(len * n) / sum(n), 3) as len from x group by all""",
)
def e10(spark, d: str) -> DataFrame:
    rows = ca.intervals(spark, d)
    x = rows.groupBy("contig", "sample", (F.floor(F.col("s") / 50) * 50).cast("int").alias("pos")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("e") - F.col("s"))).alias("len"))
    return x.groupBy("contig", "pos").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("len") * F.col("n")) / F.sum("n"), 3).alias("len"))
