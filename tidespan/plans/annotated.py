"""Annotation joins, boundary counts and summaries on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidespan.operators import annotation as an
from tidespan.plans import carriers as ca
from tidespan.plans.carriers import CALLS, EXONS, GENES, IV, PART_CHROM
from tidespan.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query(
    "d10_dgv_hits",
    f"""with {CALLS}, r as (select p_partkey as record, {PART_CHROM}, cast(85000 + p_partkey * 19 % 30000 as integer) as os, cast(85000 + p_partkey * 19 % 30000 + 40 + p_size * 12 as integer) as oe, case p_partkey % 3 when 0 then 'loss' when 1 then 'gain' else 'both' end as type from part),
    x as (select call, record, s, e, os, oe, os + 10 as i1, oe - 10 as i2, greatest(0, least(e, oe) - greatest(s, os)) / greatest(1, e - s)::double as co, greatest(0, least(e, oe - 10) - greatest(s, os + 10)) / greatest(1, e - s)::double as ci from calls join r on r.chrom = calls.chrom and s < oe and os < e and s < e and (type = kind or type = 'both')),
    y as (select *, ci >= co as inner_best, i1 >= s and i2 <= e and i2 > i1 as inner_in, os >= s and oe <= e and oe > os as outer_in from x),
    z as (select *, case when greatest(ci, co) >= 0.8 then case when inner_best then 'i' else 'o' end when outer_in and (not inner_in or co > ci) then 'o' when inner_in then 'i' when outer_in then 'o' end as w from y)
    select call, record, round(case w when 'i' then ci else co end, 6) as cover, case when (case w when 'i' then i1 else os end) <= s and (case w when 'i' then i2 else oe end) >= e then 'within' when s <= (case w when 'i' then i1 else os end) and e >= (case w when 'i' then i2 else oe end) then 'contains' else 'overlaps' end as rel from z where w is not null""",
)
def d10(spark, d: str) -> DataFrame:
    s = (F.lit(85000) + F.col("p_partkey") * 19 % 30000).cast("int")
    kind = F.when(F.col("p_partkey") % 3 == 0, "loss").when(F.col("p_partkey") % 3 == 1, "gain").otherwise("both")
    e = (s + 40 + F.col("p_size") * 12).cast("int")
    r = table(spark, d, "part").select(F.col("p_partkey").alias("record"), ca.part_chrom(), s.alias("os"), e.alias("oe"), (s + 10).alias("is_"), (e - 10).alias("ie"), kind.alias("type"))
    return an.dgv_hits(ca.calls(spark, d), r).withColumn("cover", F.round("cover", 6))


@query("m04_dosage_readings", "select p_partkey, case p_partkey % 3 when 0 then case when hi = 3 then 'high' when hi = 2 then 'moderate' when hi in (30, 40) then 'low' end when 1 then case when ts = 3 then 'high' when ts = 2 then 'moderate' when ts is not null then 'low' end else case when hi = 3 or ts = 3 then 'moderate' end end as reading from (select p_partkey, [0, 1, 2, 3, 30, 40][p_size % 6 + 1] as hi, [0, 2, 3, 40][p_size % 4 + 1] as ts from part)")
def m04(spark, d: str) -> DataFrame:
    pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), F.col("p_size") % len(xs))
    effect = F.get(F.array(F.lit("loss"), F.lit("gain"), F.lit("moved")), (F.col("p_partkey") % 3).cast("int"))
    return table(spark, d, "part").select("p_partkey", an.dosage_reading(effect, pick([0, 1, 2, 3, 30, 40]), pick([0, 2, 3, 40])).alias("reading"))


@query(
    "d05_reads_at_sites",
    f"""with {IV}, {GENES}, x as (select gene, least(gs - s, e - 1 - gs) as to_end, allele from genes g join iv i on i.contig = g.contig and s <= gs and gs < e) select gene, count(*) as depth, count(*) filter (where allele = 'R') as alt, count(*) filter (where to_end < 10) as near_end from x group by gene""",
)
def d05(spark, d: str) -> DataFrame:
    sites = ca.genes(spark, d).select("gene", "contig", F.col("gs").alias("pos"))
    return an.site_depths(ca.intervals(spark, d), sites, ["contig"], "gene", F.col("allele") == "R")


@query(
    "e02_boundary_spanning",
    f"""with {IV}, {EXONS}, b as (select contig, 'intronStart' as side, xe as pos from exons union all select contig, 'intronEnd', xs from exons)
    select b.contig, side, pos, count(*) as n from b join iv i on i.contig = b.contig and s <= pos and pos < e and s <= pos - case side when 'intronStart' then 6 else 10 end and e >= pos + case side when 'intronStart' then 10 else 6 end group by all""",
)
def e02(spark, d: str) -> DataFrame:
    x = ca.exons(spark, d)
    b = x.select("contig", F.lit("intronStart").alias("side"), F.col("xe").alias("pos")).union(x.select("contig", F.lit("intronEnd"), "xs"))
    return an.boundary_spanning(ca.intervals(spark, d), b, ["contig"])


@query(
    "e09_pool_spanning",
    f"""with {IV}, {EXONS}, b as (select contig, 'intronStart' as side, xe as pos from exons union all select contig, 'intronEnd', xs from exons),
    n as (select b.contig, sample, side, pos, count(*) as n from b join iv i on i.contig = b.contig and s <= pos and pos < e and s <= pos - case side when 'intronStart' then 6 else 10 end and e >= pos + case side when 'intronStart' then 10 else 6 end group by all)
    select contig, side, pos, cast(sum(n) as bigint) as n, count(distinct sample) as samples from n group by all""",
)
def e09(spark, d: str) -> DataFrame:
    x, iv = ca.exons(spark, d), ca.intervals(spark, d)
    ends = F.inline(F.array(F.struct(F.lit("intronStart").alias("side"), F.col("xe").alias("pos")), F.struct(F.lit("intronEnd").alias("side"), F.col("xs").alias("pos"))))
    b = x.select("contig", F.explode(F.array(*[F.lit(c) for c in ca.CHROMS])).alias("sample"), "xs", "xe").select("contig", "sample", ends)
    return an.pooled_spanning(an.boundary_spanning(iv, b, ["contig", "sample"]), ["contig"])


@query(
    "e52_inheritance_modes",
    "select gene, case max(k) when 4 then 'XLR' else case when bool_or(k = 0) and bool_or(k = 1) then 'AD+AR' when bool_or(k = 0) then 'AD' when bool_or(k = 1) then 'AR' else '?' end end as mode, count(*) as sources from (select p_size as gene, case when p_size = 7 then 4 else p_partkey % 3 end as k from part) group by gene",
)
def e52(spark, d: str) -> DataFrame:
    texts = F.array(F.lit("MONOALLELIC, autosomal or pseudoautosomal"), F.lit("BIALLELIC, autosomal or pseudoautosomal"), F.lit("Unknown"))
    text = F.when(F.col("p_size") == 7, "X-LINKED: hemizygous mutation in males").otherwise(F.get(texts, (F.col("p_partkey") % 3).cast("int")))
    return an.modes_of_inheritance(table(spark, d, "part").select(F.col("p_size").alias("gene"), text.alias("text")))


@query(
    "e39_allelic_junctions",
    f"""with {IV}, c as (select contig, cast(s // 400 * 400 as integer) as s, cast(s // 400 * 400 + 400 as integer) as e, case strand when 'O' then 1 else 2 end as hap, count(*) filter (where allele = 'R') as used, count(*) as reads from iv group by all),
    g as (select contig, s, e, sum(case when hap = 1 then used else 0 end) as u1, sum(case when hap = 1 then reads else 0 end) as r1, sum(case when hap = 2 then used else 0 end) as u2, sum(case when hap = 2 then reads else 0 end) as r2 from c group by all),
    k as (select *, lgamma(r1 + 1) + lgamma(r2 + 1) + lgamma(u1 + u2 + 1) + lgamma(r1 + r2 - u1 - u2 + 1) - lgamma(r1 + r2 + 1) as k from g),
    x as (select *, unnest(range(cast(greatest(0, u1 + u2 - r2) as bigint), cast(least(r1, u1 + u2) + 1 as bigint))) as i from k),
    q as (select contig, s, e, exp(k - lgamma(i + 1) - lgamma(r1 - i + 1) - lgamma(u1 + u2 - i + 1) - lgamma(r2 - u1 - u2 + i + 1)) as pi, exp(k - lgamma(u1 + 1) - lgamma(r1 - u1 + 1) - lgamma(u2 + 1) - lgamma(r2 - u2 + 1)) as pa from x),
    f as (select contig, s, e, least(1.0, sum(case when pi <= pa * (1 + 1e-7) then pi else 0 end)) as p from q group by all),
    z as (select g.*, case when r1 = 0 or r2 = 0 or u1 + u2 = 0 or u1 + u2 = r1 + r2 then 1.0 else p end as p, coalesce(u1 / nullif(r1, 0)::double, 0) as w1, coalesce(u2 / nullif(r2, 0)::double, 0) as w2 from g left join f on f.contig = g.contig and f.s = g.s and f.e = g.e)
    select contig, s, e, round(w1, 6) as use1, round(w2, 6) as use2, round(abs(w1 - w2), 6) as delta, round(p, 5) as p, r1 >= 3 and r2 >= 3 and p < 0.001 and abs(w1 - w2) >= 0.2 as allelic from z""",
)
def e39(spark, d: str) -> DataFrame:
    s = (F.floor(F.col("s") / 400) * 400).cast("int")
    hap = F.when(F.col("strand") == "O", 1).otherwise(2)
    c = ca.intervals(spark, d).groupBy("contig", s.alias("s"), (s + 400).alias("e"), hap.alias("hap")).agg(F.count_if(F.col("allele") == "R").alias("used"), F.count(F.lit(1)).alias("reads"))
    return an.allelic_junctions(c, ["contig"]).select("contig", "s", "e", *[F.round(x, 6).alias(x) for x in ("use1", "use2", "delta")], F.round("p", 5).alias("p"), "allelic")


BUILDS = {"GRCh38": 248956422, "GRCh37": 249250621, "T2T-CHM13": 248387328, "NCBI36": 247249719}
NAMED = {"hg19": "GRCh37", "GRCh38.p13": "GRCh38", "hs37d5": "GRCh37", "mm10": None}


@query(
    "c13_assemblies",
    f"""with x as (select p_partkey, {list(BUILDS)}[p_size % 5 + 1] as by_length, {['' if v is None else v for v in NAMED.values()]}[p_partkey % 5 + 1] as named from part)
    select p_partkey, case when p_partkey % 5 < 4 and named <> '' then named else by_length end as build from x""",
)
def c13(spark, d: str) -> DataFrame:
    """Headers of parts: the first chromosome's length by size (every fifth is no build's), the assembly's name by key (every fifth has none), among other contigs."""
    k, n = F.col("p_partkey"), F.col("p_size")
    get = lambda xs, i: F.get(F.array(*[F.lit(x) for x in xs]), i.cast("int"))
    one = F.concat(F.lit("@SQ\tSN:"), F.when(n % 2 == 0, "chr1").otherwise("1"), F.lit("\tLN:"), F.coalesce(get(list(BUILDS.values()), n % 5), n.cast("int")).cast("string"))
    other = F.concat(F.lit("@SQ\tSN:chr1"), (1 + n % 9).cast("string"), F.lit("\tLN:248956422"), F.coalesce(F.concat(F.lit("\tAS:"), get(list(NAMED), k % 5)), F.lit("")))
    header = F.concat_ws("\n", F.lit("@HD\tVN:1.6"), F.when(k % 2 == 0, one).otherwise(other), F.when(k % 2 == 0, other).otherwise(one))
    return table(spark, d, "part").select("p_partkey", an.assembly(header).alias("build"))


@query("c06_arc_support", f"with {IV} select contig, count(*) filter (where s % 40 = 0 and e % 40 = 0) as junction, count(*) filter (where abs(s - floor((s + 20) / 40) * 40) <= 5 and abs(e - floor((e + 20) / 40) * 40) <= 5) as deletion from iv group by contig")
def c06(spark, d: str) -> DataFrame:
    s, e = F.col("s"), F.col("e")
    a, b = F.floor((s + 20) / 40) * 40, F.floor((e + 20) / 40) * 40
    count = lambda kind: F.count_if(an.supports(F.lit(kind), s, e, a, b)).alias(kind)
    return ca.intervals(spark, d).groupBy("contig").agg(count("junction"), count("deletion"))
