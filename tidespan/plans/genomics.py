"""Junction, site, methylation, evidence and copy-number operators on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidespan.functions import stats
from tidespan.operators import cgh, evidence, intervals, sites
from tidespan.operators import junctions as jn
from tidespan.plans import carriers as ca
from tidespan.plans.carriers import CALLS, EXONS, GENES, IV, JUNCTIONS, PART_CHROM
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


POOLED = f"with {JUNCTIONS}, {EXONS}, pooled as (select contig, s, e, cast(sum(n) as bigint) as n, count(distinct sample) as samples from junctions group by all)"
CLASSED = (
    POOLED
    + """, classed as (select p.*, l.rank as left_exon, r.rank as right_exon, case when r.rank = l.rank + 1 then 'canonical' when r.rank > l.rank then 'exon_skipping'
    when l.rank is not null and r.rank is not null then 'novel' when l.rank is not null then 'novel_acceptor' when r.rank is not null then 'novel_donor' else 'novel' end as cls
    from pooled p left join exons l on l.contig = p.contig and l.xe = p.s left join exons r on r.contig = p.contig and r.xs = p.e)"""
)


def pooled(spark, d: str) -> DataFrame:
    return jn.pooled(ca.junctions(spark, d), ["contig"])


@query("e08_pool_junctions", POOLED + " select contig, s, e, n, samples from pooled")
def e08(spark, d: str) -> DataFrame:
    return pooled(spark, d).select("contig", "s", "e", "n", "samples")


@query("e12_classify_junctions", CLASSED + " select contig, s, e, n, left_exon, right_exon, cls from classed")
def e12(spark, d: str) -> DataFrame:
    return jn.classified(pooled(spark, d), ca.exons(spark, d), "contig").select("contig", "s", "e", "n", "left_exon", "right_exon", "cls")


@query(
    "e13_exon_psi",
    POOLED + """, x as (select x.contig, rank, sum(case when e = xs then n else 0 end) as up, sum(case when e <> xs and s = xe then n else 0 end) as down, sum(case when e <> xs and s <> xe and s < xs and e > xe then n else 0 end) as exclusion
    from exons x join pooled p on p.contig = x.contig and (e = xs or s = xe or (s < xs and e > xe)) group by all)
    select contig, rank, cast(up as bigint) as up, cast(down as bigint) as down, cast(exclusion as bigint) as exclusion, round(case when (up + down) / 2.0 + exclusion > 0 then (up + down) / 2.0 / ((up + down) / 2.0 + exclusion) end, 6) as psi from x""",
)
def e13(spark, d: str) -> DataFrame:
    return jn.exon_psi(pooled(spark, d), ca.exons(spark, d), "contig").withColumn("psi", F.round("psi", 6))


@query(
    "e14_site_usage",
    POOLED + """, x as (select x.contig, rank, sum(case when e = xs then n else 0 end) as li, sum(case when s < xs and e > xs then n else 0 end) as lo, sum(case when s = xe then n else 0 end) as ri, sum(case when s < xe and e > xe then n else 0 end) as ro
    from exons x join pooled p on p.contig = x.contig and s <= xe and e >= xs group by all), y as (select *, case when li + lo > 0 then li / (li + lo)::double end as a, case when ri + ro > 0 then ri / (ri + ro)::double end as b from x)
    select contig, rank, round(a, 6) as left_usage, round(b, 6) as right_usage, round(coalesce((a + b) / 2, a, b), 6) as usage from y""",
)
def e14(spark, d: str) -> DataFrame:
    u = jn.site_usage(pooled(spark, d), ca.exons(spark, d), "contig")
    return u.select("contig", "rank", *[F.round(c, 6).alias(c) for c in ("left_usage", "right_usage", "usage")])


@query(
    "e15_psi5_psi3",
    POOLED + " select contig, s, e, n, round(n / (sum(n) over (partition by contig, s))::double, 6) as psi5, round(n / (sum(n) over (partition by contig, e))::double, 6) as psi3 from pooled",
)
def e15(spark, d: str) -> DataFrame:
    j = jn.psi5_psi3(pooled(spark, d), ["contig"])
    return j.select("contig", "s", "e", "n", F.round("psi5", 6).alias("psi5"), F.round("psi3", 6).alias("psi3"))


@query(
    "e16_alternative_share",
    CLASSED + """, i as (select a.contig, a.rank as k, coalesce(p.n, 0) as c from exons a join exons b on b.contig = a.contig and b.rank = a.rank + 1 left join pooled p on p.contig = a.contig and p.s = a.xe and p.e = b.xs),
    x as (select c.*, case when left_exon is not null and right_exon is not null then case when right_exon > left_exon + 1 then (f.c + g.c) / 2.0 end when left_exon is not null then f.c when right_exon is not null then g.c end as canonical
      from classed c left join i f on f.contig = c.contig and f.k = left_exon left join i g on g.contig = c.contig and g.k = right_exon - 1)
    select contig, s, e, cast(canonical as double) as canonical, round(case when n + canonical > 0 then n / (n + canonical)::double end, 6) as share from x""",
)
def e16(spark, d: str) -> DataFrame:
    a = jn.alternative_share(pooled(spark, d).select("contig", "s", "e", "n"), ca.exons(spark, d), "contig")
    return a.select("contig", "s", "e", "canonical", F.round("share", 6).alias("share"))


@query(
    "e11_intron_shares",
    CLASSED + """, i as (select a.contig, a.rank as k, a.xe as a, b.xs as b from exons a join exons b on b.contig = a.contig and b.rank = a.rank + 1),
    t as (select i.contig, k, sum(case when s = a and e = b then n else 0 end) as c, sum(case when not (s = a and e = b) and cls <> 'exon_skipping' then n else 0 end) as alt, sum(case when cls = 'exon_skipping' then n else 0 end) as skip,
      count(*) filter (where cls = 'exon_skipping') as n_skips, max(case when cls = 'exon_skipping' then s end) as ss, max(case when cls = 'exon_skipping' then e end) as se, max(case when cls = 'exon_skipping' then n end) as sn
      from i join classed c on c.contig = i.contig and (c.s = a or c.e = b) group by all),
    o as (select t.*, o.c as c2 from t left join t o on o.contig = t.contig and o.k <> t.k and t.n_skips = 1 and o.n_skips = 1 and o.ss = t.ss and o.se = t.se and t.alt = 0 and o.alt = 0)
    select contig, k, cast(c + alt + skip as bigint) as total, round(case when c2 is not null then (c + c2) / (c + c2 + 2 * sn)::double else c / (c + alt + skip)::double end, 6) as canonical_share from o""",
)
def e11(spark, d: str) -> DataFrame:
    return jn.intron_shares(pooled(spark, d).select("contig", "s", "e", "n"), ca.exons(spark, d), "contig").withColumn("canonical_share", F.round("canonical_share", 6))


@query("b11_introns", f"with {EXONS} select * from (select contig, rank, xe as s, lead(xs) over (partition by contig order by xs) as e from exons) where e is not null")
def b11(spark, d: str) -> DataFrame:
    return jn.introns(ca.exons(spark, d), "contig")


@query(
    "w03_exon_phases",
    f"""with {EXONS}, x as (select contig, rank, xs, xe, greatest(xs, 9190) as a, least(xe, 11500) as b from exons where greatest(xs, 9190) < least(xe, 11500)), y as (select *, sum(b - a) over (partition by contig order by xs) as r from x)
    select contig, rank, b - a as cds, cast((r - (b - a)) % 3 as bigint) as phase_in, cast(r % 3 as bigint) as phase_out, xs <= 9190 and 9190 < xe as has_start, xs < 11500 and 11500 <= xe as has_stop, (b - a) % 3 = 0 as symmetric from y""",
)
def w03(spark, d: str) -> DataFrame:
    return jn.exon_phases(ca.exons(spark, d), "contig", 9190, 11500)


@query("m07_snap_junctions")
def m07(spark, d: str) -> DataFrame:
    grid = ca.intervals(spark, d).groupBy("contig", (F.floor(F.col("s") / 5) * 5).cast("int").alias("s"), (F.floor(F.col("e") / 30) * 30).cast("int").alias("e")).agg(F.count(F.lit(1)).alias("n"))
    return jn.snapped(grid, "contig")


@query("w07_nesting_levels")
def w07(spark, d: str) -> DataFrame:
    return jn.nested(pooled(spark, d), "contig")


ALLELES = f"""with {IV}, c as (select contig, site, allele as alt, count(*) as n, count(*) filter (where strand = 'O') as p, count(*) filter (where mapq < 20) as q from iv group by all), t as (select contig, site, sum(n) as an, sum(p) as ap, sum(q) as aq from c group by all),
  sites as (select c.contig, c.site, alt, n as alt_count, cast(an as bigint) as depth, n / an::double as vaf, p / n::double as fwd, case when an > n then (ap - p) / (an - n)::double end as fwd_ref, q / n::double as low_mq, case when an > n then (aq - q) / (an - n)::double end as low_mq_ref
    from c join t on t.contig = c.contig and t.site = c.site where alt <> 'N')"""


def sites_of(spark, d: str) -> DataFrame:
    return sites.allele_counts(ca.intervals(spark, d), ["contig", "site"], "N", F.col("strand") == "O")


@query("e20_e23_allele_counts", ALLELES + " select contig, site, alt, alt_count, depth, round(vaf, 6) as vaf, round(fwd, 6) as fwd, round(fwd_ref, 6) as fwd_ref, round(low_mq, 6) as low_mq, round(low_mq_ref, 6) as low_mq_ref from sites")
def e20(spark, d: str) -> DataFrame:
    return sites_of(spark, d).select("contig", "site", "alt", "alt_count", "depth", *[F.round(c, 6).alias(c) for c in ("vaf", "fwd", "fwd_ref", "low_mq", "low_mq_ref")])


@query("e21_called_sites", ALLELES + " select contig, site, alt, alt_count, depth, round(vaf, 6) as vaf from sites where alt_count >= 3 and vaf >= 0.2")
def e21(spark, d: str) -> DataFrame:
    return sites.called(sites_of(spark, d)).select("contig", "site", "alt", "alt_count", "depth", F.round("vaf", 6).alias("vaf"))


@query(
    "x21_mapping_checks",
    ALLELES + """, z as (select *, coalesce(low_mq_ref, 0) as r from sites) select contig, site, alt, case when low_mq >= 0.5 and low_mq - r >= 0.3 then 'bad' when (low_mq >= 0.2 and low_mq - r >= 0.15) or r >= 0.5 then 'warn' else 'good' end as level from z""",
)
def x21(spark, d: str) -> DataFrame:
    return sites_of(spark, d).select("contig", "site", "alt", sites.quality_level().alias("level"))


HAPS = f"""with {IV}, b as (select site, ps, count(*) filter (where strand = 'O') as d1, count(*) filter (where strand <> 'O') as d2, count(*) filter (where strand = 'O' and allele = 'R') as a1, count(*) filter (where strand <> 'O' and allele = 'R') as a2 from (select site, ps % 3 as ps, strand, allele from iv) group by all),
  r as (select *, row_number() over (partition by site order by d1 + d2 desc, ps) as k, sum(a1 + a2) over (partition by site) as alts from b), haps as (select site, ps, d1, d2, a1, a2, cast(alts - a1 - a2 as bigint) as other_alt from r where k = 1)"""


def haps(spark, d: str) -> DataFrame:
    rows = ca.intervals(spark, d).withColumn("ps", F.col("ps") % 3)
    return sites.haplotype_pick(rows, ["site"], F.col("allele") == "R", F.when(F.col("strand") == "O", 1).otherwise(2))


@query("e24_haplotype_pick", HAPS + " select * from haps")
def e24(spark, d: str) -> DataFrame:
    return haps(spark, d)


@query(
    "x20_site_phase",
    HAPS + """ select site, case when d1 < 3 or d2 < 3 then 'thin' when x1 >= 0.7 and x2 >= 0.7 then 'both' when x1 >= 0.7 and x2 <= 0.2 then 'h1' when x2 >= 0.7 and x1 <= 0.2 then 'h2' when x1 <= 0.2 and x2 <= 0.2 then 'neither' else 'check' end as call
    from (select *, a1 / nullif(d1, 0)::double as x1, a2 / nullif(d2, 0)::double as x2 from haps)""",
)
def x20(spark, d: str) -> DataFrame:
    return haps(spark, d).select("site", sites.site_phase().alias("call"))


@query("e25_haplotag_totals", f"with {IV} select contig, count(*) filter (where ps is not null) as tagged, count(distinct ps) as sets from iv group by contig")
def e25(spark, d: str) -> DataFrame:
    return ca.intervals(spark, d).groupBy("contig").agg(F.count("ps").alias("tagged"), F.countDistinct("ps").alias("sets"))


@query(
    "e41_pair_table",
    f"""with {IV}, a as (select distinct contig, name, allele = 'R' as x from iv where line = 1), b as (select distinct contig, name, allele = 'R' as y from iv where line = 2)
    select a.contig, count(*) filter (where x and y) as both, count(*) filter (where x and not y) as only_a, count(*) filter (where not x and y) as only_b, count(*) filter (where not x and not y) as none from a join b on b.contig = a.contig and b.name = a.name group by all""",
)
def e41(spark, d: str) -> DataFrame:
    rows = ca.intervals(spark, d)
    side = lambda n: rows.where(F.col("line") == n).select("contig", "name", (F.col("allele") == "R").alias("alt")).distinct()
    return sites.pair_table(side(1), side(2), ["contig"])


@query("e26_confidence_counts", f"with {IV} select contig, cast(s // 100 as integer) as block, strand as hap, mapq % 16 as bin, count(*) filter (where allele = 'R') as modified, count(*) as total from iv group by all")
def e26(spark, d: str) -> DataFrame:
    rows = ca.intervals(spark, d).select("contig", F.floor(F.col("s") / 100).cast("int").alias("block"), F.col("strand").alias("hap"), (F.col("mapq") % 16).alias("bin"), (F.col("allele") == "R").alias("modified"))
    return sites.confidence_counts(rows, ["contig", "block"])


@query(
    "e27_threshold_bins",
    f"""with {IV}, h as (select contig, cast(s // 100 as integer) as block, mapq % 16 as bin, count(*) as n from iv group by all), r as (select *, sum(n) over (partition by contig, block order by bin) as t, sum(n) over (partition by contig, block) as a from h)
    select contig, block, min(bin) as threshold from r where t >= a * 0.1 group by all""",
)
def e27(spark, d: str) -> DataFrame:
    rows = ca.intervals(spark, d).select("contig", F.floor(F.col("s") / 100).cast("int").alias("block"), (F.col("mapq") % 16).alias("bin"))
    return sites.threshold_bins(rows, ["contig", "block"])


@query(
    "w05_cpg_islands",
    """with d as (select p_partkey as part, translate(md5(p_name) || md5(p_brand || p_partkey) || md5(p_type) , '0123456789abcdef', 'ACGTCGCGACGTCGCG') as q from part),
    b as (select part, i - 1 as i, q[i] as c, case when i > 1 then q[i - 1] end as p from d, range(1, 97) t(i)),
    w as (select part, i, sum((c = 'C')::int) over x as nc, sum((c = 'G')::int) over x as ng, sum((c = 'G' and p = 'C')::int) over y as ncg from b
      window x as (partition by part order by i rows 39 preceding), y as (partition by part order by i rows 38 preceding)),
    g as (select part, i - 39 as s, i + 1 as e from w where i >= 39 and nc + ng >= 20 and ncg * 40 >= 0.6 * nc * ng and nc * ng > 0),
    m as (select *, max(e) over (partition by part order by s, e rows between unbounded preceding and 1 preceding) as reach from g), n as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by part order by s, e rows unbounded preceding) as k from m)
    select part, cast(min(s) as integer) as s, cast(max(e) as integer) as e, count(*) as members from n group by part, k""",
)
def w05(spark, d: str) -> DataFrame:
    p = table(spark, d, "part")
    dna = F.translate(F.concat(F.md5("p_name"), F.md5(F.concat("p_brand", F.col("p_partkey").cast("string"))), F.md5("p_type")), "0123456789abcdef", "ACGTCGCGACGTCGCG")
    return sites.islands(p.select(F.col("p_partkey").alias("part"), dna.alias("q")), "part", "q", width=40)


def arcs(spark, d: str) -> DataFrame:
    return ca.intervals(spark, d).groupBy("contig", "s", "e").agg(F.count(F.lit(1)).alias("n"))


@query("e30_cluster_events")
def e30(spark, d: str) -> DataFrame:
    return evidence.clustered(arcs(spark, d), "contig")


@query("e31_pool_pair_arcs")
def e31(spark, d: str) -> DataFrame:
    kind = F.when(F.col("s") % 3 == 0, "deletion").when(F.col("s") % 3 == 1, "duplication").otherwise("inversion")
    return evidence.pooled_pairs(arcs(spark, d).withColumn("kind", kind), "contig")


@query("e32_breakend_clusters")
def e32(spark, d: str) -> DataFrame:
    return evidence.breakends(ca.intervals(spark, d).groupBy("contig", F.col("s").alias("pos")).agg(F.count(F.lit(1)).alias("n")), "contig")


@query("w08_row_packing")
def w08(spark, d: str) -> DataFrame:
    return evidence.packed_rows(ca.intervals(spark, d), "contig", (1 << 31) - 1)


@query("d02_mate_pairs")
def d02(spark, d: str) -> DataFrame:
    r = intervals.ranked(ca.intervals(spark, d), ["contig"], "s", "e", "name", "line", "site", stretch=16)
    i = (F.col("rank") + 1).cast("long")
    one = r.select("contig", F.col("name").cast("string").alias("name"), F.col("s"), F.col("e").alias("mate_s"), F.lit(64).alias("bits"), (F.col("e") - F.col("s")).alias("tlen"), i.alias("id"))
    two = one.select("contig", "name", F.col("mate_s").alias("s"), F.col("s").alias("mate_s"), F.lit(128).alias("bits"), (-F.col("tlen")).alias("tlen"), (F.col("id") + (1 << 40)).alias("id"))
    return evidence.mates(one.union(two), "contig")


@query("e47_repeat_alleles")
def e47(spark, d: str) -> DataFrame:
    return evidence.repeat_alleles(ca.intervals(spark, d).select((F.col("site") % 500).alias("site"), F.col("mapq").alias("units")), "site")


@query(
    "c09_call_filter",
    f"with {CALLS} select call, patient, chrom, kind, e - s as size from calls where kind <> 'loh' and e - s >= 150 and (patient % 7 <> 0 or patient % 7 is null) and chrom like '%-%'",
)
def c09(spark, d: str) -> DataFrame:
    c = ca.calls(spark, d).withColumn("size", F.col("e") - F.col("s"))
    keep = cgh.passes(kinds=["loss", "gain"], min_size=150, query="-")
    return c.where(keep & ((F.col("patient") % 7 != 0) | F.col("patient").isNull())).select("call", "patient", "chrom", "kind", "size")


@query(
    "d14_lab_benign",
    f"""with {CALLS}, lab as (select p_partkey as entry, {PART_CHROM}, cast(85000 + p_partkey * 29 % 30000 as integer) as ls, cast(85000 + p_partkey * 29 % 30000 + 50 + p_size * 8 as integer) as le, case p_partkey % 3 when 0 then 'loss' when 1 then 'gain' else 'both' end as type from part),
    x as (select call, entry, (least(e, le) - greatest(s, ls) + 1) / (e - s + 1)::double as pct from calls join lab on lab.chrom = calls.chrom and (type = 'both' or type = kind) and s <= le and ls <= e)
    select call, entry, round(pct, 6) as pct from (select *, row_number() over (partition by call order by pct desc, entry) as k from x where pct >= 0.8) where k = 1""",
)
def d14(spark, d: str) -> DataFrame:
    p = table(spark, d, "part")
    s = (F.lit(85000) + F.col("p_partkey") * 29 % 30000).cast("int")
    kind = F.when(F.col("p_partkey") % 3 == 0, "loss").when(F.col("p_partkey") % 3 == 1, "gain").otherwise("both")
    lab = p.select(F.col("p_partkey").alias("entry"), ca.part_chrom(), s.alias("ls"), (s + 50 + F.col("p_size") * 8).alias("le"), kind.alias("type"))
    return cgh.lab_matches(ca.calls(spark, d), lab).withColumn("pct", F.round("pct", 6))


@query(
    "d09_population_matches",
    f"""with {CALLS}, pop as (select p_partkey as sv, {PART_CHROM}, cast(85000 + p_partkey * 31 % 30000 as integer) as os, cast(85000 + p_partkey * 31 % 30000 + 60 + p_size * 8 as integer) as oe, case p_partkey % 4 when 0 then 'loss' when 1 then 'gain' when 2 then 'both' else 'unknown' end as type from part),
    x as (select call, sv, kind, type, greatest((least(e, oe) - greatest(s, os)) / greatest(e - s, oe - os, 1)::double, greatest(0, least(e, oe - 20) - greatest(s, os + 20)) / greatest(e - s, oe - os - 40, 1)::double) as ro, os + 20 <= s and oe - 20 >= e as covers from calls join pop on pop.chrom = calls.chrom and s < oe and os < e)
    select call, sv, round(ro, 6) as ro, covers, type in (kind, 'both', 'unknown') as same_type from x where ro >= 0.5""",
)
def d09(spark, d: str) -> DataFrame:
    p = table(spark, d, "part")
    s = (F.lit(85000) + F.col("p_partkey") * 31 % 30000).cast("int")
    kind = F.get(F.array(F.lit("loss"), F.lit("gain"), F.lit("both"), F.lit("unknown")), (F.col("p_partkey") % 4).cast("int"))
    e = s + 60 + F.col("p_size") * 8
    pop = p.select(F.col("p_partkey").alias("sv"), ca.part_chrom(), s.alias("os"), e.alias("oe"), (s + 20).alias("is_"), (e - 20).alias("ie"), kind.alias("type"))
    m = cgh.population_matches(ca.calls(spark, d), pop)
    return m.where("ro >= 0.5").select("call", "sv", F.round("ro", 6).alias("ro"), "covers", "same_type")


@query(
    "d11_recurrent_top4",
    f"""with {CALLS}, rec as (select p_partkey as region, {PART_CHROM}, cast(85000 + p_partkey * 13 % 30000 as integer) as rs, cast(85000 + p_partkey * 13 % 30000 + 60 + p_size * 8 as integer) as re from part),
    x as (select call, region, (least(e, re) - greatest(s, rs)) / (re - rs)::double as of_region, (least(e, re) - greatest(s, rs)) / (e - s)::double as of_call from calls join rec on rec.chrom = calls.chrom and s < re and rs < e where e > s),
    r as (select *, row_number() over (partition by call order by least(of_region, of_call) desc, region) as k from x where of_region >= 0.5 and of_call >= 0.5) select call, region, round(of_region, 6) as of_region, round(of_call, 6) as of_call from r where k <= 4""",
)
def d11(spark, d: str) -> DataFrame:
    s = (F.lit(85000) + F.col("p_partkey") * 13 % 30000).cast("int")
    rec = table(spark, d, "part").select(F.col("p_partkey").alias("region"), ca.part_chrom(), s.alias("rs"), (s + 60 + F.col("p_size") * 8).alias("re"))
    return cgh.recurrent(ca.calls(spark, d), rec).select("call", "region", F.round("of_region", 6).alias("of_region"), F.round("of_call", 6).alias("of_call"))


@query(
    "e53_topology",
    f"""with {CALLS}, x as (select call, s <= 85500 as p_end, e >= 114500 as q_end, greatest(0, least(e, 90000) - greatest(s, 85000)) / 5000.0 as cp, greatest(0, least(e, 115000) - greatest(s, 91000)) / 24000.0 as cq from calls)
    select call, p_end, q_end, case when cp >= 0.04 and cq >= 0.04 then 'chr' when cp >= 0.04 then 'p' when cq >= 0.04 then 'q' end as span from x""",
)
def e53(spark, d: str) -> DataFrame:
    calls = ca.calls(spark, d)
    arm = lambda name, a, z: F.struct(F.lit(name).alias("arm"), F.lit(a).alias("a"), F.lit(z).alias("z"), F.lit(True).alias("measured"))
    arms = calls.select("chrom").distinct().select("chrom", F.inline(F.array(arm("p", 85_000, 90_000), arm("q", 91_000, 115_000))))
    return cgh.topology(calls, arms, terminal=500, cover=0.04)


@query(
    "e49_priority_score",
    f"""with {CALLS}, {GENES}, g as (select gene, {ca.CHROMS}[gene % 5 + 1] as chrom, gs * 10 as a, ge * 10 + 200 as b, gene % 4 as hi, (gene * 7) % 4 as ts from genes),
    x as (select call, kind, e - s as size, count(gene) as n, coalesce(bool_or(hi = 3), false) as hi3, coalesce(bool_or(hi = 2), false) as hi2, coalesce(bool_or(ts = 3 and a >= s and b <= e), false) as ts3, coalesce(bool_or(ts = 2 and a >= s and b <= e), false) as ts2, coalesce(bool_or(not (a >= s and b <= e) and hi = 3), false) as cut3
      from calls left join g on g.chrom = calls.chrom and a < e and b > s where kind <> 'loh' group by all),
    r as (select call, kind, case when kind = 'loss' then case when hi3 or n >= 35 or size > 450 then 'high' when hi2 or n >= 25 then 'moderate' else 'low' end else case when ts3 or n >= 50 or size > 450 then 'high' when ts2 or cut3 or n >= 35 then 'moderate' else 'low' end end as level,
      list_filter([case when kind = 'loss' and hi3 then 'L1' end, case when kind = 'loss' and (n >= 35 or size > 450) then 'L5' end, case when kind = 'loss' and hi2 then 'L6' end, case when kind = 'loss' and n between 25 and 34 then 'L12' end,
        case when kind = 'gain' and ts3 then 'G1' end, case when kind = 'gain' and (n >= 50 or size > 450) then 'G3' end, case when kind = 'gain' and ts2 then 'G4' end, case when kind = 'gain' and cut3 then 'G5' end, case when kind = 'gain' and n between 35 and 49 then 'G7' end], lambda z: z is not null) as ids,
      n from x)
    select call, level, case when len(ids) > 0 then array_to_string(ids, ',') when n = 0 then case kind when 'loss' then 'L0' else 'G0' end else case kind when 'loss' then 'L13' else 'G8' end end as reasons from r""",
)
def e49(spark, d: str) -> DataFrame:
    g = ca.genes(spark, d).select("gene", ca.part_chrom("gene"), (F.col("gs") * 10).alias("a"), (F.col("ge") * 10 + 200).alias("b"), (F.col("gene") % 4).alias("hi"), (F.col("gene") * 7 % 4).alias("ts"))
    calls = ca.calls(spark, d).where("kind <> 'loh'")
    # calls that are alike are asked for once, and genes that are alike are counted first
    alike = ["chrom", "s", "e"]
    like = g.groupBy("chrom", "a", "b", "hi", "ts").agg(F.count(F.lit(1)).alias("n"))
    hits = intervals.overlap_join(calls.select(*alike).distinct(), like, ["chrom"], ("s", "e"), ("a", "b"), 512)
    whole = (F.col("a") >= F.col("s")) & (F.col("b") <= F.col("e"))
    found = hits.groupBy(*alike).agg(
        F.sum("n").alias("n"), F.bool_or(F.col("hi") == 3).alias("hi3"), F.bool_or(F.col("hi") == 2).alias("hi2"),
        F.bool_or((F.col("ts") == 3) & whole).alias("ts3"), F.bool_or((F.col("ts") == 2) & whole).alias("ts2"), F.bool_or(~whole & (F.col("hi") == 3)).alias("cut3"),
    )
    facts = intervals.given_back(found, calls, alike, "call").groupBy("call").agg(F.sum("n").alias("n"), *[F.bool_or(c).alias(c) for c in ("hi3", "hi2", "ts3", "ts2", "cut3")])
    scored = cgh.scored(calls.withColumn("size_kb", F.col("e") - F.col("s")).join(facts, "call", "left").fillna({"n": 0}), big_kb=450)
    return scored.select("call", "level", F.array_join(F.transform("reasons", lambda r: r["id"]), ",").alias("reasons"))


@query(
    "x04_chromosome_names",
    "select p_partkey, case when regexp_matches(x, '^(chr)?([1-9]|1[0-9]|2[0-2]|X|Y|M)$', 'i') then 'chr' || upper(regexp_extract(x, '^(?:chr)?(.*)$', 1, 'i')) end as chrom from (select p_partkey, case p_partkey % 3 when 0 then 'chr' when 1 then 'CHR' else '' end || case p_partkey % 26 when 0 then 'x' when 25 then 'Y' else cast(p_partkey % 26 as varchar) end as x from part)",
)
def x04(spark, d: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 3 == 0, "chr").when(k % 3 == 1, "CHR").otherwise(""), F.when(k % 26 == 0, "x").when(k % 26 == 25, "Y").otherwise((k % 26).cast("string")))
    return table(spark, d, "part").select("p_partkey", cgh.chromosome(name).alias("chrom"))


@query("e34_state_runs", f"with {CALLS}, x as (select patient, s, case when kind = 'loh' then null else kind end as state, row_number() over (partition by patient order by s, call) as r from calls), y as (select *, r - row_number() over (partition by patient, state order by r) as g from x) select patient, state, min(r) as first, max(r) as last, count(*) as n from y where state is not null group by patient, state, g")
def e34(spark, d: str) -> DataFrame:
    x = ca.calls(spark, d).select("patient", F.when(F.col("kind") != "loh", F.col("kind")).alias("state"), F.row_number().over(Window.partitionBy("patient").orderBy("s", "call")).cast("long").alias("r"))
    return intervals.runs_of_state(x, ["patient"], "r", "state")
