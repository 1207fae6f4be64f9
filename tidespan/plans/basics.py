"""Sweeps, interval joins, merging, recurrence, pyramids, filters, medians and sampling on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidespan.functions import reads, stats
from tidespan.operators import intervals as iv
from tidespan.plans import carriers as ca
from tidespan.plans.carriers import CALLS, GENES, IV, JUNCTIONS, PART_CHROM
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


RUNS = """runs as (
  select contig, s, e, depth from (
    select contig, pos as s, lead(pos) over (partition by contig order by pos) as e, sum(d) over (partition by contig order by pos) as depth
    from (select contig, pos, sum(d) as d from (select contig, s as pos, 1 as d from iv union all select contig, e, -1 from iv) group by all having sum(d) <> 0))
  where depth <> 0 and e is not null)"""


@query("w01_depth_runs", f"with {IV}, {RUNS} select contig, s, e, cast(depth as bigint) as depth from runs")
def w01(spark, d: str) -> DataFrame:
    return iv.depth_runs(ca.intervals(spark, d), ["contig"])


@query("e01_depth_deltas", f"with {IV} select contig, pos, cast(sum(d) as bigint) as d from (select contig, s as pos, 1 as d from iv union all select contig, e, -1 from iv) group by all having sum(d) <> 0")
def e01(spark, d: str) -> DataFrame:
    return iv.deltas(ca.intervals(spark, d), ["contig"])


@query(
    "e04_dense_depth",
    f"with {IV}, {RUNS} select contig, cast(p as integer) as pos, cast(depth as bigint) as depth from runs, range(9500, 9700) r(p) where s <= p and p < e",
)
def e04(spark, d: str) -> DataFrame:
    return iv.dense_depth(iv.depth_runs(ca.intervals(spark, d), ["contig"]), ["contig"], 9500, 9700)


@query(
    "w02_depth_at",
    f"with {IV}, {RUNS} select g.gene, g.contig, cast(coalesce(max(depth), 0) as bigint) as depth from (select p_partkey as gene, contig, gs from (select * from part) join (with {GENES} select * from genes) on gene = p_partkey) g left join runs r on r.contig = g.contig and r.s <= g.gs and g.gs < r.e group by all",
)
def w02(spark, d: str) -> DataFrame:
    points = ca.genes(spark, d).select("gene", "contig", F.col("gs").alias("pos"))
    runs = iv.depth_runs(ca.intervals(spark, d), ["contig"])
    hit = iv.point_join(points, runs, ["contig"], "pos", ("s", "e")).select("gene", "depth")
    return points.join(hit, "gene", "left").select("gene", "contig", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))


@query(
    "e07_sum_coverage",
    f"""with {IV}, x as (select contig, pos, sum(d) as d from (select contig, s as pos, 1 as d from iv where strand = 'O' or sample <> '1-URGENT' union all select contig, e, -1 from iv where strand = 'O' or sample <> '1-URGENT') group by all having sum(d) <> 0)
    select contig, s, e, depth from (select contig, pos as s, lead(pos) over (partition by contig order by pos) as e, cast(sum(d) over (partition by contig order by pos) as bigint) as depth from x) where depth <> 0 and e is not null""",
)
def e07(spark, d: str) -> DataFrame:
    rows = ca.intervals(spark, d).where("strand = 'O' or sample <> '1-URGENT'")
    return iv.summed_runs(iv.depth_runs(rows, ["contig", "sample"]).select("contig", "sample", "s", "e", "depth"), ["contig"])


@query(
    "e06_strand_split",
    f"with {IV} select contig, mapq, count(*) filter (where strand = 'O') as plus, count(*) - count(*) filter (where strand = 'O') as minus, count(*) as n from iv group by all",
)
def e06(spark, d: str) -> DataFrame:
    plus = F.count_if(F.col("strand") == "O")
    return ca.intervals(spark, d).groupBy("contig", "mapq").agg(plus.alias("plus"), (F.count(F.lit(1)) - plus).alias("minus"), F.count(F.lit(1)).alias("n"))


@query("d01_overlap_join", f"with {IV}, {GENES} select gene, g.contig, count(*) as n, cast(sum(least(e, ge) - greatest(s, gs)) as bigint) as bases from iv i join genes g on g.contig = i.contig and s < ge and gs < e group by all")
def d01(spark, d: str) -> DataFrame:
    return iv.overlap_totals(ca.genes(spark, d), ca.intervals(spark, d), ["contig"], ("gs", "ge")).select("gene", "contig", "n", "bases")


@query(
    "e37_merged_blocks",
    f"""with {IV}, x as (select contig, sample, s, e, max(e) over (partition by contig, sample order by s, e rows between unbounded preceding and 1 preceding) as reach from iv),
    y as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by contig, sample order by s, e rows unbounded preceding) as g from x)
    select contig, sample, min(s) as s, max(e) as e, count(*) as members from y group by contig, sample, g""",
)
def e37(spark, d: str) -> DataFrame:
    return iv.merged(ca.intervals(spark, d), ["contig", "sample"])


@query(
    "h10_story_windows",
    f"""with {IV}, x as (select contig, s, e, max(e) over (partition by contig order by s, e rows between unbounded preceding and 1 preceding) as reach from iv),
    y as (select *, sum(case when reach is null or s > reach + 5 then 1 else 0 end) over (partition by contig order by s, e rows unbounded preceding) as g from x)
    select contig, min(s) as s, max(e) as e, count(*) as members from y group by contig, g""",
)
def h10(spark, d: str) -> DataFrame:
    return iv.merged(ca.intervals(spark, d), ["contig"], gap=5)


@query(
    "d08_recurrence",
    f"""with {CALLS}, p as (select a.call, b.patient as other, (least(a.e, b.e) - greatest(a.s, b.s) + 1)::double / greatest(a.e - a.s + 1, b.e - b.s + 1) as ro
      from calls a join calls b on a.chrom = b.chrom and a.kind = b.kind and a.patient <> b.patient and a.s <= b.e and b.s <= a.e)
    select call, other, cast(round(max(ro) * 100) as bigint) as pct from p where ro >= 0.7 group by all""",
)
def d08(spark, d: str) -> DataFrame:
    return iv.recurrence(ca.calls(spark, d))


TOLERANCE = "greatest(20, least(100, cast(floor(({1} - {0}) * 0.05 + 0.5) as integer)))"


@query(
    "d07_nearest_event",
    f"""with {CALLS}, ev as (select p_partkey as event, {PART_CHROM}, cast(85000 + p_partkey * 17 % 30000 as integer) as es, cast(85000 + p_partkey * 17 % 30000 + 100 + p_size * 5 as integer) as ee from part),
    x as (select call as id, event, abs(s - es) + abs(e - ee) as distance from calls c join ev on ev.chrom = c.chrom and abs(s - es) <= least({TOLERANCE.format("s", "e")}, {TOLERANCE.format("es", "ee")}) and abs(e - ee) <= least({TOLERANCE.format("s", "e")}, {TOLERANCE.format("es", "ee")}))
    select id, event, cast(distance as integer) as distance from (select *, row_number() over (partition by id order by distance, event) as k from x) where k = 1""",
)
def d07(spark, d: str) -> DataFrame:
    p = table(spark, d, "part")
    s = (F.lit(85000) + F.col("p_partkey") * 17 % 30000).cast("int")
    events = p.select(F.col("p_partkey").alias("event"), ca.part_chrom(), s.alias("es"), (s + 100 + F.col("p_size") * 5).alias("ee"))
    return iv.nearest(ca.calls(spark, d).select(F.col("call").alias("id"), "chrom", "s", "e"), events, ["chrom"])


@query(
    "d15_lift_positions",
    f"""with {GENES}, seg as (select contig, cast(9000 + i * 100 as integer) as ss, cast(9000 + i * 100 + 60 as integer) as se, 'L' || contig as to_contig, cast(i * 1000 as integer) as ts, i % 3 = 0 as reverse from (select unnest(['F', 'O', 'P']) as contig), range(25) r(i))
    select gene as id, g.contig, gs as pos, to_contig, case when reverse then ts + (se - 1 - gs) else ts + (gs - ss) end as to_pos from genes g left join seg on seg.contig = g.contig and ss <= gs and gs < se""",
)
def d15(spark, d: str) -> DataFrame:
    i = spark.range(25).withColumn("contig", F.explode(F.array(F.lit("F"), F.lit("O"), F.lit("P"))))
    seg = i.select("contig", (F.lit(9000) + F.col("id") * 100).cast("int").alias("ss"), (F.lit(9060) + F.col("id") * 100).cast("int").alias("se"), F.concat(F.lit("L"), "contig").alias("to_contig"), (F.col("id") * 1000).cast("int").alias("ts"), (F.col("id") % 3 == 0).alias("reverse"))
    points = ca.genes(spark, d).select(F.col("gene").alias("id"), "contig", F.col("gs").alias("pos"))
    return iv.lifted(points, seg, ["contig"])


@query(
    "p01_pyramid",
    f"""with {IV}, {RUNS}, l as (select *, level, cast(16 * 2 ** level as integer) as w from runs, range(6) t(level)),
    b as (select *, unnest(range(s // w, (e - 1) // w + 1)) as bin from l)
    select contig, cast(level as integer) as level, bin, cast(min(depth) as bigint) as low, cast(max(depth) as bigint) as high, cast(sum((least(e, (bin + 1) * w) - greatest(s, bin * w)) * depth) as bigint) as total from b group by all""",
)
def p01(spark, d: str) -> DataFrame:
    return iv.pyramid(iv.depth_runs(ca.intervals(spark, d), ["contig"]), ["contig"])


@query(
    "p02_range_stats",
    f"""with {IV}, {RUNS} select contig, cast(case when sum(least(e, 10400) - greatest(s, 9400)) < 1000 then 0 else min(depth) end as bigint) as low, cast(max(depth) as bigint) as high,
    round(sum((least(e, 10400) - greatest(s, 9400)) * depth) / 1000.0, 6) as mean from runs where s < 10400 and e > 9400 group by contig""",
)
def p02(spark, d: str) -> DataFrame:
    return iv.range_stats(iv.depth_runs(ca.intervals(spark, d), ["contig"]), ["contig"], 9400, 10400)


@query(
    "p02b_pixels",
    f"""with {IV}, {RUNS}, z as (select contig, p, depth from runs, range(9400, 9900) r(p) where s <= p and p < e)
    select contig, cast(floor((p - 9400) / 12.5) as integer) as px, cast(min(depth) as bigint) as low, cast(max(depth) as bigint) as high, round(avg(depth), 6) as mean, min(depth) < avg(depth) / 2 as low_tick from z group by all""",
)
def p02b(spark, d: str) -> DataFrame:
    return iv.pixels(iv.depth_runs(ca.intervals(spark, d), ["contig"]), ["contig"], 9400, 9900, 40)


@query(
    "c01_c03_read_filters",
    f"""with {IV} select contig, case when mapq < 1 then 0 when mapq < 10 then 1 when mapq < 20 then 2 when mapq < 30 then 3 else -1 end as bucket,
    case when mapq >= 30 then 30 when mapq >= 20 then 20 when mapq >= 10 then 10 when mapq >= 1 then 1 else 0 end as threshold, count(*) as n, count(*) filter (where (cast(name % 4096 as integer) & 1540) = 0) as kept_with_secondary
    from iv where (cast(name % 4096 as integer) & 1796) = 0 group by all""",
)
def c01(spark, d: str) -> DataFrame:
    flags = (F.col("name") % 4096).cast("int")
    rows = ca.intervals(spark, d).where(reads.keep_flags(flags))
    return rows.groupBy("contig", reads.mapq_bucket(F.col("mapq")).alias("bucket"), reads.mapq_threshold(F.col("mapq")).alias("threshold")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(reads.keep_flags(flags, secondary=True)).alias("kept_with_secondary")
    )


@query(
    "c04_transcript_strand",
    f"""with {IV} select contig, case when (f & 1) <> 0 and (f & 128) <> 0 then (f & 16) = 0 else (f & 16) <> 0 end as plus, count(*) as n from (select contig, cast(name % 256 as integer) as f from iv) group by all""",
)
def c04(spark, d: str) -> DataFrame:
    return ca.intervals(spark, d).groupBy("contig", reads.plus_strand((F.col("name") % 256).cast("int")).alias("plus")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "c14_long_read",
    f"""with {IV}, r as (select contig, sample, e - s as len, row_number() over (partition by contig, sample order by e - s) as k, count(*) over (partition by contig, sample) as n from iv)
    select contig, sample, len as upper_median, len > 1000 as is_long from r where k = n // 2 + 1""",
)
def c14(spark, d: str) -> DataFrame:
    m = iv.at_ranks(ca.intervals(spark, d).withColumn("v", F.col("e") - F.col("s")), ["contig", "sample"], "v", {"upper_median": stats.upper_median})
    return m.withColumn("is_long", F.col("upper_median") > 1000)


@query(
    "c15_strandness",
    f"""with {IV}, r as (select sample, strand, row_number() over (partition by sample order by s, name, line, site, e) as k from iv), x as (select sample, avg(case when strand = 'O' then 1.0 else 0.0 end) as f, count(*) as n from r where k <= 3000 group by sample)
    select sample, round(f, 6) as fraction, case when n < 100 then 'unknown' when f >= 0.9 then 'reverse' when f <= 0.1 then 'forward' else 'unstranded' end as call from x""",
)
def c15(spark, d: str) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("sample").orderBy("s", "name", "line", "site", "e"))
    r = ca.intervals(spark, d).select("sample", "strand", "s", "name", "line", "site", "e")
    # only starts that fewer than 3,000 reads come before can hold some of the first 3,000: the rest is not put in order
    upto = Window.partitionBy("sample").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    starts = r.groupBy("sample", "s").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).where("_before < 3000").select(F.col("sample").alias("_sample"), F.col("s").alias("_s"))
    r = r.join(starts, F.col("sample").eqNullSafe(F.col("_sample")) & (F.col("s") == F.col("_s")), "left_semi")
    x = r.withColumn("_k", first).where("_k <= 3000").groupBy("sample").agg(F.avg((F.col("strand") == "O").cast("double")).alias("f"), F.count(F.lit(1)).alias("n"))
    call = F.when(F.col("n") < 100, "unknown").when(F.col("f") >= 0.9, "reverse").when(F.col("f") <= 0.1, "forward").otherwise("unstranded")
    return x.select("sample", F.round("f", 6).alias("fraction"), call.alias("call"))


@query(
    "m03_medians",
    f"""with {IV}, x as (select contig, e - s as v, row_number() over (partition by contig order by e - s) as k, count(*) over (partition by contig) as n from iv)
    select contig, median(v) as averaging, max(case when k = n // 2 + 1 then v end) as upper, max(case when k = floor(0.9 * (n - 1) + 0.5) + 1 then v end) as p90 from x group by contig""",
)
def m03(spark, d: str) -> DataFrame:
    rows = ca.intervals(spark, d).withColumn("v", F.col("e") - F.col("s"))
    low, high = (lambda n: F.floor((n - 1) / 2)), stats.upper_median
    m = iv.at_ranks(rows, ["contig"], "v", {"low": low, "upper": high, "p90": stats.nearest_rank(0.9)})
    return m.select("contig", ((F.col("low") + F.col("upper")) / 2).alias("averaging"), "upper", "p90")


@query(
    "e18_cohort_z",
    f"""with {IV}, u as (select site, sample, count(*)::double / 4 as usage from iv group by all), m as (select site, median(usage) as med, count(*) as n from u group by site),
    a as (select u.site, 1.4826 * median(abs(usage - med)) as mad from u join m on m.site = u.site group by u.site)
    select u.site, u.sample, round(case when n >= 5 then (usage - med) / greatest(mad, 0.02) end, 6) as z from u join m on m.site = u.site join a on a.site = u.site""",
)
def e18(spark, d: str) -> DataFrame:
    u = ca.intervals(spark, d).groupBy("site", "sample").agg((F.count(F.lit(1)) / 4).alias("usage"))
    m = u.groupBy("site").agg(stats.averaging_median("usage").alias("med"), F.count(F.lit(1)).alias("n"))
    w = u.join(m, "site")
    a = w.groupBy("site").agg((stats.averaging_median(F.abs(F.col("usage") - F.col("med"))) * stats.MAD_SCALE).alias("mad"))
    return w.join(a, "site").select("site", "sample", F.round(stats.robust_z(F.col("usage"), F.col("med"), F.col("mad"), F.col("n")), 6).alias("z"))


@query(
    "f01_systematic_thinning",
    f"""with {IV}, x as (select contig, name, line, site, s, e, row_number() over (partition by contig order by s, e, name, line, site) - 1 as k, count(*) over (partition by contig) as n from iv),
    r as (select *, cast(2 ** greatest(0, ceil(log2(n / 2000.0))) as bigint) as rate from x) select contig, name, line, site, s, e, rate from r where k % rate = 0""",
)
def f01(spark, d: str) -> DataFrame:
    # how many there are comes with the ranks: a join by contig would deal all rows to as many tasks as there are contigs
    x = iv.ranked(ca.intervals(spark, d), ["contig"], "s", "e", "name", "line", "site", stretch=16).withColumnsRenamed({"rank": "_k", "of": "_n"})
    rate = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(F.col("_n") / 2000.0)).cast("double"))).cast("long")
    return x.withColumn("rate", rate).where(F.col("_k") % F.col("rate") == 0).select("contig", "name", "line", "site", "s", "e", "rate")


@query(
    "f03_even_subset",
    f"""with {IV}, x as (select contig, name, line, site, s, e, row_number() over (partition by contig order by s, e, name, line, site) - 1 as k, count(*) over (partition by contig) as m from iv)
    select contig, name, line, site, s, e from x where m <= 500 or exists (select 1 from range(500) r(i) where floor(i * (m / 500.0)) = k)""",
)
def f03(spark, d: str) -> DataFrame:
    x = iv.ranked(ca.intervals(spark, d), ["contig"], "s", "e", "name", "line", "site", stretch=16).withColumnsRenamed({"rank": "_k", "of": "_m"})
    step = F.col("_m") / 500.0
    # some i of 0 to 499 has floor(i * step) = k: the least i with i * step >= k
    i = F.ceil(F.col("_k") / step)
    near = [i - 1, i, i + 1]
    hit = F.lit(False)
    for c in near:
        hit = hit | ((c >= 0) & (c < 500) & (F.floor(c * step) == F.col("_k")))
    return x.where((F.col("_m") <= 500) | hit).select("contig", "name", "line", "site", "s", "e")


@query("f04_largest_first", f"with {CALLS} select call, e - s as size from calls order by e - s desc, call limit 200")
def f04(spark, d: str) -> DataFrame:
    return ca.calls(spark, d).select("call", (F.col("e") - F.col("s")).alias("size")).orderBy(F.desc("size"), "call").limit(200)


@query("d06_g03_semi_and_anti", f"with {IV} select contig, count(*) filter (where k) as kept, count(*) filter (where not k) as rest from (select contig, exists (select 1 from customer where c_custkey = site and c_acctbal > 0) as k from iv) group by contig")
def d06(spark, d: str) -> DataFrame:
    rows = ca.intervals(spark, d)
    good = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("site"))
    kept, rest = rows.join(good, "site", "left_semi"), rows.join(good, "site", "left_anti")
    both = kept.select("contig", F.lit(1).alias("k")).union(rest.select("contig", F.lit(0)))
    return both.groupBy("contig").agg(F.sum("k").alias("kept"), F.count_if(F.col("k") == 0).alias("rest"))


@query("g04_distinct_cuts", f"with {IV} select contig, pos from (select contig, s as pos from iv union select contig, e from iv)")
def g04(spark, d: str) -> DataFrame:
    rows = ca.intervals(spark, d)
    return rows.select("contig", F.col("s").alias("pos")).union(rows.select("contig", "e")).distinct()


@query("a12_duplicate_texts", "select cast(min(doc_id) as bigint) as doc_id, count(*) as copies from documents group by text")
def a12(spark, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return docs.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).drop("h")


@query("e51_duplicate_names", "select lower(trim(p_name)) as name, count(*) as n from part group by all having count(*) > 1")
def e51(spark, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.lower(F.trim("p_name")).alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("d17_left_match", "select o_orderkey, c_name, c_custkey is not null as found from orders left join customer on c_custkey = o_custkey and c_acctbal < 5000")
def d17(spark, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_acctbal < 5000").select("c_custkey", "c_name")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select("o_orderkey", "c_name", F.col("c_custkey").isNotNull().alias("found"))


@query(
    "e54_insert_median",
    f"with {IV}, x as (select contig, e - s as v, row_number() over (partition by contig order by e - s) as k, count(*) over (partition by contig) as n from iv) select contig, v as insert_median from x where k = n // 2 + 1",
)
def e54(spark, d: str) -> DataFrame:
    # by a histogram and a rank walk: the group is one row a length, never one a read
    h = ca.intervals(spark, d).groupBy("contig", (F.col("e") - F.col("s")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("contig")
    x = h.withColumn("_to", F.sum("n").over(w.orderBy("v"))).withColumn("_all", F.sum("n").over(w))
    return x.where(F.col("_to") > F.floor(F.col("_all") / 2)).groupBy("contig").agg(F.min("v").alias("insert_median"))


@query(
    "b06_reverse_complement",
    "select p_partkey, reverse(translate(x, 'ACGTN', 'TGCAN')) as rc from (select p_partkey, translate(md5(p_name), '0123456789abcdef', 'ACGTNCGTACGTACGT') as x from part)",
)
def b06(spark, d: str) -> DataFrame:
    dna = F.translate(F.md5("p_name"), "0123456789abcdef", "ACGTNCGTACGTACGT")
    return table(spark, d, "part").select("p_partkey", reads.reverse_complement(dna).alias("rc"))


@query(
    "b02_cigar_parse",
    """select p_partkey, cast(list_sum(list_transform(regexp_extract_all(c, '[0-9]+[MDN=X]'), lambda x: cast(x[:-2] as integer))) as integer) as reference_length, len(regexp_extract_all(c, '[0-9]+[MIDNSHP=X]')) as ops
    from (select p_partkey, p_size || 'M' || (p_partkey % 7 + 1) || 'D' || p_size * 2 || 'M' || (p_partkey % 3 + 1) || 'I5N10M' || (p_partkey % 11 + 1) || 'S' as c from part)""",
)
def b02(spark, d: str) -> DataFrame:
    k = F.col("p_partkey")
    c = F.concat(F.col("p_size"), F.lit("M"), k % 7 + 1, F.lit("D"), F.col("p_size") * 2, F.lit("M"), k % 3 + 1, F.lit("I5N10M"), k % 11 + 1, F.lit("S"))
    x = table(spark, d, "part").select("p_partkey", reads.cigar_ops(c).alias("_ops"))
    return x.select("p_partkey", reads.reference_length(F.col("_ops")).alias("reference_length"), F.size("_ops").cast("long").alias("ops"))


@query(
    "b04_sa_tag",
    """select p_partkey, split_part(x, ',', 1) as contig, cast(split_part(x, ',', 2) as integer) - 1 as pos, split_part(x, ',', 3) as strand, split_part(x, ',', 4) as cigar, cast(split_part(x, ',', 5) as integer) as mapq
    from (select p_partkey, unnest(list_filter(string_split('chr' || (p_partkey % 22 + 1) || ',' || (p_partkey * 3 + 1) || ',+,' || p_size || 'M,60,1;chrX,' || p_size || ',-,10S5M,' || (p_partkey % 60) || ',0;', ';'), lambda s: s <> '')) as x from part)""",
)
def b04(spark, d: str) -> DataFrame:
    k = F.col("p_partkey")
    sa = F.concat(F.lit("chr"), k % 22 + 1, F.lit(","), k * 3 + 1, F.lit(",+,"), F.col("p_size"), F.lit("M,60,1;chrX,"), F.col("p_size"), F.lit(",-,10S5M,"), k % 60, F.lit(",0;"))
    x = table(spark, d, "part").select("p_partkey", F.explode(reads.sa_parts(sa)).alias("p"))
    return x.select("p_partkey", "p.*")


@query(
    "x22_methyl_bins",
    "select p_partkey, case when c >= 1 then 15 else greatest(0, least(15, cast(floor(2 * (-log2(1.0 - c) - 1) + 1e-9) as integer))) end as bin from (select p_partkey, (p_partkey % 1024) / 1023.0::double as c from part)",
)
def x22(spark, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", reads.methyl_bin((F.col("p_partkey") % 1024) / F.lit(1023.0)).alias("bin"))


@query(
    "x12_percent_label",
    "select l_orderkey, l_linenumber, l_partkey, case when v >= 9.95 or v <= 0 then cast(cast(floor(v + 0.5) as bigint) as varchar) || ' %' else format('{:.1f} %', floor(v * 10 + 0.5) / 10) end as label from (select *, l_discount * (l_linenumber + 0.25) * 40 as v from lineitem)",
)
def x12(spark, d: str) -> DataFrame:
    p = F.col("l_discount") * (F.col("l_linenumber") + 0.25) * 40
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", reads.percent_label(p, percent=True).alias("label"))


@query(
    "x13_mosaic_fraction",
    "select o_orderkey, round(greatest(0.0, least(1.0, case when loss then (case when hemi then 1 - r else 2 - 2 * r end) else (case when hemi then r - 1 else 2 * r - 2 end) end)), 6) as f from (select o_orderkey, o_orderstatus = 'F' as loss, o_custkey % 5 = 0 as hemi, 2.0 ** ((o_totalprice % 4000) / 2000 - 1) as r from orders)",
)
def x13(spark, d: str) -> DataFrame:
    lr = (F.col("o_totalprice") % 4000) / 2000 - 1
    return table(spark, d, "orders").select("o_orderkey", F.round(reads.mosaic_fraction(lr, F.col("o_orderstatus") == "F", F.col("o_custkey") % 5 == 0), 6).alias("f"))


@query(
    "m01_fisher",
    f"""with {IV}, t as (select site, count(*) filter (where strand = 'O' and allele = 'R') as a, count(*) filter (where strand <> 'O' and allele = 'R') as b, count(*) filter (where strand = 'O' and allele <> 'R') as c, count(*) filter (where strand <> 'O' and allele <> 'R') as d from iv group by site),
    p as (select *, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) as k from t),
    x as (select site, a, b, c, d, unnest(range(greatest(0, a + c - (c + d)), least(a + b, a + c) + 1)) as i, k from p),
    q as (select site, a, b, c, d, i, exp(k - lgamma(i + 1) - lgamma(a + b - i + 1) - lgamma(a + c - i + 1) - lgamma(d - a + i + 1)) as pi, exp(k - lgamma(a + 1) - lgamma(b + 1) - lgamma(c + 1) - lgamma(d + 1)) as pa from x)
    select t.site, round(case when t.a + t.b = 0 or t.c + t.d = 0 or t.a + t.c = 0 or t.b + t.d = 0 then 1.0 else least(1.0, sum(case when pi <= pa * (1 + 1e-7) then pi else 0 end)) end, 6) as p_two,
      round(case when t.a + t.b = 0 or t.c + t.d = 0 or t.a + t.c = 0 or t.b + t.d = 0 then 1.0 else least(1.0, sum(case when i >= t.a then pi else 0 end)) end, 6) as p_greater from t left join q on q.site = t.site group by t.site, t.a, t.b, t.c, t.d""",
)
def m01(spark, d: str) -> DataFrame:
    o, r = F.col("strand") == "O", F.col("allele") == "R"
    t = ca.intervals(spark, d).groupBy("site").agg(
        F.count_if(o & r).cast("int").alias("a"), F.count_if(~o & r).cast("int").alias("b"), F.count_if(o & ~r).cast("int").alias("c"), F.count_if(~o & ~r).cast("int").alias("d")
    )
    return t.select("site", F.round(stats.fisher("a", "b", "c", "d"), 6).alias("p_two"), F.round(stats.fisher("a", "b", "c", "d", greater=True), 6).alias("p_greater"))


@query(
    "m02_binomial",
    f"""with {IV}, t as (select site, count(*) filter (where strand = 'O') as k, count(*) as n from iv group by site), x as (select site, k, n, unnest(range(0, least(k, n - k) + 1)) as i from t)
    select site, round(least(1.0, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))), 6) as p from x group by site, k, n""",
)
def m02(spark, d: str) -> DataFrame:
    t = ca.intervals(spark, d).groupBy("site").agg(F.count_if(F.col("strand") == "O").cast("int").alias("k"), F.count(F.lit(1)).cast("int").alias("n"))
    return t.select("site", F.round(stats.binomial_half("k", "n"), 6).alias("p"))
