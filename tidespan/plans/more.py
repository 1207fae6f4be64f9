"""Readers, transcripts, reads, rearrangements, streams and consensus on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidespan.functions import genetics, reads
from tidespan.operators import structural
from tidespan.plans import carriers as ca
from tidespan.plans.carriers import CALLS, EXONS, IV
from tidespan.sources import tables
from tidespan.session import dealt, table
from tidespan.streaming import coverage

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def part_lines(spark, d: str, line) -> DataFrame:
    return table(spark, d, "part").select(F.lit("part").alias("file"), F.col("p_partkey").cast("int").alias("line_no"), line.alias("line"))


@query(
    "a08_bed_calls",
    """select line_no, chrom, s, e, kind from (select cast(p_partkey as integer) as line_no, 'chr' || (p_partkey % 22 + 1) as chrom, p_partkey * 10 + 1 as s, p_partkey * 10 + p_size as e,
      case p_partkey % 5 when 0 then 'loss' when 1 then 'gain' when 2 then 'loss' when 3 then 'gain' end as kind from part) where kind is not null""",
)
def a08(spark, d: str) -> DataFrame:
    k = F.col("p_partkey")
    names = F.array(*[F.lit(x) for x in ("deletion", "dup 3", "x1", "x3~4", "LOH")])
    line = F.concat_ws("\t", F.concat(F.lit("chr"), k % 22 + 1), k * 10, k * 10 + F.col("p_size"), F.get(names, (k % 5).cast("int")))
    return tables.read(tables.bed_calls(part_lines(spark, d, line))).select("line_no", "chrom", "s", "e", "kind")


@query(
    "a09_vcf_calls",
    """select line_no, chrom, s, e, kind, copies from (select cast(p_partkey as integer) as line_no, 'chr' || (p_partkey % 22 + 1) as chrom, p_partkey * 10 + 1 as s, p_partkey * 10 + p_size as e, p_partkey % 6 as k,
      case p_partkey % 6 when 0 then 'loss' when 1 then 'gain' when 2 then 'gain' end as kind, case p_partkey % 6 when 2 then 4 end as copies from part) where kind is not null""",
)
def a09(spark, d: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), (k % 6).cast("int"))
    info = F.concat(F.lit("END="), k * 10 + F.col("p_size"), F.lit(";SVTYPE="), pick(["DEL", "DUP", "CNV", "CNV", "INV", "DEL"]))
    line = F.concat_ws("\t", F.concat(F.lit("chr"), k % 22 + 1), k * 10, F.lit("."), F.lit("N"), F.lit("<X>"), F.lit("."), F.lit("PASS"), info, pick(["GT", "GT", "GT:CN", "GT:CN", "GT", "GT"]), pick(["0/1", "1/1", "0/1:4", "0/1:2", "0/1", "0/0"]))
    return tables.read(tables.vcf_calls(part_lines(spark, d, line))).select("line_no", "chrom", "s", "e", "kind", "copies")


@query(
    "a07_interval_table",
    """select line_no, chrom, s, e, kind from (select cast(p_partkey + 1 as integer) as line_no, 'chr' || (p_partkey % 22 + 1) as chrom, p_partkey * 10 as s, p_partkey * 10 + p_size as e,
      case p_partkey % 4 when 0 then 'loss' when 1 then 'gain' when 2 then 'loss' when 3 then 'gain' end as kind from part)""",
)
def a07(spark, d: str) -> DataFrame:
    k = F.col("p_partkey")
    kind, cn, lr = (F.get(F.array(*[F.lit(x) for x in xs]), (k % 4).cast("int")) for xs in (["Loss", "Gain", "", ""], ["", "", "1", ""], ["", "", "", "0,45"]))
    # starts and stops swapped in every other row
    a, b = k * 10, k * 10 + F.col("p_size")
    line = F.concat_ws("\t", F.concat(F.lit("chr"), k % 22 + 1), F.when(k % 2 == 0, a).otherwise(b), F.when(k % 2 == 0, b).otherwise(a), kind, cn, lr)
    head = spark.createDataFrame([("part", 0, "Chromosome\tStart\tStop\tType\tCopy number\tLog ratio")], "file string, line_no int, line string")
    rows = part_lines(spark, d, line).withColumn("line_no", F.col("line_no") + 1)
    return tables.read(tables.interval_calls(head.union(rows))).select("line_no", "chrom", "s", "e", "kind")


@query("a17_classified_export", "select cast(p_partkey as integer) as line_no, case when p_size > 25 then 'l' || p_partkey || chr(9) || 'class ' || p_size || chr(9) || p_brand else 'l' || p_partkey end as line from part")
def a17(spark, d: str) -> DataFrame:
    p = table(spark, d, "part")
    lines = part_lines(spark, d, F.concat(F.lit("l"), F.col("p_partkey")))
    classes = p.where("p_size > 25").select(F.lit("part").alias("file"), F.col("p_partkey").cast("int").alias("line_no"), F.concat(F.lit("class "), F.col("p_size")).alias("class"), F.col("p_brand").alias("note"))
    return tables.classified_lines(lines, classes).select("line_no", "line")


@query("a16_session_samples", "select cast(i as integer) as version, p_brand as build, p_name || '.bam' as file from part, (select 1 as i)")
def a16(spark, d: str) -> DataFrame:
    j = F.to_json(F.struct(F.lit(1).alias("version"), F.col("p_brand").alias("build"), F.array(F.struct(F.col("p_name").alias("name"), F.concat("p_name", F.lit(".bam")).alias("file"))).alias("samples")))
    return tables.sessions(table(spark, d, "part").select(j.alias("text"))).select("version", "build", "file")


@query(
    "b07_read_junctions",
    "select p_partkey, cast(p_partkey + p_size + 5 as integer) as s, cast(p_partkey + p_size + 5 + 100 + p_partkey % 9 as integer) as e from part",
)
def b07(spark, d: str) -> DataFrame:
    k = F.col("p_partkey")
    cigar = F.concat(F.lit("4S"), F.col("p_size"), F.lit("M5D"), F.lit(100) + k % 9, F.lit("N2I30M"))
    x = table(spark, d, "part").select("p_partkey", reads.cigar_ops(cigar).alias("o"))
    x = x.withColumn("b", reads.blocks_of(F.col("p_partkey"), F.col("o"))).withColumn("j", reads.junctions_of(F.col("b")))
    return x.select("p_partkey", F.inline("j"))


@query(
    "b01_read_blocks",
    "select p_partkey, cast(p_partkey as integer) as s, cast(p_partkey + p_size as integer) as e, 4 as qs, cast(4 + p_size as integer) as qe from part union all select p_partkey, cast(p_partkey + p_size + 7 as integer), cast(p_partkey + p_size + 37 as integer), cast(4 + p_size + 2 as integer), cast(4 + p_size + 32 as integer) from part",
)
def b01(spark, d: str) -> DataFrame:
    cigar = F.concat(F.lit("4S"), F.col("p_size"), F.lit("M7D2I30M3H"))
    x = table(spark, d, "part").select("p_partkey", reads.cigar_ops(cigar).alias("o"))
    x = x.withColumn("b", reads.blocks_of(F.col("p_partkey"), F.col("o")))
    return x.select("p_partkey", F.inline(F.filter("b", lambda b: b["op"] == "M"))).drop("op")


@query("x22b_methyl_calls", "select p_partkey, m > 0.5 as modified, round(greatest(m, 1 - m), 6) as conf from (select p_partkey, pm / (pm + greatest(0.0, 1 - pm - ph)) as m from (select p_partkey, (p_partkey % 100 + 1) / 120.0::double as pm, (p_partkey % 7) / 50.0::double as ph from part))")
def x22b(spark, d: str) -> DataFrame:
    k = F.col("p_partkey")
    c = reads.methyl_call((k % 100 + 1) / F.lit(120.0), (k % 7) / F.lit(50.0))
    return table(spark, d, "part").select("p_partkey", c.alias("c")).select("p_partkey", "c.modified", F.round("c.conf", 6).alias("conf"))


@query(
    "x10_translation",
    """with t as (select p_partkey, translate(md5(p_name || p_partkey), '0123456789abcdef', 'TCAGTCAGTCAGTCAG') as q from part), c as (select p_partkey, i, q[i * 3 + 1:i * 3 + 3] as x from t, range(10) r(i))
    select p_partkey, string_agg('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG'[16 * (strpos('TCAG', x[1]) - 1) + 4 * (strpos('TCAG', x[2]) - 1) + strpos('TCAG', x[3])], '' order by i) as protein from c group by p_partkey""",
)
def x10(spark, d: str) -> DataFrame:
    dna = F.translate(F.md5(F.concat("p_name", F.col("p_partkey").cast("string"))), "0123456789abcdef", "TCAGTCAGTCAGTCAG")
    return dealt(table(spark, d, "part").select("p_partkey", dna.alias("cds")), "p_partkey").select("p_partkey", genetics.protein(F.col("cds")).alias("protein"))


@query("x05_loci", "select p_partkey, 'chr' || (p_partkey % 22 + 1) as chrom, p_partkey * 1000 - 1 + 1 as s, p_partkey * 1000 + case when p_partkey % 2 = 0 then p_size else 1 end as e from part")
def x05(spark, d: str) -> DataFrame:
    k = F.col("p_partkey")
    a = F.format_number(k * 1000 + 1, 0)
    text = F.concat(F.when(k % 3 == 0, "chr").otherwise(""), k % 22 + 1, F.lit(":"), a, F.when(k % 2 == 0, F.concat(F.lit("-"), (k * 1000 + F.col("p_size")).cast("string"))).otherwise(F.lit("")))
    return table(spark, d, "part").select("p_partkey", genetics.locus(text).alias("l")).select("p_partkey", "l.*")


@query(
    "x07_transcript_positions",
    f"""with {EXONS}, l as (select *, sum(xe - xs) over (partition by contig order by xs desc) as t2 from exons), p as (select p_partkey, 'F' as contig, 9000 + (p_partkey * 7) % 3200 as pos from part)
    select p_partkey, rank, cast(t2 - (xe - xs) + 1 + (xe - 1 - pos) as bigint) as t from p join l on l.contig = p.contig and pos >= xs and pos < xe""",
)
def x07(spark, d: str) -> DataFrame:
    layout = genetics.transcript_layout(ca.exons(spark, d), "contig", plus=False)
    points = table(spark, d, "part").select("p_partkey", F.lit("F").alias("contig"), (F.lit(9000) + F.col("p_partkey") * 7 % 3200).alias("pos"))
    return genetics.to_transcript(points, layout, "contig", plus=False).select("p_partkey", "rank", "t")


@query(
    "x14_exon_effects",
    f"""with {EXONS}, c as (select p_partkey as call, 'F' as contig, 8950 + p_partkey * 11 % 3200 as s, 8950 + p_partkey * 11 % 3200 + 60 + p_size * 20 as e from part),
    f as (select call, c.contig, s, e, count(*) as n, count(*) filter (where xs < e and xe > s) as t, count(*) filter (where xs >= s and xe <= e) as i, sum(case when xs < e and xe > s then greatest(0, least(xe, e, 11900) - greatest(xs, s, 9190)) else 0 end) as coding from c join exons x on x.contig = c.contig group by all)
    select call, contig, t as exons, cast(coding as bigint) as coding, case when t = 0 then 'intact' when i = n then 'whole' when t > i then 'undetermined' when coding = 0 then 'utr' when s <= 9190 and e > 9190 then 'start' when s <= 11899 and e > 11899 then 'stop' when coding % 3 = 0 then 'in frame' else 'out of frame' end as effect from f""",
)
def x14(spark, d: str) -> DataFrame:
    s = F.lit(8950) + F.col("p_partkey") * 11 % 3200
    c = table(spark, d, "part").select(F.col("p_partkey").alias("call"), F.lit("F").alias("contig"), s.alias("s"), (s + 60 + F.col("p_size") * 20).alias("e"))
    return genetics.exon_effect(c, ca.exons(spark, d), "contig", 9190, 11900)


@query(
    "x15_nmd",
    "select p_partkey, case when p_partkey % 11 = 0 then 'start lost' when p_partkey % 7 = 0 then 'no stop' when stop = 700 then 'canonical' when stop > 600 then 'last exon' when 600 - stop <= 55 then 'near last junction' when stop - 20 < 150 then 'near start' else 'degraded' end as fate from (select p_partkey, (p_partkey * 13) % 900 as stop from part)",
)
def x15(spark, d: str) -> DataFrame:
    k = F.col("p_partkey")
    fate = genetics.nmd(k % 11 == 0, F.when(k % 7 != 0, k * 13 % 900), F.lit(700), F.lit(600), F.lit(20))
    return table(spark, d, "part").select("p_partkey", fate.alias("fate"))


ALIGNERS = {"STAR": "rna", "bwa": "dna", "hisat2": "rna", "bowtie2": "dna", "unknown-tool": "", "dorado": "last"}
MODELS = {"rna004_130bps_hac": "rna", "dna_r10.4.1_e8.2": "dna", "": ""}


@query(
    "c12_library_types",
    f"""with x as (select {list(ALIGNERS.values())}[p_partkey % 6 + 1] as aligner, {list(MODELS.values())}[p_size % 3 + 1] as model, p_size % 7 = 0 as indexed, p_partkey from part)
    select p_partkey, case when aligner in ('rna', 'dna') and not indexed then aligner when model <> '' then model when aligner = 'last' and not indexed then 'dna' else 'unknown' end as type from x""",
)
def c12(spark, d: str) -> DataFrame:
    """Headers of parts: an aligner by key, in a line that only builds an index for every seventh size, and a basecalling model by size."""
    k, n = F.col("p_partkey"), F.col("p_size")
    get = lambda xs, i: F.get(F.array(*[F.lit(x) for x in xs]), i.cast("int"))
    pg = F.concat(F.lit("@PG\tID:STAR-"), k.cast("string"), F.lit("\tPN:"), get(list(ALIGNERS), k % 6), F.when(n % 7 == 0, "\tCL:x --build-hash-table true").otherwise("\tCL:run"), F.lit("\tVN:bwa"))
    rg = F.concat(F.lit("@RG\tID:"), n.cast("string"), F.when(n % 3 < 2, F.concat(F.lit("\tDS:basecall_model="), get(list(MODELS), n % 3), F.lit(" runid=1"))).otherwise(""))
    return table(spark, d, "part").select("p_partkey", reads.library_type(F.concat_ws("\n", F.lit("@HD\tVN:1"), F.when(k % 2 == 0, pg).otherwise(rg), F.when(k % 2 == 0, rg).otherwise(pg))).alias("type"))


@query(
    "d19_split_chains",
    f"""with {IV}, p as (select name, contig, strand, s, e, line * 100 as qs, line * 100 + 40 as qe, row_number() over (partition by name order by line, site, s, e) as k from iv),
    u as (select * from p qualify count(*) over (partition by name, qs) = 1), n as (select *, lead(contig) over w as contig2, lead(strand) over w as strand2, lead(s) over w as s2, lead(qs) over w as qs2 from u window w as (partition by name order by qs)),
    r as (select *, case when contig <> contig2 then 'elsewhere' when strand <> strand2 then 'inversion' when s2 - e >= 50 then 'deletion' when s2 - e <= -50 then 'duplication' when qs2 - qe >= 50 then 'insertion' end as kind from n where contig2 is not null)
    select name, contig, cast(floor((e + 2.5) / 5) * 5 as integer) as from_pos, contig2, cast(floor((s2 + 2.5) / 5) * 5 as integer) as to_pos, kind from r where kind is not null""",
)
def d19(spark, d: str) -> DataFrame:
    p = ca.intervals(spark, d).select("name", "contig", "strand", "s", "e", (F.col("line") * 100).alias("qs"), (F.col("line") * 100 + 40).alias("qe"))
    u = p.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("name", "qs"))).where("_n = 1").drop("_n")
    return structural.chained(u, ["name"])


@query("r01_windowed_events", "select cast(time_bucket(interval 1 hour, ts) as timestamp) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def r01(spark, d: str) -> DataFrame:
    return coverage.windowed_counts(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query(
    "m05_clip_consensus",
    """with b as (select p_size as pile, i, translate(md5(p_name || p_size), '0123456789abcdef', 'ACGTACGTACGTACGT')[i] as c from part, range(1, 21) r(i)), g as (select pile, i, c, count(*) as k from b group by pile, i, c), n as (select *, sum(k) over (partition by pile, i) as t from g),
    m as (select *, row_number() over (partition by pile, i order by k desc, c) as r from n) select pile, cast(i - 1 as integer) as i, case when k >= 0.6 * t then c else 'N' end as base, cast(t as bigint) as depth from m where r = 1""",
)
def m05(spark, d: str) -> DataFrame:
    seq = F.substring(F.translate(F.md5(F.concat("p_name", F.col("p_size").cast("string"))), "0123456789abcdef", "ACGTACGTACGTACGT"), 1, 20)
    b = table(spark, d, "part").select(F.col("p_size").alias("pile"), F.posexplode(F.split(seq, "")).alias("i", "c"))
    n = b.groupBy("pile", "i", "c").agg(F.count(F.lit(1)).alias("k"))
    best = n.groupBy("pile", "i").agg(F.sum("k").alias("depth"), F.min(F.struct((-F.col("k")).alias("k"), "c")).alias("m"))
    return best.select("pile", "i", F.when(-F.col("m.k") >= 0.6 * F.col("depth"), F.col("m.c")).otherwise("N").alias("base"), "depth")


@query("h01_rebuilt_paths")
def h01(spark, d: str) -> DataFrame:
    p = table(spark, d, "part")
    a, n = F.lit(1000) + F.col("p_size") * 30, F.col("p_partkey")
    one = p.select(F.concat_ws("-", "p_brand", F.floor(n / 200).cast("string")).alias("event"), n.cast("string").alias("id"), F.lit("1").alias("a_contig"), a.cast("int").alias("a_pos"), F.lit("tail").alias("a_side"), F.lit("1").alias("b_contig"), (a + 500).cast("int").alias("b_pos"), F.when(n % 3 == 0, "tail").otherwise("head").alias("b_side"), (n % 50).cast("int").alias("reads"))
    windows = one.select("event").distinct().select("event", F.lit("1").alias("contig"), F.lit(0).alias("ws"), F.lit(10_000).alias("we"))
    return structural.layouts(structural.rebuilt(one, windows))


@query("a18_benign_list", "select 'chr' || (p_partkey % 22 + 1) as chrom, p_partkey * 10 + 1 as ls, p_partkey * 10 + p_size as le, case p_partkey % 3 when 0 then 'loss' when 1 then 'gain' else 'both' end as type from part")
def a18(spark, d: str) -> DataFrame:
    k = F.col("p_partkey")
    line = F.concat_ws(" ", (k % 22 + 1).cast("string"), k * 10, k * 10 + F.col("p_size"), F.get(F.array(F.lit("perte"), F.lit("gain"), F.lit("benign")), (k % 3).cast("int")))
    return tables.benign_list(part_lines(spark, d, line)).select("chrom", "ls", "le", "type")
