"""Sources that are files, written from the star-schema tables first; and groups of fragments."""

from __future__ import annotations

import io
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidespan.operators import consensus, flanks
from tidespan.plans import basics
from tidespan.plans import carriers as ca
from tidespan.session import shared_dir, table
from tidespan.sources import archives, columnar, fasta, registry

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


DNA = "translate(md5(p_name) || md5(p_brand), '0123456789abcdef', 'ACGTACGTACGTACGT')"


@query("a05_reference_windows", f"select 'c' || p_partkey as contig, cast(p_size % 20 - 3 as integer) as s, cast(p_size % 20 + 25 as integer) as e, q[greatest(p_size % 20 - 3, 0) + 1:least(p_size % 20 + 25, 64)] as bases from (select *, {DNA} as q from part)")
def a05(spark, d: str) -> DataFrame:
    p = table(spark, d, "part")
    seq = F.lower(F.expr(DNA))
    text = F.concat(F.lit(">c"), F.col("p_partkey"), F.lit(" a part\n"), F.regexp_replace(seq, "(.{50})", "$1\n"))
    path = f"{shared_dir(spark)}/fasta-{uuid.uuid4().hex[:12]}"
    p.select(text.alias("value")).write.text(path)
    asked = p.select(F.concat(F.lit("c"), F.col("p_partkey")).alias("contig"), (F.col("p_size") % 20 - 3).alias("s"), (F.col("p_size") % 20 + 25).alias("e"))
    return fasta.windows(fasta.tiles(fasta.sequences(spark, path), 16), asked, 16)


def zipped(rows: DataFrame) -> DataFrame:
    """(path, content): a zip for each path of rows (path, entry, text), its entries named entry."""

    def run(t: pa.Table) -> pa.Table:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for r in sorted(t.to_pylist(), key=lambda r: r["entry"]):
                z.writestr(r["entry"], r["text"])
        return pa.table({"path": t.column("path")[:1].cast(pa.string()), "content": pa.array([out.getvalue()], pa.binary())})

    return rows.groupBy("path").applyInArrow(run, "path string, content binary")


@query("a11_zip_entries", "select 'z' || (p_partkey % 40) as path, p_partkey || '.bed' as entry, i as line_no, case i when 0 then 'chr1' || chr(9) || p_size when 1 then p_name else '' end as line from part, range(3) r(i)")
def a11(spark, d: str) -> DataFrame:
    p = table(spark, d, "part")
    text = F.concat(F.lit("chr1\t"), F.col("p_size"), F.lit("\r\n"), F.col("p_name"), F.lit("\n"))
    z = zipped(p.select(F.concat(F.lit("z"), F.col("p_partkey") % 40).alias("path"), F.concat(F.col("p_partkey"), F.lit(".bed")).alias("entry"), text.alias("text")))
    return archives.lines(archives.entries(z)).withColumn("line_no", F.col("line_no").cast("long"))


BOOK = '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="a" r:id="r2"/><sheet name="b" r:id="r1"/></sheets></workbook>'
LINKS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>'


@query("a10_workbooks", "select 'w' || (p_partkey % 40) as path, row_number() over (partition by p_partkey % 40 order by p_partkey) as row_no, 'key ' || (p_partkey % 7) as a, '' as b, p_size::varchar as c from part")
def a10(spark, d: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, d, "part").withColumn("path", F.concat(F.lit("w"), k % 40))
    row = F.concat(F.lit('<c r="A1" t="s"><v>'), k % 7, F.lit('</v></c><c r="C1"><v>'), F.col("p_size"), F.lit("</v></c></row>"))
    rows = p.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(k.alias("k"), row.alias("x")))), lambda r, i: F.concat(F.lit('<row r="'), i + 1, F.lit('">'), r["x"])), "").alias("x"))
    space = '<%s xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
    sheet = F.concat(F.lit(space % "worksheet" + "<sheetData>"), F.col("x"), F.lit("</sheetData></worksheet>"))
    shared = space % "sst" + "".join(f"<si><r><t>key </t></r><r><t>{i}</t></r></si>" for i in range(7)) + "</sst>"
    parts = [("xl/workbook.xml", F.lit(BOOK)), ("xl/_rels/workbook.xml.rels", F.lit(LINKS)), ("xl/sharedStrings.xml", F.lit(shared)), ("xl/worksheets/sheet1.xml", F.lit("<worksheet/>")), ("xl/worksheets/sheet2.xml", sheet)]
    books = zipped(rows.select("path", F.inline(F.array(*[F.struct(F.lit(n).alias("entry"), c.alias("text")) for n, c in parts]))))
    x = archives.sheet_rows(archives.entries(books))
    return x.select("path", F.col("row_no").cast("long").alias("row_no"), *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate("abc")])


@query(
    "a28_indexed_files",
    """select '/run/S' || p_partkey || case when p_partkey % 2 = 0 then '.BAM' else '.cram' end as data, case p_partkey % 4 when 0 then '/run/s' || p_partkey || '.bam.bai' when 1 then '/run/S' || p_partkey || '.cram.crai' when 2 then '/run/S' || p_partkey || '.bai' end as index from part""",
)
def a28(spark, d: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    data = p.select(F.concat(F.lit("/run/S"), k, F.when(k % 2 == 0, ".BAM").otherwise(".cram")).alias("path"))
    index = p.where("p_partkey % 4 < 3").select(F.concat(F.when(k % 4 == 0, "/run/s").otherwise("/run/S"), k, F.when(k % 4 == 0, ".bam.bai").when(k % 4 == 1, ".cram.crai").otherwise(".bai")))
    other = p.select(F.concat(F.lit("/run/notes"), k, F.lit(".txt")))
    return archives.with_index(data.union(index).union(other))


ENDINGS = [".parquet", ".BED", ".vcf.gz", ".tsv", ".pdf", ".vcf", ".txt.bed"]


@query("q01_file_kinds", "select p_partkey, ['parquet', 'bed', 'vcf', 'interval', null, 'vcf', 'bed'][p_partkey % 7 + 1] as kind from part")
def q01(spark, d: str) -> DataFrame:
    """Names of parts as file names. Kinds are a registry of the driver; the endings it knows become one expression."""
    ending = F.get(F.array(*[F.lit(n) for n in ENDINGS]), (F.col("p_partkey") % len(ENDINGS)).cast("int"))
    name = F.concat(F.regexp_replace("p_name", "[^A-Za-z]", "_"), F.lit("."), F.col("p_size").cast("string"), ending)
    return table(spark, d, "part").select("p_partkey", registry.kind_column(name).alias("kind"))


@query("e35_exact_groups")
def e35(spark, d: str) -> DataFrame:
    iv = ca.intervals(spark, d).select((F.col("site") % 300).cast("string").alias("locus"), F.xxhash64("name", "line", "site", "ps", "s", "e").alias("id"), "s", "e", "site", "allele", "strand").dropDuplicates(["locus", "id"])
    block = lambda a, b: F.struct(a.alias("s"), b.alias("e"))
    split = (F.col("strand") == "O") & (F.col("e") - F.col("s") > 40)
    a, b = (F.floor(F.col("s") / 40) * 40 + 30).cast("int"), (F.floor(F.col("s") / 40) * 40 + 38).cast("int")
    cut = split & (F.col("s") < a) & (b < F.col("e"))
    blocks = F.when(cut, F.array(block(F.col("s"), a), block(b, F.col("e")))).otherwise(F.array(block(F.col("s"), F.col("e"))))
    junctions = F.when(cut, F.array(block(a, b))).otherwise(F.array().cast("array<struct<s:int,e:int>>"))
    alleles = F.create_map((F.floor(F.col("s") / 60) * 60).cast("int"), F.col("allele"))
    x = iv.select("locus", "id", blocks.alias("blocks"), junctions.alias("junctions"), alleles.alias("alleles"))
    return consensus.exact_groups(x, "locus")


@query("a13_range_of_reads", f"with {ca.IV} select contig, s, e, name, line from iv where contig = 'O' and s < 9600 and e > 9540")
def a13(spark, d: str) -> DataFrame:
    path = f"{shared_dir(spark)}/reads-{uuid.uuid4().hex[:12]}"
    columnar.write_reads(ca.intervals(spark, d).select("contig", "s", "e", "name", "line"), path)
    return columnar.read_range(spark, path, "O", 9540, 9600)


@query("a14_coverage_blocks", basics.ORACLES["w01_depth_runs"])
def a14(spark, d: str) -> DataFrame:
    runs = basics.QUERIES["w01_depth_runs"](spark, d)
    return columnar.decoded_runs(columnar.encoded_runs(runs, ["contig"]), ["contig"])


@query("x26_aligned_flanks")
def x26(spark, d: str) -> DataFrame:
    dna = lambda c: F.translate(F.md5(c), "0123456789abcdef", "ACGTACGTACGTACGT")
    k, q = F.col("p_partkey"), dna(F.col("p_name"))
    read = F.concat(F.substring(q, 1, 10), F.when(k % 3 == 0, "TT").otherwise(""), F.substring(q, 12, 15))
    return flanks.aligned_flanks(table(spark, d, "part").select(k.alias("id"), read.alias("read"), q.alias("flank"), (k % 2 == 0).alias("at_end")))
