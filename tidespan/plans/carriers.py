"""How the retail tables stand for interval data, in DataFrames and in SQL.

An order line spans the days between its order and its shipment: contig is the order's status, sample its priority.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidespan.session import table


def day(c: str):
    return F.unix_date(F.to_date(c))


def intervals(spark, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_shipdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    a, b = day("o_orderdate"), day("l_shipdate")
    return j.select(
        F.col("o_orderstatus").alias("contig"),
        F.col("o_orderpriority").alias("sample"),
        F.col("l_linestatus").alias("strand"),
        F.col("l_returnflag").alias("allele"),
        F.col("l_partkey").alias("site"),
        F.col("l_suppkey").alias("ps"),
        F.col("l_quantity").cast("int").alias("mapq"),
        F.col("l_orderkey").alias("name"),
        F.col("l_linenumber").alias("line"),
        F.least(a, b).alias("s"),
        F.greatest(a, b).alias("e"),
    ).where("s < e")


#: The same rows in DuckDB.
IV = """iv as (
  select * from (
    select o_orderstatus as contig, o_orderpriority as sample, l_linestatus as strand, l_returnflag as allele, l_partkey as site,
      l_suppkey as ps, cast(l_quantity as integer) as mapq, l_orderkey as name, l_linenumber as line,
      cast(least(date_diff('day', date '1970-01-01', cast(o_orderdate as date)), date_diff('day', date '1970-01-01', cast(l_shipdate as date))) as integer) as s,
      cast(greatest(date_diff('day', date '1970-01-01', cast(o_orderdate as date)), date_diff('day', date '1970-01-01', cast(l_shipdate as date))) as integer) as e
    from orders join lineitem on l_orderkey = o_orderkey) where s < e)"""


def genes(spark, d: str) -> DataFrame:
    """Parts as genes: a span of days on a contig, from the part's key and size."""
    p = table(spark, d, "part")
    start = (F.lit(9000) + (F.col("p_partkey") * 37) % 3000).cast("int")
    contig = F.get(F.array(F.lit("F"), F.lit("O"), F.lit("P")), (F.col("p_partkey") % 3).cast("int"))
    return p.select(F.col("p_partkey").alias("gene"), contig.alias("contig"), start.alias("gs"), (start + F.col("p_size")).alias("ge"))


GENES = """genes as (
  select p_partkey as gene, case p_partkey % 3 when 0 then 'F' when 1 then 'O' else 'P' end as contig,
    cast(9000 + (p_partkey * 37) % 3000 as integer) as gs, cast(9000 + (p_partkey * 37) % 3000 + p_size as integer) as ge from part)"""


def junctions(spark, d: str) -> DataFrame:
    """Counted junctions: distinct spans of each sample, on a coarse grid so that ends are shared."""
    iv = intervals(spark, d)
    s, e = (F.floor(F.col("s") / 40) * 40).cast("int"), (F.floor(F.col("e") / 40) * 40 + 40).cast("int")
    return iv.select("contig", "sample", "strand", s.alias("s"), e.alias("e")).groupBy("contig", "sample", "s", "e").agg(F.count(F.lit(1)).alias("n"))


JUNCTIONS = (
    IV
    + """, junctions as (
  select contig, sample, cast(s // 40 * 40 as integer) as s, cast(e // 40 * 40 + 40 as integer) as e, count(*) as n from iv group by all)"""
)


def exons(spark, d: str) -> DataFrame:
    """A model of 20 exons for each contig, whose ends lie on the junctions' grid."""
    contigs = table(spark, d, "orders").select(F.col("o_orderstatus").alias("contig")).distinct()
    return contigs.select("contig", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("_i")).select("contig", (F.col("_i") + 1).alias("rank"), (F.lit(9000) + F.col("_i") * 160).alias("xs"), (F.lit(9080) + F.col("_i") * 160).alias("xe"))


EXONS = """exons as (
  select contig, cast(i + 1 as integer) as rank, cast(9000 + i * 160 as integer) as xs, cast(9080 + i * 160 as integer) as xe
  from (select distinct o_orderstatus as contig from orders) c, range(20) r(i))"""


def calls(spark, d: str) -> DataFrame:
    """Orders as copy-number calls of customers."""
    o = table(spark, d, "orders")
    start = (day("o_orderdate") * 10).cast("int")
    size = F.floor(F.col("o_totalprice") / 1000).cast("int")
    return o.select(
        F.col("o_orderkey").alias("call"),
        F.col("o_custkey").alias("patient"),
        F.col("o_orderpriority").alias("chrom"),
        F.when(F.col("o_orderstatus") == "F", "loss").when(F.col("o_orderstatus") == "O", "gain").otherwise("loh").alias("kind"),
        start.alias("s"),
        (start + size).alias("e"),
    )


CALLS = """calls as (
  select o_orderkey as call, o_custkey as patient, o_orderpriority as chrom,
    case o_orderstatus when 'F' then 'loss' when 'O' then 'gain' else 'loh' end as kind,
    cast(date_diff('day', date '1970-01-01', cast(o_orderdate as date)) * 10 as integer) as s,
    cast(date_diff('day', date '1970-01-01', cast(o_orderdate as date)) * 10 + floor(o_totalprice / 1000) as integer) as e from orders)"""


CHROMS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

#: The chromosome of a part as an annotation entry, in SQL and as a column.
PART_CHROM = f"{CHROMS}[p_partkey % 5 + 1] as chrom"


def part_chrom(part: str = "p_partkey"):
    return F.get(F.array(*[F.lit(c) for c in CHROMS]), (F.col(part) % 5).cast("int")).alias("chrom")
