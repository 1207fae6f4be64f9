"""Splice events, fusion frames, domains and repeat tracts on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidespan.operators import consequence, placement
from tidespan.operators import junctions as jn
from tidespan.plans import carriers as ca
from tidespan.plans.carriers import EXONS, JUNCTIONS
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
    "h08_splice_events",
    f"""with {JUNCTIONS}, {EXONS}, p as (select contig, s, e, cast(sum(n) as bigint) as n from junctions group by all), j as (select p.*, l.rank as li, r.rank as ri from p left join exons l on l.contig = p.contig and l.xe = p.s left join exons r on r.contig = p.contig and r.xs = p.e),
    k as (select j.*, d.xs as ds, d.xe as de, u.xs as us, u.xe as ue from j left join exons d on d.contig = j.contig and d.rank = j.li + 1 left join exons u on u.contig = j.contig and u.rank = j.ri - 1)
    select contig, s, e, kind, cast(case when kind = 'skip' then ri - li - 1 when kind = 'exonic_site' and li is not null then e - ds when kind = 'intronic_site' and li is not null then ds - e when kind = 'exonic_site' then ue - s when kind = 'intronic_site' then s - ue end as integer) as bases
    from (select *, case when li is not null and ri is not null then case when ri = li + 1 then 'canonical' when ri > li + 1 then 'skip' else 'unsupported' end when li is not null and e > ds and e < de then 'exonic_site' when li is not null and e < ds then 'intronic_site'
      when ri is not null and s > us and s < ue then 'exonic_site' when ri is not null and s > ue then 'intronic_site' else 'unsupported' end as kind from k)""",
)
def h08(spark, d: str) -> DataFrame:
    j = jn.pooled(ca.junctions(spark, d), ["contig"])
    return consequence.splice_events(j, ca.exons(spark, d), "contig").select("contig", "s", "e", "kind", "bases")


@query(
    "h09_fusion_frames",
    """select p_partkey, case when p_partkey % 13 = 0 then 'noncoding' when ta < 100 then 'five-utr' when ta >= 900 then 'after-stop' when tb > 700 then 'three-utr' when (((ta - 99 - (tb - 50)) % 3) + 3) % 3 = 0 then 'in-frame' else 'frameshift' end as frame
    from (select p_partkey, p_partkey * 7 % 1000 as ta, p_partkey * 11 % 800 as tb from part)""",
)
def h09(spark, d: str) -> DataFrame:
    k = F.col("p_partkey")
    frame = consequence.fusion_frame(F.when(k % 13 != 0, k * 7 % 1000), F.lit(100), F.lit(900), k * 11 % 800, F.lit(50), F.lit(700))
    return table(spark, d, "part").select("p_partkey", frame.alias("frame"))


@query(
    "x19_domain_states",
    """select p_partkey, case kind when 'identical' then 'intact' when 'no_protein' then 'lost' when 'frameshift' then case when e <= a then 'intact' when s >= a then 'lost' else 'disrupted' end when 'in_frame_insertion' then case when s < a and e > a then 'disrupted' else 'intact' end
      else case when e <= a or s >= b then 'intact' when s >= a and e <= b then 'lost' else 'disrupted' end end as state
    from (select p_partkey, ['identical', 'no_protein', 'frameshift', 'in_frame_insertion', 'in_frame_deletion'][p_partkey % 5 + 1] as kind, p_partkey * 3 % 300 as a, p_partkey * 3 % 300 + 20 as b, p_partkey * 7 % 300 as s, p_partkey * 7 % 300 + p_size as e from part)""",
)
def x19(spark, d: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.get(F.array(*[F.lit(x) for x in ("identical", "no_protein", "frameshift", "in_frame_insertion", "in_frame_deletion")]), (k % 5).cast("int"))
    a, s = k * 3 % 300, k * 7 % 300
    return table(spark, d, "part").select("p_partkey", consequence.domain_state(kind, a, a + 20, s + 1, s + F.col("p_size")).alias("state"))


@query(
    "x24_tract_structures",
    """with t as (select p_partkey, repeat('CGG', cast(p_partkey % 5 as integer)) || 'AGG' || repeat('CGG', p_size % 7) as q from part) select p_partkey, trim(case p_partkey % 5 when 0 then '' when 1 then 'CGG ' else '(CGG)' || p_partkey % 5 || ' ' end || 'AGG' || case p_size % 7 when 0 then '' when 1 then ' CGG' else ' (CGG)' || p_size % 7 end) as structure from t join part using (p_partkey)""",
)
def x24(spark, d: str) -> DataFrame:
    q = F.concat(F.repeat(F.lit("CGG"), (F.col("p_partkey") % 5).cast("int")), F.lit("AGG"), F.repeat(F.lit("CGG"), (F.col("p_size") % 7).cast("int")))
    x = table(spark, d, "part").select("p_partkey", q.alias("q"))
    return x.select("p_partkey", consequence.tract_structure(F.col("q"), 3).alias("structure"))


@query(
    "x18_protein_differences",
    """with x as (select p_partkey as id, a, case p_partkey % 4 when 0 then a when 1 then a[1:5] || a[8:] when 2 then a[1:6] || 'AK' || a[7:] else a[1:4] end as b, p_partkey % 3 <> 0 as stop from (select p_partkey, translate(md5(p_name)[1:12], '0123456789abcdef', 'MAKLMAKLMAKLMAKL') as a from part)),
    p as (select *, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) - 1, least(len(a), len(b))) as p from x),
    n as (select *, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) - p + 1), lambda i: a[len(a) - i + 1] <> b[len(b) - i + 1])) - 1, least(len(a), len(b)) - p) as n from p)
    select id, case when a = b then 'identical' when not stop then case when len(b) > p then 'frameshift' else 'truncation' end when len(a) - n > p and len(b) - n > p then 'in_frame_indel' when len(a) - n > p then 'in_frame_deletion' else 'in_frame_insertion' end as kind,
      cast(p as integer) as lost_from, cast(case when a = b then p when not stop then len(a) else len(a) - n end as integer) as lost_to, case when a = b then '' when not stop then b[p + 1:] else b[p + 1:len(b) - n] end as inserted from n""",
)
def x18(spark, d: str) -> DataFrame:
    a = F.translate(F.substring(F.md5("p_name"), 1, 12), "0123456789abcdef", "MAKLMAKLMAKLMAKL")
    x = table(spark, d, "part").select(F.col("p_partkey").alias("id"), a.alias("a"))
    cut = F.concat(F.substring("a", 1, 5), F.substring("a", 8, 12))
    more = F.concat(F.substring("a", 1, 6), F.lit("AK"), F.substring("a", 7, 12))
    b = F.when(F.col("id") % 4 == 0, F.col("a")).when(F.col("id") % 4 == 1, cut).when(F.col("id") % 4 == 2, more).otherwise(F.substring("a", 1, 4))
    x = x.withColumn("b", b)
    return x.select("id", consequence.protein_difference(F.col("a"), F.col("b"), F.col("id") % 3 != 0).alias("d")).select("id", "d.*")


@query(
    "x24_motifs",
    """with s as (select p_partkey as id, repeat(translate(md5(p_name), '0123456789abcdef', 'ACGTACGTACGTACGT')[1:p_size % 6 + 1], 8) || translate(md5(p_name || 'x'), '0123456789abcdef', 'ACGTACGTACGTACGT')[1:9] as seq from part),
    u as (select id, k, len(seq) - k + 1 as places, i, seq[i:i + k - 1] as u from s, range(1, 7) r(k), range(1, 60) q(i) where len(seq) >= 3 * k and i <= len(seq) - k + 1),
    c as (select id, k, places, list_min(list_transform(range(1, k + 1), lambda r: (u || u)[r:r + k - 1])) as unit, count(*) as n, min(i) as first from u group by id, k, places, list_min(list_transform(range(1, k + 1), lambda r: (u || u)[r:r + k - 1]))),
    t as (select *, row_number() over (partition by id, k order by n desc, first) as r from c),
    b as (select id, list({'unit': unit, 'share': n / places::double} order by k) as l from t where r = 1 and len(list_filter(range(1, k), lambda m: (unit || unit)[m + 1:m + k] = unit)) = 0 group by id),
    x as (select id, list_reduce(l, lambda a, v: case when v.share > a.share + 0.05 then v else a end) as best from b)
    select id, best.unit as motif, round(best.share, 6) as share from x where best.share >= 0.5""",
)
def x24_motifs(spark, d: str) -> DataFrame:
    dna = lambda c: F.translate(F.md5(c), "0123456789abcdef", "ACGTACGTACGTACGT")
    unit = F.substring(dna(F.col("p_name")), F.lit(1), F.col("p_size") % 6 + 1)
    seq = F.concat(F.repeat(unit, F.lit(8)), F.substring(dna(F.concat("p_name", F.lit("x"))), 1, 9))
    return consequence.motifs(table(spark, d, "part").select(F.col("p_partkey").alias("id"), seq.alias("seq")), "id").withColumn("share", F.round("share", 6))


@query(
    "x24_tract_tokens",
    """with recursive s as (select p_partkey as id, array_to_string(list_transform(string_split(md5(p_name)[1:14], ''), lambda c: case when c in ('0', '1', '2', '3', '4', '5', '6') then 'CGG' when c in ('7', '8') then 'AGG' when c in ('9', 'a') then 'CGA' when c in ('b', 'c') then 'T' when c = 'd' then 'GG' else 'TTT' end), '') as t from part),
    w as (select id, t, 0 as i, '' as x from s union all
      select id, t, case when t[i + 1:i + 3] in ('CGG', 'CGA', 'AGG') then i + 3 when t[i + 2:i + 4] in ('CGG', 'CGA') then i + 1 when t[i + 3:i + 5] in ('CGG', 'CGA') then i + 2 else i + 3 end,
        case when t[i + 1:i + 3] = 'CGG' then x || 'P' when t[i + 1:i + 3] = 'CGA' then x || 'B' when t[i + 1:i + 3] = 'AGG' then x || 'I' when t[i + 2:i + 4] in ('CGG', 'CGA') or t[i + 3:i + 5] in ('CGG', 'CGA') then x else x || 'o' end from w where i + 3 <= len(t))
    select id, x as tokens from w where i + 3 > len(t)""",
)
def x24_tokens(spark, d: str) -> DataFrame:
    unit = lambda c: F.when(c < "7", "CGG").when(c < "9", "AGG").when(c <= "a", "CGA").when(c <= "c", "T").when(c == "d", "GG").otherwise("TTT")
    tract = F.array_join(F.transform(F.split(F.substring(F.md5("p_name"), 1, 14), ""), unit), "")
    x = table(spark, d, "part").select(F.col("p_partkey").alias("id"), tract.alias("t"))
    return x.select("id", consequence.tract_tokens(F.col("t"), ["CGG"], ["CGA"], ["AGG"], 3).alias("tokens"))


@query(
    "m06_place_clips",
    """with w as (select p_partkey as win, 500 as start, translate(md5(p_name) || md5(p_name || 'a') || md5(p_name || 'b'), '0123456789abcdef', 'ACGTACGTACGTACGT') as seq from part),
    c as (select win, k as clip, case k when 1 then translate(reverse(x), 'ACGT', 'TGCA') when 2 then x[1:25] || translate(x[26], 'ACGT', 'CATG') || x[27:] else x end as q from (select win, cast(k as integer) as k, seq[(win * 7 + k * 13) % 60 + 1:(win * 7 + k * 13) % 60 + 30] as x from w, range(3) r(k))),
    st as (select win, start, '+' as strand, seq as t from w union all select win, start, '-', translate(reverse(seq), 'ACGT', 'TGCA') from w),
    h as (select c.win, clip, q, strand, start, t, i - 1 as p, count(*) over (partition by c.win, clip) as hits from c join st on st.win = c.win, range(1, 78) r(i) where t[i:i + 19] = q[1:20]),
    g as (select *, len(list_filter(range(1, 31), lambda j: t[p + j] <> q[j])) as bad from h where hits = 1 and p + 30 <= 96)
    select win, clip, cast(start + case strand when '+' then p else 66 - p end as integer) as s, cast(start + case strand when '+' then p else 66 - p end + 30 as integer) as e, strand from g where bad <= 1""",
)
def m06(spark, d: str) -> DataFrame:
    text = F.concat(F.md5("p_name"), F.md5(F.concat("p_name", F.lit("a"))), F.md5(F.concat("p_name", F.lit("b"))))
    w = table(spark, d, "part").select(F.col("p_partkey").alias("win"), F.lit(500).alias("start"), F.translate(text, "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"))
    c = w.select("win", "seq", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("clip"))
    x = F.substring("seq", ((F.col("win") * 7 + F.col("clip") * 13) % 60 + 1).cast("int"), F.lit(30))
    c = c.withColumn("x", x)
    odd = F.concat(F.substring("x", 1, 25), F.translate(F.substring("x", 26, 1), "ACGT", "CATG"), F.substring("x", 27, 30))
    q = F.when(F.col("clip") == 1, placement.reverse_complement(F.col("x"))).when(F.col("clip") == 2, odd).otherwise(F.col("x"))
    return placement.place_clips(c.select("win", "clip", q.alias("seq"), F.lit(True).alias("right")), w, "win")
