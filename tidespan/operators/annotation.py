"""Annotation of calls and sites by dimension tables, support of arcs by reads, and summaries of genes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidespan.functions import stats
from tidespan.operators.intervals import by_id, meetings, merged, outermost, overlap_join, point_join
from tidespan.session import store

DGV_COVER = 0.8
#: Fragments of each haplotype, Fisher's p and difference of shares from which a junction is allelic.
LEAST_READS, ALLELIC_P, ALLELIC_DELTA = 3, 1e-3, 0.2


def dgv_hits(calls: DataFrame, records: DataFrame) -> DataFrame:
    """Records of a call's chromosome (record, chrom, type, inner is_, ie, outer os, oe) of a call's type or both: the extent that covers more of the call, from 80 % on; else the larger one that lies inside the call. rel says how they lie."""
    # what a pair shows is worked out once for all pairs that are alike, and handed to each where they meet
    asked = calls.groupBy("chrom", "kind", "s", "e").agg(F.collect_list("call").alias("call"))
    pairs, _ = meetings(asked, records.select("chrom", "type", "os", "oe", "is_", "ie", "record"), ["chrom"], ("s", "e"), ("os", "oe"), each="record")
    pairs = pairs.where((F.col("type") == F.col("kind")) | (F.col("type") == "both"))
    n = F.greatest(F.lit(1), F.col("e") - F.col("s"))
    cover = lambda a, b: F.greatest(F.lit(0), F.least("e", b) - F.greatest("s", a)) / n
    within = lambda a, b: F.coalesce((F.col(a) >= F.col("s")) & (F.col(b) <= F.col("e")) & (F.col(b) > F.col(a)), F.lit(False))
    pairs = pairs.withColumns({"_ci": cover("is_", "ie"), "_co": cover("os", "oe"), "_ii": within("is_", "ie"), "_oi": within("os", "oe")})
    # of equal covers the shorter extent, then the one of the later start and end
    shorter, start = (F.col("is_") - F.col("ie")) - (F.col("os") - F.col("oe")), F.col("is_") - F.col("os")
    later = (shorter > 0) | ((shorter == 0) & ((start > 0) | ((start == 0) & (F.col("ie") >= F.col("oe")))))
    inner = (F.col("_ci") > F.col("_co")) | ((F.col("_ci") == F.col("_co")) & F.coalesce(later, F.lit(False)))
    most = F.greatest("_ci", "_co") >= DGV_COVER
    hit = pairs.where(most | F.col("_ii") | F.col("_oi")).withColumn("_inner", F.when(most | (F.col("_ii") & F.col("_oi")), inner).otherwise(F.col("_ii")))
    a, b = (F.when(F.col("_inner"), F.col(i)).otherwise(F.col(o)) for i, o in (("is_", "os"), ("ie", "oe")))
    rel = F.when((a <= F.col("s")) & (b >= F.col("e")), "within").when((F.col("s") <= a) & (F.col("e") >= b), "contains").otherwise("overlaps")
    hit = hit.withColumns({"cover": F.when(F.col("_inner"), F.col("_ci")).otherwise(F.col("_co")), "rel": rel})
    seen = hit.select("call", "record", "cover", "rel")
    return seen.withColumn("record", F.explode("record")).withColumn("call", F.explode("call"))


def genes_of_calls(calls: DataFrame, transcripts: DataFrame, exons: DataFrame) -> DataFrame:
    """(call, symbol, tx, whole, exons) of the genes that a call (call, chrom, s, e) touches on its chromosome, by transcripts (tx, symbol, chrom, a, b, listed) and their exons (tx, symbol, chrom, xs, xe). tx is the principal model, listed ones first, then the longest, then the least name; whole: the call holds it; exons: the call touches an exon of any of the gene's transcripts."""
    gene = ["symbol", "chrom"]
    # a transcript inside a better one of its gene is never the principal model of a call; of the others the least place is
    first = transcripts.groupBy(*gene, "a", "b", (~F.col("listed")).cast("int").alias("_o")).agg(F.min("tx").alias("tx")).withColumn("_n", F.col("a") - F.col("b"))
    order = ["_o", "_n", "tx"]
    placed = outermost(first, gene, "a", "b", order).withColumn("_place", F.row_number().over(Window.partitionBy(*gene).orderBy(*order)).cast("long"))
    # written, as places are joined on
    models = store(placed.select(*gene, "a", "b", *order, "_place"), "outer-models")
    span = lambda s, e, place: F.struct(F.col(s).alias("a"), F.col(e).alias("b"), place.alias("_place"))
    places = models.select(*gene, span("a", "b", F.col("_place")).alias("x"))
    # exons that overlap are touched as one
    touched = merged(exons.where("xs < xe"), gene, 0, "xs", "xe").select(*gene, span("s", "e", F.lit(None).cast("long")).alias("x"))
    features = places.unionByName(touched).select(*gene, "x.*")

    def found(rows: DataFrame) -> DataFrame:
        hit, at = meetings(rows.select("call", "chrom", "s", "e"), features, ["chrom"], ("s", "e"), ("a", "b"))
        partly = (F.col("a") < F.col("s")) | (F.col("b") > F.col("e"))
        # a place, and whether the call does not hold it: one number, so that groups are hashed
        got = hit.groupBy(*at, "call", "s", "e", "symbol").agg(F.min(F.col("_place") * 2 + partly.cast("int")).alias("_p"), F.max(F.col("_place").isNull()).alias("exons"))
        return got.where("_p is not null").select("call", "symbol", "chrom", F.floor(F.col("_p") / 2).alias("_place"), (F.col("_p") % 2 == 0).alias("whole"), "exons")

    named = lambda rows: found(rows).join(models.select(*gene, "_place", *order), [*gene, "_place"]).select("call", "symbol", *order, "whole", "exons")
    best = F.min(F.struct(*order, "whole")).alias("p")
    one = lambda rows: rows.groupBy("call", "symbol").agg(best, F.bool_or("exons").alias("exons")).select("call", "symbol", "p._o", "p._n", "p.tx", "p.whole", "exons")
    return by_id(calls, named, one).select("call", "symbol", "tx", "whole", "exons")


def dosage_reading(effect: Column, hi: Column, ts: Column) -> Column:
    """high, moderate or low, of a gene's dosage scores under a loss, a gain or a change of place; null where they say nothing."""
    return (
        F.when(effect == "loss", F.when(hi == 3, "high").when(hi == 2, "moderate").when(hi.isin(30, 40), "low"))
        .when(effect == "gain", F.when(ts == 3, "high").when(ts == 2, "moderate").when(ts.isNotNull(), "low"))
        .when(effect == "moved", F.when((hi == 3) | (ts == 3), "moderate"))
    )


def reads_at_sites(reads: DataFrame, sites: DataFrame, on: list[str], width: int = 256) -> DataFrame:
    """Reads that span a site, with their distance to the nearer end."""
    hit = point_join(sites, reads, on, "pos", ("s", "e"), width)
    return hit.withColumn("to_end", F.least(F.col("pos") - F.col("s"), F.col("e") - 1 - F.col("pos")))


def site_depths(reads: DataFrame, sites: DataFrame, on: list[str], site: str, alt: Column, near: int = 10) -> DataFrame:
    """(site, depth, alt, near_end) of sites (site, on, pos) that reads (on, s, e) span: how many, how many of them with the alternate base, and how many with an end nearer than `near`. Reads of one extent are counted first, and each position is asked for once."""
    like = reads.groupBy(*on, "s", "e").agg(F.count(F.lit(1)).alias("n"), F.count_if(alt).alias("alt"))
    hit = reads_at_sites(like, sites.select(*on, "pos").distinct(), on)
    at = hit.groupBy(*on, "pos").agg(F.sum("n").alias("depth"), F.sum("alt").alias("alt"), F.sum(F.when(F.col("to_end") < near, F.col("n")).otherwise(0)).alias("near_end"))
    return sites.join(at, [*on, "pos"]).groupBy(site).agg(*[F.sum(c).alias(c) for c in ("depth", "alt", "near_end")])


def boundary_spanning(blocks: DataFrame, boundaries: DataFrame, on: list[str], exonic: int = 6, intronic: int = 10, width: int = 256) -> DataFrame:
    """(on, side, pos, n): unspliced reads whose block goes at least 6 bases into the exon and 10 into the intron of each boundary (side, pos; intronStart has the exon on its left)."""
    left = F.when(F.col("side") == "intronStart", F.lit(exonic)).otherwise(F.lit(intronic))
    right = F.when(F.col("side") == "intronStart", F.lit(intronic)).otherwise(F.lit(exonic))
    hit = point_join(boundaries, blocks, on, "pos", ("s", "e"), width)
    return hit.where((F.col("s") <= F.col("pos") - left) & (F.col("e") >= F.col("pos") + right)).groupBy(*on, "side", "pos").agg(F.count(F.lit(1)).alias("n"))


def supports(kind: Column, read_s: Column, read_e: Column, arc_s: Column, arc_e: Column, slack: int = 5) -> Column:
    """Whether a read's gap (read_s, read_e) supports an arc: exactly for junctions, within slack at both ends for deletions."""
    exact = (read_s == arc_s) & (read_e == arc_e)
    near = (F.abs(read_s - arc_s) <= slack) & (F.abs(read_e - arc_e) <= slack)
    return F.when(kind == "junction", exact).otherwise(near)


def pooled_spanning(spanning: DataFrame, keys: list[str]) -> DataFrame:
    """Reads across boundaries (sample, keys, side, pos, n), added over samples, and how many samples have some."""
    return spanning.groupBy(*keys, "side", "pos").agg(F.sum("n").alias("n"), F.countDistinct(F.when(F.col("n") > 0, F.col("sample"))).alias("samples"))


SUGGESTIONS = 10


def suggested_genes(query: str, local: DataFrame, remote: DataFrame) -> DataFrame:
    """(place, gene, local): at most ten genes whose symbols start with the letters, those of the session (gene, ord) first in their order, then those of the directory (gene, alias): the symbol itself, symbols that start with the letters, then aliases; shorter ones first. One row a symbol, whatever its case."""
    key = query.strip().upper()
    up = F.upper("gene")
    own = local.where(F.startswith(up, F.lit(key))).groupBy(up.alias("_up")).agg(F.min(F.struct("ord", "gene")).alias("m")).select("_up", F.col("m.gene").alias("gene"), F.lit(0).alias("k"), F.col("m.ord").cast("long").alias("o"))
    rank = F.when(up == key, 1).when(F.startswith(up, F.lit(key)), 2).when(F.startswith(F.upper("alias"), F.lit(key)), 3)
    far = remote.select(up.alias("_up"), "gene", rank.alias("k"), F.length("gene").cast("long").alias("o")).where("k is not null")
    both = own.unionByName(far).groupBy("_up").agg(F.min(F.struct("k", "o", "gene")).alias("m")).select("m.*")
    first = both.orderBy("k", "o", "gene").limit(SUGGESTIONS)
    return first.select(F.row_number().over(Window.orderBy("k", "o", "gene")).alias("place"), "gene", (F.col("k") == 0).alias("local"))


def modes_of_inheritance(entries: DataFrame) -> DataFrame:
    """(gene, mode, sources): AD, AR, AD+AR, XLD, XLR or ? over a gene's entries (gene, text)."""
    t = F.lower(F.coalesce(F.col("text"), F.lit("")))
    has = lambda p: F.bool_or(t.rlike(p))
    g = entries.groupBy("gene").agg(has("x-linked").alias("x"), has("x-linked.*dominant").alias("xd"), has("(^|[^-])monoallelic|autosomal dominant|both mono").alias("d"), has("biallelic|autosomal recessive|both mono").alias("r"), F.count(F.lit(1)).alias("sources"))
    mode = F.when(F.col("x"), F.when(F.col("xd"), "XLD").otherwise("XLR")).when(F.col("d") & F.col("r"), "AD+AR").when(F.col("d"), "AD").when(F.col("r"), "AR").otherwise("?")
    return g.select("gene", mode.alias("mode"), "sources")


def allelic_junctions(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Use of each junction by haplotype against the fragments that could show it: (keys, s, e, use1, use2, delta, p, allelic). counts: (keys, s, e, hap, used, reads). Allelic: three fragments of either, Fisher's p under 0.001 and a difference of at least 0.2."""
    g = counts.groupBy(*keys, "s", "e").agg(*[F.sum(F.when(F.col("hap") == h, F.col(c)).otherwise(0)).alias(f"{c}{h}") for h in (1, 2) for c in ("used", "reads")])
    u1, u2 = F.try_divide(F.col("used1").cast("double"), "reads1"), F.try_divide(F.col("used2").cast("double"), "reads2")
    g = g.withColumns({"use1": F.coalesce(u1, F.lit(0.0)), "use2": F.coalesce(u2, F.lit(0.0))}).withColumn("delta", F.abs(F.col("use1") - F.col("use2")))
    cells = {"_a": F.col("used1"), "_b": F.col("reads1") - F.col("used1"), "_c": F.col("used2"), "_d": F.col("reads2") - F.col("used2")}
    g = g.withColumns({k: v.cast("int") for k, v in cells.items()})
    g = g.withColumn("p", stats.fisher("_a", "_b", "_c", "_d"))
    deep = (F.col("reads1") >= LEAST_READS) & (F.col("reads2") >= LEAST_READS)
    return g.withColumn("allelic", deep & (F.col("p") < ALLELIC_P) & (F.col("delta") >= ALLELIC_DELTA)).drop("_a", "_b", "_c", "_d")


#: Lengths of chromosome 1 by build.
FIRST_CHROMOSOME = {248956422: "GRCh38", 249250621: "GRCh37", 248387328: "T2T-CHM13", 247249719: "NCBI36"}


def assembly(header: Column) -> Column:
    """Build of a header: by the assembly it names, else by the length of its first chromosome; null where neither tells."""
    sq = F.filter(F.split(header, "\n"), lambda x: x.startswith("@SQ"))
    named = F.lower(F.coalesce(F.get(F.filter(F.transform(sq, lambda x: F.regexp_extract(x, "\\tAS:([^\\t]+)", 1)), lambda x: x != ""), F.lit(0)), F.lit("")))
    one = F.get(F.filter(sq, lambda x: x.rlike("\\tSN:(chr)?1(\\t|$)")), F.lit(0))
    n = F.regexp_extract(one, "\\tLN:([0-9]+)", 1)
    by_length = F.lit(None).cast("string")
    for length, build in FIRST_CHROMOSOME.items():
        by_length = F.when(n == str(length), build).otherwise(by_length)
    return F.when(named.rlike("grch38|hg38"), "GRCh38").when(named.rlike("grch37|hg19|b37|hs37"), "GRCh37").otherwise(by_length)


def located_exons(rows: DataFrame, exons: DataFrame, on: str) -> DataFrame:
    """(on, id, s, e, by) of expression rows (on, id, s, e: what they say themselves, or null) under a gene's exons (on, exon, xs, xe, merged): by the exon's name whatever its version and case, else by the number behind it, else, for models whose exons are numbered in order, by rank from the least number, else by their own coordinates; rows that nothing places are left out.

    on names the gene. Exons of a merged model go by rank (where rows and exons differ by two at most), others by number.
    """
    bare = lambda c: F.lower(F.regexp_replace(c, "\\.[0-9]+(?=_|$)", ""))
    number = lambda c: F.regexp_extract(c, "_([0-9]+)$", 1).try_cast("long")
    x = exons.select(on, bare(F.col("exon")).alias("_name"), number(F.col("exon")).alias("_number"), "xs", "xe", "merged")
    x = x.withColumn("_rank", F.row_number().over(Window.partitionBy(on).orderBy("_number", "xs")) - 1)
    n = x.groupBy(on).agg(F.count(F.lit(1)).alias("_exons"))
    r = rows.withColumns({"_key": bare(F.col("id")), "_k": number(F.col("id"))})
    base = r.groupBy(on).agg(F.min("_k").alias("_base"), F.count(F.lit(1)).alias("_rows"))
    r = r.join(base, on).join(n, on, "left")
    at = lambda s, e, how: F.struct(s.alias("xs"), e.alias("xe"), F.lit(how).alias("by"))
    one = x.select(on, F.col("_name").alias("_key"), at(F.col("xs"), F.col("xe"), "name").alias("_by_name")).dropDuplicates([on, "_key"])
    two = x.where("not merged").select(on, F.col("_number").alias("_k"), at(F.col("xs"), F.col("xe"), "number").alias("_by_number")).dropDuplicates([on, "_k"])
    three = x.where("merged").select(on, F.col("_rank").alias("_place"), at(F.col("xs"), F.col("xe"), "rank").alias("_by_rank"))
    j = r.withColumn("_place", F.when(F.abs(F.col("_exons") - F.col("_rows")) <= 2, F.col("_k") - F.col("_base"))).join(one, [on, "_key"], "left").join(two, [on, "_k"], "left").join(three, [on, "_place"], "left")
    own = F.when(F.col("e") > F.col("s"), at(F.col("s"), F.col("e"), "own"))
    j = j.withColumn("_x", F.coalesce("_by_name", "_by_number", "_by_rank", own)).where("_x is not null")
    return j.select(on, "id", F.col("_x.xs").alias("s"), F.col("_x.xe").alias("e"), F.col("_x.by").alias("by"))
