"""Joints of rearrangements: what split reads say lies between two breakends, by the vote of one read of each name; what they share, what was inserted, and where that comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidespan.functions.reads import reverse_complement
from tidespan.operators.rescue import slices

#: How near a part ends to a breakend, how far shared bases are followed, least length and distance of a template, bases per mismatch of one; least shared bases that speak for end joining by homology, most inserted ones that speak for a few added bases.
AT_END, SLIDE, TEMPLATE_LEAST, TEMPLATE_SPAN, TEMPLATE_MISMATCH = 20, 200, 10, 5000, 10
MANY_SHARED, FEW_INSERTED = 5, 20


def votes(parts: DataFrame, junctions: DataFrame) -> DataFrame:
    """(junction, ins, shared, pos_a, pos_b, n, first): how many read names speak for each joint.

    parts: (name, read, ord, contig, s, e, rev, qs, qe, seq), all parts of a read on it (qs and qe in the read's own direction,
    which seq has). junctions: (junction, a_contig, a_pos, a_side, b_contig, b_pos, b_side); a tail is left at its position, a
    head entered. A part meets a breakend within 20 bases; of a read's parts the first at a and the first other one at b count;
    of a name's reads the first that has both, with a's part before b's along the rearranged chromosome.
    """
    j = junctions.select("junction", *[F.col(f"{x}_{c}") for x in "ab" for c in ("contig", "pos", "side")])

    def meeting(x: str) -> DataFrame:
        near = F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("_o")
        bins = j.select("junction", F.col(f"{x}_contig").alias("contig"), F.col(f"{x}_pos").alias("_pos"), F.col(f"{x}_side").alias("_side"), near).withColumn("_bin", F.floor(F.col("_pos") / AT_END) + F.col("_o"))
        tip = F.array(F.struct(F.lit("tail").alias("_side"), F.col("e").alias("_tip")), F.struct(F.lit("head").alias("_side"), F.col("s").alias("_tip")))
        p = parts.select("*", F.inline(tip)).withColumn("_bin", F.floor(F.col("_tip") / AT_END))
        hit = p.join(bins, ["contig", "_side", "_bin"]).where(F.abs(F.col("_tip") - F.col("_pos")) <= AT_END)
        what = F.struct("ord", "s", "e", "rev", "qs", "qe")
        return hit.groupBy("junction", "name", "read").agg(F.array_sort(F.collect_set(what)).alias(f"_{x}"), F.first("seq").alias(f"_seq_{x}"))

    both = meeting("a").join(meeting("b"), ["junction", "name", "read"]).join(j, "junction")
    both = both.withColumn("a", F.get("_a", F.lit(0)))
    both = both.withColumn("b", F.get(F.filter("_b", lambda p: p["ord"] != F.col("a.ord")), F.lit(0))).where("b is not null")
    strand_a, strand_b = F.col("a_side") == "tail", F.col("b_side") == "head"
    same = ~F.col("a.rev") == strand_a
    n = F.length("_seq_a")
    text = F.when(same, F.col("_seq_a")).otherwise(reverse_complement(F.col("_seq_a")))
    turned = lambda p: (F.when(same, F.col(f"{p}.qs")).otherwise(n - F.col(f"{p}.qe")), F.when(same, F.col(f"{p}.qe")).otherwise(n - F.col(f"{p}.qs")))
    (a_from, a_to), (b_from, _) = turned("a"), turned("b")
    gap = b_from - a_to
    x = both.where(b_from >= a_from).select(
        "junction", "name", "read",
        F.when(gap > 0, F.substring(text, (a_to + 1).cast("int"), F.greatest(gap, F.lit(0)).cast("int"))).otherwise("").alias("ins"),
        F.greatest(-gap, F.lit(0)).cast("int").alias("shared"),
        F.when(strand_a, F.col("a.e")).otherwise(F.col("a.s")).cast("int").alias("pos_a"),
        F.when(strand_b, F.col("b.s")).otherwise(F.col("b.e")).cast("int").alias("pos_b"),
    )
    one = x.groupBy("junction", "name").agg(F.min(F.struct("read", "ins", "shared", "pos_a", "pos_b")).alias("v")).select("junction", "v.*")
    return one.groupBy("junction", "ins", "shared", "pos_a", "pos_b").agg(F.count(F.lit(1)).alias("n"), F.min("read").alias("first"))


def alike(a: Column, b: Column) -> Column:
    """How many first characters two texts share."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.when(first > 0, first - 1).otherwise(F.least(F.length(a), F.length(b)))).cast("int")


def sides(best: DataFrame, tiles: DataFrame, width: int) -> DataFrame:
    """best with a_back, a_on, b_back, b_on: up to 200 bases before and after the joint as either chromosome goes on there, each read away from the joint."""
    ends = tiles.groupBy("contig").agg((F.max("tile") * width + F.max_by(F.length("seq"), "tile")).alias("_end"))
    plus_a, plus_b = F.col("a_side") == "tail", F.col("b_side") == "head"
    cut_a = F.when(plus_a, F.col("pos_a") - F.col("shared")).otherwise(F.col("pos_a") + F.col("shared"))
    # left of the cut going down, or right of it going up
    stretch = lambda what, contig, cut, left: F.struct(F.lit(what).alias("what"), contig.alias("contig"), cut.cast("long").alias("cut"), left.alias("left"))
    asked = best.select(
        "junction",
        F.inline(F.array(
            stretch("a_back", F.col("a_contig"), cut_a, plus_a), stretch("a_on", F.col("a_contig"), cut_a, ~plus_a),
            stretch("b_back", F.col("b_contig"), F.col("pos_b"), plus_b), stretch("b_on", F.col("b_contig"), F.col("pos_b"), ~plus_b),
        )),
    )
    asked = asked.join(ends, "contig").withColumn("at", F.when(F.col("left"), F.greatest(F.lit(0), F.col("cut") - SLIDE)).otherwise(F.col("cut")))
    asked = asked.withColumn("n", F.when(F.col("left"), F.col("cut") - F.col("at")).otherwise(F.least(F.lit(SLIDE), F.col("_end") - F.col("cut")))).withColumn("id", F.concat_ws(":", "junction", "what"))
    got = asked.join(slices(asked, tiles, "contig", width), "id", "left")
    # bases on the strand that is read, away from the joint
    text = F.when(F.col("left"), F.reverse("bases")).otherwise(F.col("bases"))
    crossed = F.when(F.col("what").startswith("a") & (F.col("left") != (F.col("what") == "a_back")) | F.col("what").startswith("b") & (F.col("left") != (F.col("what") == "b_back")), F.translate(text, "ACGTN", "TGCAN")).otherwise(text)
    wide = got.groupBy("junction").agg(*[F.coalesce(F.max(F.when(F.col("what") == w, crossed)), F.lit("")).alias(w) for w in ("a_back", "a_on", "b_back", "b_on")])
    return best.join(wide, "junction")


def templates(best: DataFrame, tiles: DataFrame, width: int) -> DataFrame:
    """(junction, t_contig, t_pos, t_strand, mismatches) of inserted bases, from 10 on, that lie within 5,000 bases of a breakend on either strand with at most one mismatch in ten; the fewest mismatches, then the first end, strand and place."""
    q = best.where((F.length("ins") >= TEMPLATE_LEAST) & ~F.contains("ins", F.lit("N")))
    ends = tiles.groupBy("contig").agg((F.max("tile") * width + F.max_by(F.length("seq"), "tile")).alias("_end"))
    end = lambda k, x: F.struct(F.lit(k).alias("k"), F.col(f"{x}_contig").alias("contig"), F.col(f"{x}_pos").cast("long").alias("mid"))
    asked = q.select("junction", "ins", F.inline(F.array(end(0, "a"), end(1, "b")))).join(ends, "contig")
    asked = asked.withColumn("at", F.greatest(F.lit(0), F.col("mid") - TEMPLATE_SPAN)).withColumn("n", F.least(F.col("mid") + TEMPLATE_SPAN, F.col("_end")) - F.col("at")).withColumn("id", F.concat_ws(":", "junction", F.col("k").cast("string")))
    text = asked.join(slices(asked, tiles, "contig", width), "id")
    strand = lambda k, s: F.struct(F.lit(k).alias("o"), s.alias("q"))
    tried = text.select("junction", "contig", "k", "at", "bases", F.inline(F.array(strand(0, F.col("ins")), strand(1, reverse_complement(F.col("ins"))))))
    n = F.length("q")
    spots = tried.where(n <= F.length("bases")).withColumn("i", F.explode(F.sequence(F.lit(0), F.length("bases") - n)))
    unlike = F.size(F.filter(F.zip_with(F.split(F.substring("bases", F.col("i") + 1, n), ""), F.split("q", ""), lambda a, b: a != b), lambda x: x))
    hits = spots.withColumn("mismatches", unlike).where(F.col("mismatches") <= F.floor(n / TEMPLATE_MISMATCH))
    best_hit = hits.groupBy("junction").agg(F.min(F.struct("mismatches", "k", "o", "i", "contig", (F.col("at") + F.col("i")).alias("pos"))).alias("h"))
    return best_hit.select("junction", F.col("h.contig").alias("t_contig"), F.col("h.pos").alias("t_pos"), F.when(F.col("h.o") == 0, "+").otherwise("-").alias("t_strand"), F.col("h.mismatches").alias("mismatches"))


def joints(parts: DataFrame, junctions: DataFrame, tiles: DataFrame, width: int) -> DataFrame:
    """(junction, reads, agree, ins, pos_a, pos_b, slide_left, slide_right, homology, t_contig, t_pos, t_strand, mismatches, hint): the joint most names agree on (of equals the one first read). Without inserted bases the two sides are compared on either side of the joint for as long as they read alike: those bases may belong to either."""
    v = votes(parts, junctions)
    all_ = v.groupBy("junction").agg(F.sum("n").alias("reads"), F.min(F.struct((-F.col("n")).alias("m"), "first", "ins", "shared", "pos_a", "pos_b")).alias("b"))
    best = all_.select("junction", "reads", (-F.col("b.m")).alias("agree"), "b.ins", "b.shared", "b.pos_a", "b.pos_b").join(junctions, "junction")
    x = sides(best, tiles, width)
    blunt = F.col("ins") == ""
    x = x.withColumns({"slide_left": F.when(blunt, alike(F.col("a_back"), F.col("b_back"))).otherwise(0), "slide_right": F.when(blunt, alike(F.col("a_on"), F.col("b_on"))).otherwise(0)})
    x = x.withColumn("homology", F.concat(F.reverse(F.substring("a_back", F.lit(1), F.col("slide_left"))), F.substring("a_on", F.lit(1), F.col("slide_right"))))
    x = x.join(templates(best, tiles, width), "junction", "left")
    n = F.length("homology")
    hint = (
        F.when(F.col("t_pos").isNotNull(), "templated")
        .when(~blunt, F.when(F.length("ins") <= FEW_INSERTED, "few_inserted").otherwise("long_inserted"))
        .when(n >= MANY_SHARED, "microhomology")
        .when(n > 0, "short_homology")
        .otherwise("blunt")
    )
    return x.select("junction", "reads", "agree", "ins", "pos_a", "pos_b", "slide_left", "slide_right", "homology", "t_contig", "t_pos", "t_strand", "mismatches", hint.alias("hint"))
