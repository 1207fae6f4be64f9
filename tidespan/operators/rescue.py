"""Evidence that moves: clipped read ends rescued at known breakpoints, clip clusters placed and typed, insertions told from tandem copies.

The reference is a table of tiles (contig, tile, seq) of one width, so that no contig is one row; what is compared with it asks
for a slice, which is put together from the tiles it touches. Clips meet breakpoints by equal positions (a breakpoint's end is
given for each position within the tolerance), never as pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidespan.functions.reads import reference_length, reverse_complement
from tidespan.operators.intervals import islands
from tidespan.operators.placement import place_clips
from tidespan.operators.rearrangement import LEAST_CLIP, LEAST_DELETION, RESCUE_CLIP, SUPPORT
from tidespan.session import dealt, store

#: Bases a clip needs where several breakpoints end, how far from an end it may sit, bases per mismatch let pass.
CLIP_OF_SEVERAL, TOLERANCE, MISMATCH_EVERY = 12, 2, 20
#: How far insertions of one group may lie apart, and differ in length; bases of a probe for a tandem copy, and how far it may be off.
GROUP_APART, GROUP_LENGTH, PROBE, PROBE_SLACK = 5, 0.1, 24, 60
ROUND_TO = 5


def rounded(pos: Column) -> Column:
    return (F.floor((pos + ROUND_TO / 2) / ROUND_TO) * ROUND_TO).cast("int")


def slices(asked: DataFrame, tiles: DataFrame, on: str, width: int, key: str = "id") -> DataFrame:
    """(key, bases) of the stretches (key, on, at, n) of the reference; stretches that are empty or leave it have no row."""
    ask = asked.where("n > 0 and at >= 0").select(key, on, "at", "n", F.explode(F.sequence(F.floor(F.col("at") / width), F.floor((F.col("at") + F.col("n") - 1) / width))).alias("tile"))
    hit = ask.join(tiles.select(on, F.col("tile").cast("long").alias("tile"), "seq"), [on, "tile"])
    whole = hit.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("tile", "seq"))).alias("_t"), F.first("at").alias("at"), F.first("n").alias("n"))
    text = F.array_join(F.transform("_t", lambda t: t["seq"]), "")
    first = F.get("_t", F.lit(0))["tile"]
    cut = F.substring(text, (F.col("at") - first * width + 1).cast("int"), F.col("n").cast("int"))
    return whole.select(key, F.when(F.length(cut) == F.col("n"), cut).alias("bases")).where("bases is not null")


def clip_ends(reads: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, pos, side, seq, hard, n) of reads (keys, id, start, ops, seq, sa) without an SA tag: soft clips of 8 bases or more with their bases, hard clips of 20 or more, where there is no soft one, without."""
    aligned = F.transform("ops", lambda o: o["op"].isin("M", "I", "=", "X", "D", "N"))
    x = reads.where("sa is null or sa = ''").withColumns({"_first": F.array_position(aligned, True), "_size": F.size("ops")})
    x = x.where("_first > 0").withColumn("_last", F.col("_size") + 1 - F.array_position(F.reverse(aligned), True))
    total = lambda ops, kinds: F.aggregate(F.filter(ops, lambda o: o["op"].isin(*kinds)), F.lit(0), lambda a, o: a + o["n"])
    left, right = F.slice("ops", F.lit(1), (F.col("_first") - 1).cast("int")), F.slice("ops", (F.col("_last") + 1).cast("int"), (F.col("_size") - F.col("_last")).cast("int"))
    known = F.col("seq").isNotNull() & (F.length("seq") == total(F.col("ops"), ("M", "I", "S", "=", "X"))) & (F.length("seq") > 0)

    def end(side: str, ops: Column, pos: Column) -> Column:
        soft, hard = total(ops, ("S",)), total(ops, ("H",))
        bases = F.substring("seq", F.lit(1), soft) if side == "left" else F.right("seq", soft)
        is_soft, is_hard = (soft >= RESCUE_CLIP) & known, (soft == 0) & (hard >= LEAST_CLIP)
        what = F.struct(F.lit(side).alias("side"), pos.cast("int").alias("pos"), F.when(is_soft, bases).otherwise("").alias("seq"), is_hard.alias("hard"), F.when(is_hard, hard).otherwise(soft).alias("n"))
        return F.when(is_soft | is_hard, what)

    ends = F.array(end("left", left, F.col("start")), end("right", right, F.col("start") + reference_length(F.col("ops"))))
    return x.select(*keys, "id", F.inline(F.filter(ends, lambda e: e.isNotNull())))


def expected(kind: Column, at_start: Column, side: Column, lo: Column, hi: Column, n: Column) -> Column:
    """struct(at, reverse): the stretch of the reference that a clip reads if its read crosses the breakpoint (lo, hi) at that end; null where that side cannot. A read leaves a deletion's start for its end and comes back the same way; a duplication's end for its start; an inversion's ends for each other on the other strand."""
    right = side == "right"
    ahead = lambda at: F.struct(at.cast("long").alias("at"), F.lit(False).alias("reverse"))
    turned = lambda at: F.struct(at.cast("long").alias("at"), F.lit(True).alias("reverse"))
    other = F.when(at_start, hi).otherwise(lo)
    straight = F.when(right, ahead(other)).otherwise(ahead(other - n))
    leaves = F.when(kind.isin("deletion", "split"), at_start == right).when(kind == "duplication", at_start != right)
    return F.when(kind == "inversion", F.when(right, turned(other - n)).otherwise(turned(other))).when(leaves, straight)


def rescued(ends: DataFrame, breakpoints: DataFrame, tiles: DataFrame, on: str, width: int, sample: str | None = None) -> DataFrame:
    """(on, kind, s, e, [sample,] id, side, pos, hard, n): the clipped ends that fit exactly one breakpoint (on, kind, s, e), with that breakpoint.

    A clip sits at a breakpoint's end within 2 bases (deletions in CIGARs: at it). Its bases must be those at the other end, one
    mismatch for every 20 let pass; 12 bases where several breakpoints end there, else 8. A hard clip has none and must fit
    one breakpoint alone by its side. ends are of clip_ends(), with the sample's column if one is named.
    """
    who = [on, *([sample] if sample else []), "id", "side", "pos", "hard", "n", "seq"]
    off = F.when(F.col("kind") == "deletion", F.array(F.lit(0))).otherwise(F.sequence(F.lit(-TOLERANCE), F.lit(TOLERANCE)))
    tips = breakpoints.select(on, "kind", "s", "e", F.explode(off).alias("d")).withColumn("at_start", F.explode(F.array(F.lit(True), F.lit(False))))
    tips = tips.withColumn("pos", F.when(F.col("at_start"), F.col("s")).otherwise(F.col("e")) + F.col("d"))
    near = ends.select(*who).withColumn("_clip", F.xxhash64(*[c for c in who if c != "seq"])).join(tips, [on, "pos"])
    # three times read below: the ends, which may be long in the making, are asked for once
    near = store(near.withColumn("_near", F.count(F.lit(1)).over(Window.partitionBy("_clip"))), "near-breakpoints")
    kind, side = F.col("kind"), F.col("side")
    by_side = F.when(kind.isin("deletion", "split"), F.col("at_start") == (side == "right")).when(kind == "duplication", F.col("at_start") != (side == "right")).otherwise(F.lit(True))
    hard = near.where(F.col("hard") & by_side).withColumn("_fits", F.lit(True))
    soft = near.where(~F.col("hard") & (F.col("n") >= F.when(F.col("_near") > 1, CLIP_OF_SEVERAL).otherwise(RESCUE_CLIP)))
    soft = soft.withColumn("_x", expected(kind, F.col("at_start"), side, F.col("s") + F.col("d"), F.col("e") + F.col("d"), F.col("n"))).where("_x is not null")
    soft = soft.withColumn("_ask", F.xxhash64("_clip", "kind", "s", "e", "at_start", "d"))
    bases = slices(soft.select(F.col("_ask").alias("id"), on, F.col("_x.at").alias("at"), "n").distinct(), tiles, on, width)
    met = soft.join(bases.withColumnRenamed("id", "_ask"), "_ask")
    target = F.when(F.col("_x.reverse"), reverse_complement(F.col("bases"))).otherwise(F.col("bases"))
    unlike = F.size(F.filter(F.zip_with(F.split("seq", ""), F.split(target, ""), lambda a, b: a != b), lambda x: x))
    met = met.where(unlike <= F.floor(F.col("n") / MISMATCH_EVERY))
    keep = [on, "kind", "s", "e", *([sample] if sample else []), "id", "side", "pos", "hard", "n", "_clip"]
    both = hard.select(*keep).unionByName(met.select(*keep))
    return both.withColumn("_hits", F.count(F.lit(1)).over(Window.partitionBy("_clip"))).where("_hits = 1").drop("_clip", "_hits")


def rescued_counts(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, s, e, count, hard, long) of rescued ends by breakpoint: how many, hard ones, and those that were members of a clip cluster."""
    long = F.col("hard") | (F.col("n") >= LEAST_CLIP)
    return found.groupBy(*keys, "kind", "s", "e").agg(F.count(F.lit(1)).alias("count"), F.count_if("hard").alias("hard"), F.count_if(long).alias("long"))


def breakpoint_of(a_out: Column, b_in: Column, a_rev: Column, b_rev: Column, gap: Column) -> Column:
    """struct(kind, s, e) of two parts of a read that follow each other, where they make an arc on one contig: on different strands an inversion, else by the distance on the reference a deletion's (split) or a duplication. Ends are rounded to 5."""
    s, e = rounded(F.least(a_out, b_in)), rounded(F.greatest(a_out, b_in))
    kind = F.when(a_rev != b_rev, "inversion").when(gap >= LEAST_DELETION, "split").when(gap <= -LEAST_DELETION, "duplication")
    return F.when(kind.isNotNull() & ((kind == "split") | (e > s)), F.struct(kind.alias("kind"), s.alias("s"), e.alias("e")))


def consensus(clips: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq): of clips (keys, side, seq), one letter a column from the breakpoint on, the most frequent where it has 60 % of the clips that reach it, else N; columns that one clip alone reaches are left out where there are more."""
    x = clips.withColumn("_from", F.when(F.col("side") == "left", F.reverse("seq")).otherwise(F.col("seq")))
    each = x.select(*keys, "side", F.posexplode(F.split("_from", "")).alias("i", "c"))
    n = each.groupBy(*keys, "side", "i", "c").agg(F.count(F.lit(1)).alias("k"))
    cols = n.groupBy(*keys, "side", "i").agg(F.sum("k").alias("depth"), F.max(F.struct("k", F.ascii("c").alias("o"), "c")).alias("best"))
    rows = x.groupBy(*keys, "side").agg(F.count(F.lit(1)).alias("rows"))
    kept = cols.join(rows, [*keys, "side"]).where(F.col("depth") >= F.least(F.lit(2), F.col("rows")))
    letter = F.when(F.col("best.k") >= 0.6 * F.col("depth"), F.col("best.c")).otherwise("N")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", letter.alias("c")))), lambda t: t["c"]), "")
    out = kept.groupBy(*keys, "side").agg(text.alias("_t"))
    return out.select(*keys, "side", F.when(F.col("side") == "left", F.reverse("_t")).otherwise(F.col("_t")).alias("seq"))


def realigned(ends: DataFrame, windows: DataFrame, on: str, support: int = SUPPORT) -> DataFrame:
    """(on, pos, side, count, hard, target, strand, matched, kind, s, e) of clip clusters that their consensus places: clipped ends of 20 bases or more (or hard) at one position and side, from three on. The clip's place and its read's end are two parts of a read, and make the arc that a split read would.

    windows: (on, start, seq) to place clips on, one for each value of on, e.g. a stretch around the evidence.
    """
    members = ends.where(F.col("hard") | (F.col("n") >= LEAST_CLIP))
    clusters = members.groupBy(on, "side", "pos").agg(F.count(F.lit(1)).alias("count"), F.count_if("hard").alias("hard")).where(F.col("count") >= support)
    # clips are dealt by cluster before they become letters, so that letters are counted where they are
    texts = consensus(members.where(~F.col("hard")).repartition(on, "side", "pos").join(clusters.select(on, "side", "pos"), [on, "side", "pos"], "left_semi"), [on, "pos"])
    clip = F.concat_ws(":", "side", "pos")
    found = place_clips(texts.select(on, clip.alias("clip"), "seq", (F.col("side") == "right").alias("right")), windows, on)
    x = clusters.withColumn("clip", clip).join(found.select(on, "clip", F.col("s").alias("ps"), F.col("e").alias("pe"), "strand"), [on, "clip"])
    right, back = F.col("side") == "right", F.col("strand") == "-"
    # the aligned side is one base at the clip; a right clip follows it on the read, a left clip comes before it
    a_out = F.when(right, F.col("pos")).when(back, F.col("ps")).otherwise(F.col("pe"))
    b_in = F.when(~right, F.col("pos")).when(back, F.col("pe")).otherwise(F.col("ps"))
    gap = F.when(right, F.col("ps") - F.col("pos")).otherwise(F.col("pos") - F.col("pe"))
    arc = breakpoint_of(a_out, b_in, F.when(right, F.lit(False)).otherwise(back), F.when(right, back).otherwise(F.lit(False)), gap)
    out = x.withColumn("_arc", arc).where("_arc is not null")
    return out.select(on, "pos", "side", "count", "hard", F.col("ps").alias("target"), "strand", (F.col("pe") - F.col("ps")).alias("matched"), "_arc.kind", "_arc.s", "_arc.e")


def own_evidence(arcs: DataFrame, ends: DataFrame, windows: DataFrame, tiles: DataFrame, on: str, width: int) -> DataFrame:
    """(on, kind, s, e, n, by_clip, by_rescue) of arcs (on, kind, s, e, n) of split reads and CIGARs after the evidence of clips has moved: clusters that were placed count with the arc they make, and clipped ends that fit exactly one arc with that one. Members of a placed cluster are counted once, with it."""
    ends = store(ends, "clip-ends")  # asked for six times below
    placed = store(realigned(ends, windows, on), "placed-clips")
    by_clip = placed.groupBy(on, "kind", "s", "e").agg(F.sum("count").alias("by_clip"))
    found = arcs.groupBy(on, "kind", "s", "e").agg(F.sum("n").alias("n")).join(by_clip, [on, "kind", "s", "e"], "full").fillna({"n": 0, "by_clip": 0})
    members = (F.col("hard")) | (F.col("n") >= LEAST_CLIP)
    taken = ends.where(members).join(placed.select(on, "side", "pos"), [on, "side", "pos"], "left_semi")
    rest = ends.join(taken.select(on, "id", "side", "pos"), [on, "id", "side", "pos"], "left_anti")
    by_rescue = rescued_counts(rescued(rest, found.select(on, "kind", "s", "e"), tiles, on, width), [on]).select(on, "kind", "s", "e", F.col("count").alias("by_rescue"))
    out = found.join(by_rescue, [on, "kind", "s", "e"], "left").fillna({"by_rescue": 0})
    return out.withColumn("n", F.col("n") + F.col("by_clip") + F.col("by_rescue"))


def clusters_left(ends: DataFrame, placed: DataFrame, found: DataFrame, on: str) -> DataFrame:
    """(on, side, pos, count) of clip clusters that remain, of those from three on: neither placed, nor made of ends that were rescued."""
    members = ends.where(F.col("hard") | (F.col("n") >= LEAST_CLIP))
    free = members.join(placed.select(on, "side", "pos"), [on, "side", "pos"], "left_anti").join(found.select(on, "id", "side", "pos"), [on, "id", "side", "pos"], "left_anti")
    return free.groupBy(on, "side", "pos").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= SUPPORT)


def insertion_groups(insertions: DataFrame, on: str) -> DataFrame:
    """(on, pos, len, seq, reads) of insertions (on, pos, len, seq, ord) in CIGARs: in the order of ord, each joins the first group whose first member lies within 5 bases and whose length is within a tenth; a group has its first member's place and length, and the first bases that any member carries. Insertions further apart than that never meet, so each run of neighbours is a group of work of its own."""
    import pyarrow as pa

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.select(["pos", "len", "seq", "ord"]).to_pylist(), key=lambda r: r["ord"])
        groups: list[dict] = []
        by_pos: dict[int, list[dict]] = {}
        for r in rows:
            near = [g for p in range(r["pos"] - GROUP_APART, r["pos"] + GROUP_APART + 1) for g in by_pos.get(p, ())]
            fits = [g for g in near if abs(g["len"] - r["len"]) <= GROUP_LENGTH * g["len"]]
            if fits:
                g = min(fits, key=lambda g: g["k"])
                g["reads"] += 1
                g["seq"] = g["seq"] or r["seq"]
            else:
                g = {"pos": r["pos"], "len": r["len"], "seq": r["seq"], "reads": 1, "k": len(groups)}
                groups.append(g)
                by_pos.setdefault(r["pos"], []).append(g)
        made = {c: pa.array([g[c] for g in groups], k) for c, k in (("pos", pa.int32()), ("len", pa.int32()), ("seq", pa.string()), ("reads", pa.int64()))}
        return pa.table({on: pa.array([t.column(on)[0].as_py()] * len(groups), pa.string()), **made})

    rows = islands(insertions.select(on, "pos", "len", "seq", "ord"), [on], "pos", GROUP_APART + 1)
    return dealt(rows, on, "_island").groupBy(on, "_island").applyInArrow(run, f"{on} string, pos int, len int, seq string, reads long")


def tandem_copies(groups: DataFrame, tiles: DataFrame, on: str, width: int) -> DataFrame:
    """groups (on, pos, len, seq, reads) with s and e of the tandem copy, null where the inserted bases are none: the stretch before the place ends as the insertion does, or the one after it begins as it does, by probes of 24 bases within 60 of where they should lie; the copy's far end must be there too, where the reference reaches it, else the length says where it is."""
    # asked for three times below, and made by a walk over insertions
    g = store(groups.withColumn("_g", F.xxhash64(on, "pos", "len", "seq")), "insertion-groups")
    head, tail = F.upper(F.substring("seq", 1, PROBE)), F.upper(F.right("seq", F.lit(PROBE)))
    pos, n = F.col("pos").cast("long"), F.col("len").cast("long")
    ask = lambda what, at, probe: F.struct(F.lit(what).alias("what"), at.alias("want"), probe.alias("probe"))
    probes = F.array(ask("in_before", pos - PROBE, tail), ask("far_before", pos - n, head), ask("in_after", pos, head), ask("far_after", pos + n - PROBE, tail))
    asked = g.where(F.length("seq") >= 2 * PROBE).select("_g", on, F.inline(probes)).withColumn("id", F.xxhash64("_g", "what"))
    # the stretch in which a probe may begin, cut at the reference's ends
    reach = tiles.groupBy(on).agg((F.max("tile") * width + F.max_by(F.length("seq"), "tile")).alias("_end"))
    asked = asked.join(reach, on).withColumns({"at": F.greatest(F.lit(0), F.col("want") - PROBE_SLACK)})
    asked = asked.withColumn("n", F.least(F.col("want") + PROBE_SLACK + PROBE, F.col("_end")) - F.col("at"))
    text = slices(asked, tiles, on, width)
    spot = asked.join(text, "id").withColumn("_i", F.expr("locate(probe, upper(bases))"))
    hits = spot.where("_i > 0").select("_g", "what", (F.col("at") + F.col("_i") - 1).alias("hit"))
    inside = asked.select("_g", "what", ((F.col("want") - PROBE_SLACK >= 0) & (F.col("want") + PROBE + PROBE_SLACK <= F.col("_end"))).alias("ok"))
    of = lambda what, c: F.max(F.when(F.col("what") == what, F.col(c)))
    sides = ("in_before", "far_before", "in_after", "far_after")
    h = hits.groupBy("_g").agg(*[of(w, "hit").alias(w) for w in sides]).join(inside.groupBy("_g").agg(*[of(w, "ok").alias(f"_ok_{w}") for w in sides]), "_g")
    good = lambda side: F.col(f"in_{side}").isNotNull() & (~F.col(f"_ok_far_{side}") | F.col(f"far_{side}").isNotNull())
    far = lambda side: F.when(F.col(f"_ok_far_{side}"), F.col(f"far_{side}"))
    j = g.join(h, "_g", "left")
    s = F.when(good("before"), F.coalesce(far("before"), F.col("in_before") + PROBE - n)).when(good("after"), F.col("in_after"))
    e = F.when(good("before"), F.col("in_before") + PROBE).when(good("after"), F.coalesce(far("after") + PROBE, F.col("in_after") + n))
    return j.select(on, "pos", "len", "seq", "reads", s.alias("s"), e.alias("e"))
