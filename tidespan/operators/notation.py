"""Rearrangements as people type them: a grammar over columns, the pieces and junctions that a description means, and its sequence form.

A description is read into the pieces of the rearranged chromosome, from one end to the other, by column expressions alone.
What cannot be read has an error and no pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidespan.session import dealt

#: The grammar: a position may be uncertain (its middle counts), a range may name the centromere, which says nothing.
POSITION = r"(?:\d+|pter|qter|\((?:\d+|\?)_(?:\d+|\?)\))"
RANGE = rf"{POSITION}(?:_(?:cen_)?{POSITION})?"
CONTENT = r"(?:\[(?:[^\[\]]|\[\d+\])*\]|(?:[^;\[\]]|\[\d+\])*)"
CHANGE = rf"({RANGE})(delins|del|dup|inv|ins)({CONTENT})"
REFERENCE = r"(?:NC_\d+(?:\.\d+)?|(?:chr)?(?:\d{1,2}|[XYM]))"
ALLELE = rf"^{REFERENCE}:g\.(?:\[{CHANGE}(?:;{CHANGE})*\]|{CHANGE})$"
PART = rf"^(?:der\(\w+\))?({REFERENCE}):g\.({RANGE})(inv)?$"
ITEM = rf"^(?:({REFERENCE}):g\.)?({RANGE})(inv)?$"
WRITTEN = r"^(?:[ACGTN]+|N\[\d+\])$"
#: Prefixes that other forms put before a description, and the microarray form of one stretch.
KARYOTYPE = r"(?i)^(?:del|dup|inv|ins|der|t)\([^)]*\)\([^)]*\)\s+(\S+:g\..+)$"
BUILD = r"(?i)^seq\[[^\]]*\]\s*"
ARRAY = r"^(\d{1,2}|X|Y)[pq][\d.]+(?:[pq][\d.]+)?\(([\d,]+)_([\d,]+)\)[×x](\d+)$"

PIECES = "array<struct<chrom:string,s:bigint,e:bigint,reversed:boolean>>"


def normal(text: Column) -> Column:
    """The description without what stands around it; one stretch of the microarray form as a deletion (fewer than two copies) or a duplication, and nothing at two."""
    t = F.regexp_replace(F.trim(text), BUILD, "")
    inner = F.regexp_extract(t, KARYOTYPE, 1)
    solid = F.regexp_replace(F.when(inner != "", inner).otherwise(t), r"\s+", "")
    copies = F.regexp_extract(solid, ARRAY, 4)
    plain = lambda k: F.regexp_replace(F.regexp_extract(solid, ARRAY, k), ",", "")
    change = F.concat(F.lit("chr"), plain(1), F.lit(":g."), plain(2), F.lit("_"), plain(3), F.when(copies.try_cast("int") < 2, "del").otherwise("dup"))
    return F.when(copies == "", F.regexp_replace(solid, ",", "")).when(copies.try_cast("int") == 2, "").otherwise(change)


def chromosome_of(reference: Column) -> Column:
    """chr1 to chrY of a chromosome's name or accession."""
    number = F.regexp_extract(reference, r"^NC_0*(\d+)", 1)
    by_accession = F.when(number == "23", "X").when(number == "24", "Y").when(number != "", number)
    return F.concat(F.lit("chr"), F.coalesce(by_accession, F.regexp_replace(reference, "^chr", "")))


def place(text: Column, length: Column) -> Column:
    """The number of a position: the chromosome's ends, the middle of an uncertain one or the side of it that is known; null where neither is."""
    low, high = (F.regexp_extract(text, r"^\((\d+|\?)_(\d+|\?)\)$", k).try_cast("double") for k in (1, 2))
    uncertain = F.coalesce(F.floor((low + high) / 2 + 0.5).cast("long"), low.cast("long"), high.cast("long"))
    return F.when(text == "pter", F.lit(0).cast("long")).when(text == "qter", length).when(text.startswith("("), uncertain).otherwise(text.try_cast("long"))


def span(text: Column, length: Column) -> Column:
    """struct(s, e) of a range, from 0 and half-open; one position is its own end, and pter stands before the first base."""
    first, last = F.regexp_extract(text, f"^({POSITION})", 1), F.regexp_extract(text, f"({POSITION})$", 1)
    return F.struct((place(first, length) - F.when(first == "pter", 0).otherwise(1)).alias("s"), place(last, length).alias("e"))


def piece(text: Column, pattern: str, own: Column, lengths: Column) -> Column:
    """The piece that a part or an inserted item names, on its own chromosome if it names none."""
    named = F.regexp_extract(text, pattern, 1)
    chrom = F.when(named != "", chromosome_of(named)).otherwise(own)
    at = span(F.regexp_extract(text, pattern, 2), F.try_element_at(lengths, chrom))
    return F.struct(chrom.alias("chrom"), at["s"].alias("s"), at["e"].alias("e"), (F.regexp_extract(text, pattern, 3) != "").alias("reversed"))


def changes(body: Column, chrom: Column, lengths: Column) -> Column:
    """Array of (s, e, kind, bare, readable, content) of an allele list, by position. bare: whether nothing is written after the kind."""
    each = F.regexp_extract_all(body, F.lit(CHANGE), F.lit(0))
    field = lambda x, k: F.regexp_extract(x, f"^{CHANGE}$", k)

    def one(x: Column) -> Column:
        at, what = span(field(x, 1), F.try_element_at(lengths, chrom)), field(x, 3)
        inside = F.when(what.startswith("["), F.substring(what, F.lit(2), F.length(what) - 2)).otherwise(what)
        items = F.filter(F.split(inside, ";"), lambda i: (i != "") & ~i.rlike(WRITTEN))
        content = F.transform(items, lambda i: piece(i, ITEM, chrom, lengths))
        return F.struct(at["s"].alias("s"), at["e"].alias("e"), field(x, 2).alias("kind"), (what == "").alias("bare"), F.forall(items, lambda i: i.rlike(ITEM)).alias("readable"), content.cast(PIECES).alias("content"))

    return F.array_sort(F.transform(each, one))


def applied(ops: Column, chrom: Column, length: Column) -> Column:
    """struct(clash, pieces): the chromosome after its changes, each stretch of it taken once; clash where they overlap."""
    none = F.array().cast(PIECES)
    ref = lambda s, e, turn=False: F.when(e > s, F.array(F.struct(chrom.alias("chrom"), s.alias("s"), e.alias("e"), F.lit(turn).alias("reversed"))).cast(PIECES)).otherwise(none)
    state = lambda at, clash, pieces: F.struct(at.cast("long").alias("at"), clash.alias("clash"), pieces.alias("pieces"))

    def step(a: Column, o: Column) -> Column:
        to = F.when(o["kind"] == "ins", o["s"] + 1).otherwise(o["s"])
        new = (
            F.when(o["kind"].isin("ins", "delins"), o["content"])
            .when(o["kind"] == "inv", ref(o["s"], o["e"], True))
            .when(o["kind"] == "dup", F.concat(ref(o["s"], o["e"]), ref(o["s"], o["e"])))
            .otherwise(none)
        )
        return state(F.when(o["kind"] == "ins", to).otherwise(o["e"]), a["clash"] | F.coalesce(o["s"] < a["at"], F.lit(True)), F.concat(a["pieces"], ref(a["at"], to), new))

    done = F.aggregate(ops, state(F.lit(0), F.lit(False), none), step)
    return F.struct(done["clash"].alias("clash"), F.concat(done["pieces"], ref(done["at"], length)).alias("pieces"))


def worked_out(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once: a row generator stands between them and what uses them, so that their expressions are not written out in every place."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def parsed(texts: DataFrame, lengths: dict[str, int]) -> DataFrame:
    """texts (id, text) with pieces and error: null, or unreadable, unknown_chromosome, unknown_position, missing_insertion or overlap. lengths: of the chromosomes of a build."""
    lens = F.create_map(*[F.lit(x) for c, n in lengths.items() for x in (c, int(n))]).cast("map<string,bigint>")
    x = worked_out(dealt(texts.select("id", "text"), "id", "text"), _t=normal(F.col("text")))
    # a list's closing bracket is not its last content's
    body = F.when(F.col("_t").rlike(rf"^{REFERENCE}:g\.\["), F.regexp_extract("_t", rf"^{REFERENCE}:g\.\[(.*)\]$", 1)).otherwise(F.regexp_extract("_t", rf"^{REFERENCE}:g\.(.*)$", 1))
    chrom = chromosome_of(F.regexp_extract("_t", rf"^(?:der\(\w+\))?({REFERENCE}):g\.", 1))
    x = worked_out(x, _parts=F.split("_t", "::"), _chrom=chrom, _body=body, _list=F.coalesce(F.col("_t").rlike(ALLELE), F.lit(False)))
    in_parts = (F.size("_parts") > 1) & F.forall("_parts", lambda p: p.rlike(PART))
    x = worked_out(x, _seq=F.coalesce(in_parts, F.lit(False)), _ops=F.when(F.col("_list"), changes(F.col("_body"), F.col("_chrom"), lens)), _length=F.try_element_at(lens, F.col("_chrom")))
    x = worked_out(x, _done=F.when(F.col("_list"), applied(F.col("_ops"), F.col("_chrom"), F.col("_length"))))
    x = worked_out(x, pieces=F.when(F.col("_seq"), F.transform("_parts", lambda p: piece(p, PART, F.col("_chrom"), lens))).otherwise(F.col("_done.pieces")).cast(PIECES))
    needs = lambda o: o["kind"].isin("ins", "delins")
    error = (
        F.when(~(F.col("_list") | F.col("_seq")) | F.exists("_ops", lambda o: ~o["readable"] | (~needs(o) & ~o["bare"])), "unreadable")
        .when(F.col("_length").isNull() | F.exists("pieces", lambda p: F.try_element_at(lens, p["chrom"]).isNull()), "unknown_chromosome")
        .when(F.exists("_ops", lambda o: needs(o) & o["bare"]), "missing_insertion")
        .when(F.exists("_ops", lambda o: o["s"].isNull() | o["e"].isNull()) | F.exists("pieces", lambda p: p["s"].isNull() | p["e"].isNull()), "unknown_position")
        .when(F.col("_done.clash"), "overlap")
    )
    x = worked_out(x, error=error)
    return worked_out(x.withColumnRenamed("pieces", "_pieces"), pieces=F.when(F.col("error").isNull(), F.col("_pieces"))).select("id", "text", "pieces", "error")


def typed_junctions(descriptions: DataFrame) -> DataFrame:
    """(id, junction, kind, a_chrom, a_pos, a_side, b_chrom, b_pos, b_side) of parsed descriptions: where pieces follow each other that do not on the reference. A tail is left at its end, a head entered at its start."""
    at = F.sequence(F.lit(1), F.size("pieces") - 1)
    x = descriptions.where("size(pieces) > 1").select("id", F.posexplode(F.transform(at, lambda k: F.struct(F.get("pieces", k - 1).alias("p"), F.get("pieces", k).alias("q")))).alias("_k", "x"))
    p, q = F.col("x.p"), F.col("x.q")
    goes_on = (p["chrom"] == q["chrom"]) & (p["reversed"] == q["reversed"]) & F.when(p["reversed"], q["e"] == p["s"]).otherwise(p["e"] == q["s"])
    out = x.where(~goes_on).select(
        "id", "_k", p["chrom"].alias("a_chrom"), F.when(p["reversed"], p["s"]).otherwise(p["e"]).alias("a_pos"), F.when(p["reversed"], "head").otherwise("tail").alias("a_side"),
        q["chrom"].alias("b_chrom"), F.when(q["reversed"], q["e"]).otherwise(q["s"]).alias("b_pos"), F.when(q["reversed"], "tail").otherwise("head").alias("b_side"),
    )
    ahead = F.when(F.col("a_side") == "tail", F.col("b_pos") > F.col("a_pos")).otherwise(F.col("a_pos") > F.col("b_pos"))
    kind = F.when(F.col("a_chrom") != F.col("b_chrom"), "translocation").when(F.col("a_side") == F.col("b_side"), "inversion").when(ahead, "deletion").otherwise("duplication")
    number = F.row_number().over(Window.partitionBy("id").orderBy("_k"))
    return out.select("id", number.alias("junction"), kind.alias("kind"), "a_chrom", "a_pos", "a_side", "b_chrom", "b_pos", "b_side")


def sequence_form(pieces: Column) -> Column:
    """The sequence form of pieces: chr:g.from_to, inv where reversed, joined by ::."""
    one = lambda p: F.concat(p["chrom"], F.lit(":g."), (p["s"] + 1).cast("string"), F.lit("_"), p["e"].cast("string"), F.when(p["reversed"], "inv").otherwise(""))
    return F.array_join(F.transform(pieces, one), "::")



def transcript_models(exons: DataFrame, cds: DataFrame) -> DataFrame:
    """(tx, plus, exons, _from, _to) of exons (tx, plus, xs, xe) and coding parts (tx, cs, ce): exons as (first, last, t) in the order of transcription, by places that grow along it (on the minus strand a position counts as minus itself less one), t being the transcript's place of the first base; and the transcript's places of the first and last coding base, those of the whole without a coding part."""
    at = lambda p, q: F.when(F.col("plus"), p).otherwise(q)
    x = exons.select("tx", "plus", at(F.col("xs"), -F.col("xe")).alias("first"), at(F.col("xe") - 1, -F.col("xs") - 1).alias("last"))
    w = Window.partitionBy("tx").orderBy("first")
    n = F.col("last") - F.col("first") + 1
    x = x.withColumn("t", F.sum(n).over(w) - n)
    c = cds.select("tx", "cs", "ce")
    x = x.join(c, "tx", "left").withColumns({"_a": at(F.col("cs"), -F.col("ce")), "_z": at(F.col("ce") - 1, -F.col("cs") - 1)})
    place = lambda p: F.max(F.when(F.col(p).between(F.col("first"), F.col("last")), F.col("t") + F.col(p) - F.col("first")))
    return x.groupBy("tx", "plus").agg(F.array_sort(F.collect_list(F.struct("first", "last", "t"))).alias("exons"), F.coalesce(place("_a"), F.lit(0)).alias("_from"), F.coalesce(place("_z"), F.max(F.col("t") + F.col("last") - F.col("first"))).alias("_to"))


def junction_notation(junctions: DataFrame, exons: DataFrame, cds: DataFrame) -> DataFrame:
    """(id, tx, effect) of junctions (id, tx, s, e) against a transcript: r.(=) for a canonical one; bases of whole exons or of an end of one that are lost, as a deletion; bases of an intron that stay, as an insertion between the exons' bases, counted from the nearer one. Others, and cryptic exons' flanks, have no effect of their own: null. Exon bases are numbered from the start codon, those before it by minus, those behind the stop by a star."""
    j = junctions.join(transcript_models(exons, cds), "tx")
    donor = F.when(F.col("plus"), F.col("s") - 1).otherwise(-F.col("e") - 1)
    acceptor = F.when(F.col("plus"), F.col("e")).otherwise(-F.col("s"))
    j = worked_out(j.select("id", "tx", "exons", "_from", "_to", donor.alias("_d"), acceptor.alias("_a")), _di=F.array_position(F.transform("exons", lambda x: x["last"]), F.col("_d")).cast("int"), _ai=F.array_position(F.transform("exons", lambda x: x["first"]), F.col("_a")).cast("int"))
    # exons before and behind, by places from 1; 0 is none
    exon = lambda k: F.get("exons", k - 1)
    j = worked_out(j, _up=F.when(F.col("_ai") > 1, exon(F.col("_ai") - 1)), _down=F.when(F.col("_di") > 0, exon(F.col("_di") + 1)), _own=exon(F.col("_di")), _next=exon(F.col("_ai")), _skip1=exon(F.col("_di") + 1), _skip2=exon(F.col("_ai") - 1))

    def number(x: Column, at: Column) -> Column:
        t = x["t"] + at - x["first"]
        return F.when(t < F.col("_from"), F.concat(F.lit("-"), (F.col("_from") - t).cast("string"))).when(t > F.col("_to"), F.concat(F.lit("*"), (t - F.col("_to")).cast("string"))).otherwise((t - F.col("_from") + 1).cast("string"))

    first, last = (lambda x: number(x, x["first"])), (lambda x: number(x, x["last"]))
    lost = lambda a, b: F.concat(F.lit("r."), a, F.lit("_"), b, F.lit("del"))
    kept = lambda a, b, what: F.concat(F.lit("r."), a, F.lit("_"), b, F.lit("ins"), what)
    d, a, di, ai, up, down = (F.col(c) for c in ("_d", "_a", "_di", "_ai", "_up", "_down"))
    both, text = (di > 0) & (ai > 0), lambda n: n.cast("string")
    effect = (
        F.when(both & (ai == di + 1), "r.(=)")
        .when(both & (ai > di + 1), lost(first(F.col("_skip1")), last(F.col("_skip2"))))
        .when(~both & (ai > 0) & (d >= up["first"]) & (d < up["last"]), lost(number(up, d + 1), last(up)))
        .when(~both & (ai > 0) & (d > up["last"]) & (d < a), kept(last(up), first(F.col("_next")), F.concat(last(up), F.lit("+1_"), last(up), F.lit("+"), text(d - up["last"]))))
        .when(~both & (di > 0) & (a > down["first"]) & (a <= down["last"]), lost(first(down), number(down, a - 1)))
        .when(~both & (di > 0) & (a < down["first"]) & (a > d), kept(last(F.col("_own")), first(down), F.concat(first(down), F.lit("-"), text(down["first"] - a), F.lit("_"), first(down), F.lit("-1"))))
    )
    return j.select("id", "tx", effect.alias("effect"))
