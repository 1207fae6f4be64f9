"""Line deduplication by an exact set-similarity join over all lines of all documents.

A line's tokens are its word shingles (five words; a line of fewer words is one shingle, so that it matches its copies
alone), ordered by rarity. A line goes where an earlier line, by doc_id and line number, has Jaccard similarity of at
least the threshold; a line without words stays. Whether the earlier line itself goes makes no difference, so the result
does not depend on any order of work. Equal token sets are one node, of which the first line stays. Of a shared shingle's
list, each node is first compared with the list's earliest node and with the earliest of those before it that are nearest
to what the list has in common; only nodes still without an earlier match are then compared with every earlier node of
their lists.

Defined results: null text stays null and empty text empty; rows that share a doc_id are one document (a line goes from
each of them or from none); a null doc_id keeps its lines; line feeds go with the lines they end; other columns pass
through, whatever their names; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidespan.llm import set_join
from tidespan.llm.set_join import Sets
from tidespan.session import discard, store

LINES = Sets(unit="line", words=5, num=80, den=100, least=1, ranges=0)

#: Classes of nodes in a list by the share of their prefix before the shared shingle that no other prefix holds.
CLASSES = 16
#: Live shingles of a node by which it meets leaders; what they miss is found by the comparison of all pairs.
PROBES = 3


def leader_rows(shared: DataFrame, sets: Sets) -> DataFrame:
    """Postings with at most two earlier ones of their list, as (x, nx, px, lx, y, ny, py, ly): the earliest, and the earliest of the nearest class."""
    own = F.col("size") - F.ceil(F.col("size") * sets.num / sets.den) + 1
    kind = F.floor(CLASSES * (F.col("pos") - F.col("rank")) / own).cast("decimal(2,0)")
    # class and place in one number, and min_by of numbers: aggregates of fixed width are hashed and not sorted
    marked = shared.withColumn("_key", (kind * F.expr(f"{10**33}BD") + F.col("place")).cast("decimal(38,0)"))
    parts = [("place", "f"), ("node", "y"), ("size", "ny"), ("pos", "py"), ("rank", "ly")]
    heads = marked.groupBy("h").agg(*[F.min_by(c, by).alias(f"{n}{k}") for k, by in enumerate(("place", "_key")) for c, n in parts])
    both = F.array_distinct(F.array(*[F.struct(*[F.col(f"{n}{k}").alias(n) for _, n in parts]) for k in (0, 1)]))
    rows = set_join.side(shared.where(F.col("rank") < PROBES), "x", F.col("place").alias("fx")).join(heads, "h").where("f0 < fx")
    return rows.select("x", "nx", "px", "lx", "fx", F.inline(both)).where("f < fx")


def later_nodes(docs: DataFrame, units: DataFrame, sets: Sets) -> tuple[DataFrame, list[DataFrame]]:
    """The nodes that match an earlier node, and the written tables they are read from."""
    live = set_join.live_postings(units, sets)
    shared = store(live.groupBy("h", "node", "size", "pos", "rank", "prev").agg(F.min("place").alias("place"), F.min("check").alias("check")), "postings")
    # every node of a list has one posting of rank 0
    one = shared.where("rank = 0").select("node", "check", "place")
    pair = [F.col("x").alias("a"), F.col("y").alias("b")]
    tried = store(leader_rows(shared, sets).where(set_join.fits(sets)).select(*pair).distinct(), "pairs")
    links = set_join.verified(docs, sets, tried, one)
    gone = links.select(F.col("a").alias("node")).distinct()
    # what has no earlier match so far, with all that is earlier; where both prefixes have the same live shingle just before, the pair has met there
    x = set_join.side(shared.join(gone, "node", "left_anti"), "x", F.col("place").alias("fx"), F.col("prev").alias("vx"))
    y = set_join.side(shared, "y", F.col("place").alias("fy"), F.col("prev").alias("vy"))
    met = (F.col("vx") == F.col("vy")) & (F.col("vx") != 0)
    rows = x.join(y, "h").where((F.col("fy") < F.col("fx")) & ~met & set_join.fits(sets))
    rest = store(rows.select(*pair).distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    more = set_join.verified(docs, sets, rest, one)
    for df in (shared, tried, rest):
        discard(df)
    return links.union(more).select(F.col("a").alias("node")).distinct(), [links, more]


def later_lines(docs: DataFrame, sets: Sets = LINES) -> DataFrame:
    """(doc_id, number) of every line that goes, written; some may come twice."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    cut = set_join.cut_units(docs, sets)
    units, nodes = set_join.named_nodes(cut, F.count(F.lit(1)).alias("copies"))
    gone, read = later_nodes(docs, units, sets)
    # all lines of nodes that go, and all but the first of those that stay
    whole = gone.withColumn("_all", F.lit(True))
    special = nodes.where("copies > 1").select("node").join(whole, "node", "full").select("node", F.coalesce("_all", F.lit(False)).alias("_all"))
    lines = store(units.select("node", "doc_id", "number").join(special, "node"), "special-lines")
    place = F.struct("doc_id", "number")
    first = lines.where("not _all").groupBy("node").agg(F.min(place).alias("_first"))
    later = lines.where("not _all").join(first, "node").where(place != F.col("_first"))
    out = store(later.select("doc_id", "number").union(lines.where("_all").select("doc_id", "number")), "later-lines")
    for df in (cut, nodes, lines, *read):
        discard(df)
    return out


def without_later_lines(docs: DataFrame, sets: Sets = LINES) -> DataFrame:
    """docs with text rewritten; n_chars, where there is such a column, follows the text. Adds n_removed."""
    by_doc = later_lines(docs, sets).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("number").alias("_gone"))
    own = [f"_own_{i}" for i in range(len(docs.columns))]
    names = list(docs.columns)
    key, body = own[names.index("doc_id")], own[names.index("text")]
    # the texts need no order: what goes is a few numbers a document, held by hash
    df = docs.toDF(*own).join(by_doc.hint("shuffle_hash"), F.col(key).cast("long") == F.col("_id"), "left")
    # a column of its own that is read twice stays one: inlined in the lambda, texts would be split again for each line
    df = df.withColumn("_lines", F.when(F.col("_gone").isNotNull(), F.split(F.col(body), "\n")))
    # lines that stay, by position: array_except hashes, so that long documents take one step a line
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.transform("_gone", lambda i: i.cast("int")))
    df = df.withColumn("_stay", F.when(F.col("_gone").isNotNull(), stay))
    kept = F.array_join(F.transform("_stay", lambda i: F.get(F.col("_lines"), i)), "\n")
    df = df.withColumn("_new", F.when(F.col("_gone").isNull(), F.col(body)).otherwise(kept))
    columns = [
        F.col("_new").alias(c) if n == body else F.when(F.col("_gone").isNull(), F.col(n)).otherwise(F.length("_new").cast(docs.schema[c].dataType)).alias(c) if c == "n_chars" else F.col(n).alias(c)
        for n, c in zip(own, names, strict=True)
        if c != "n_removed"
    ]
    return df.select(*columns, F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_later_lines(docs)


ORACLE_OP3 = """
with l as (
  select doc_id, unnest(range(len(x))) as number, unnest(x) as line from (select doc_id, string_split(text, chr(10)) as x from documents where text is not null)
), w as (
  select doc_id, number, list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from l
), s as (
  select doc_id, number, unnest(case when len(ws) < 5 then [array_to_string(ws, ' ')] else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end) as g from w where len(ws) >= 1
), c as (select doc_id, number, count(*) as n from s group by doc_id, number), n as (select *, row_number() over (order by doc_id, number) as k from c),
h as (select n.k, hash(g) as g from s join n using (doc_id, number) where g in (select g from s group by g having count(*) > 1)),
p as (select a.k as x, b.k as y, count(*) as c from h a join h b on a.g = b.g and a.k > b.k group by all),
gone as (select distinct x as k from p join n a on a.k = x join n b on b.k = y where 100 * c >= 80 * (a.n + b.n - c)),
marked as (select l.doc_id, l.number, l.line, gone.k is not null as goes from l left join n on n.doc_id = l.doc_id and n.number = l.number left join gone on gone.k = n.k),
kept as (select doc_id, coalesce(string_agg(line, chr(10) order by number) filter (where not goes), '') as text, count(*) filter (where goes) as n_removed from marked group by doc_id)
select d.doc_id, k.text, coalesce(k.n_removed, 0) as n_removed from documents d left join kept k on k.doc_id = d.doc_id
"""
