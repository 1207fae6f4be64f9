"""N-gram Jaccard join: near-duplicate documents as connected components of all links.

Links between different sets are found by the prefix-filtering join of set_join. Within a shared shingle's list, each
node is first compared with one leader of the list, the node nearest to what the list has in common: a number of pairs in
proportion to the postings, however large a group of near copies is. Components are joined, and lists within one
component drop out. Then every pair of a list whose members lie in different components and that passes the filters is
compared. So no link is lost between components, and no group that its leaders hold together is expanded into all its
pairs.

Defined results: null text, empty text or text without words has an empty set, no links, and itself as component; a text
of fewer words than a shingle is one shingle; repeated rows of one doc_id give a row each; a null doc_id is never linked;
other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidespan.llm import set_join
from tidespan.llm.graph import components
from tidespan.llm.set_join import Sets
from tidespan.session import discard, store


#: Live shingles of a node by which it meets leaders; what they miss is found by the comparison of all pairs.
PROBES = 8


def leader_rows(shared: DataFrame) -> DataFrame:
    """Postings with the one of their list whose prefix holds the least shingles of its own, as (x, nx, px, lx, y, ny, py, ly)."""
    # one number to order by, so that aggregates stay of fixed size; of equals, any
    key = (F.least(F.col("pos") - F.col("rank"), F.lit(1 << 22)).cast("long") * F.lit(1 << 40)) + F.shiftrightunsigned(F.xxhash64("node"), 24)
    heads = shared.withColumn("_key", key).groupBy("h").agg(*[F.min_by(c, "_key").alias(n) for c, n in (("node", "y"), ("size", "ny"), ("pos", "py"), ("rank", "ly"))])
    return set_join.side(shared.where(F.col("rank") < PROBES), "x").join(heads, "h").where("x <> y")


def open_rows(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Every pair of a list whose components differ, once for lists that follow one another in both prefixes."""
    marked = shared.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    marked = store(marked.select("h", "node", "size", "pos", "rank", "prev", "component"), "marked-postings")
    several = marked.groupBy("h").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a <> _b").select("h")
    left = marked.join(several, "h", "left_semi")
    x = set_join.side(left, "x", F.col("component").alias("cx"), F.col("prev").alias("vx"))
    y = set_join.side(left, "y", F.col("component").alias("cy"), F.col("prev").alias("vy"))
    out = x.join(y, "h").where("x < y and cx <> cy and not (vx = vy and vx <> 0)")
    out._stored_at = marked._stored_at
    return out


def linked(docs: DataFrame, units: DataFrame, sets: Sets) -> DataFrame:
    """(node, component) over all links, written."""
    live = set_join.live_postings(units, sets)
    shared = store(live.groupBy("h", "node", "size", "pos", "rank", "prev").agg(F.min("place").alias("place"), F.min("check").alias("check")), "postings")
    # every node of a list has one posting of rank 0
    one = shared.where("rank = 0").select("node", "check", "place")
    pair = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    tried = store(leader_rows(shared).where(set_join.fits(sets)).select(*pair).distinct(), "pairs")
    links = set_join.verified(docs, sets, tried, one)
    labels = components(links)
    rows = open_rows(shared, labels)
    rest = store(rows.where(set_join.fits(sets)).select(*pair).distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    more = set_join.verified(docs, sets, rest, one)
    if not more.isEmpty():
        discard(labels)
        labels = components(links.union(more))
    for df in (shared, tried, links, rows, rest, more):
        discard(df)
    return labels


def similar_documents(docs: DataFrame, sets: Sets, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row, written."""
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    cut = set_join.cut_units(docs, sets)
    units, nodes = set_join.named_nodes(cut, F.min("doc_id").alias("first"))
    labels = linked(docs, units, sets)
    # from nodes to documents: a component's least document
    named = nodes.select("node", "first").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_node = store(named.join(least, "component").select("node", "component_id"), "components")
    own = F.when((F.col("size") > 0) & F.col("doc_id").isNotNull(), F.col("component_id"))
    out = units.join(by_node, "node", "left").select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.coalesce(own, F.col("doc_id")).alias("component_id"))
    out = store(out, "similar")
    for df in (cut, nodes, labels, by_node):
        discard(df)
    return out


#: The pipeline's and the library's near duplicates: five words, 0.8.
NEAR = Sets(unit="document", words=5, num=80, den=100)


def one_of_each(docs: DataFrame, sets: Sets = NEAR) -> DataFrame:
    """docs without the documents whose component has a smaller doc_id."""
    found = similar_documents(docs, sets)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def op5_ngram_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return similar_documents(docs, Sets(unit="document", words=4, num=85, den=100))


ORACLE_OP5 = """
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws
  from documents
), s as (
  select doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) end) as g
  from w
), n as (select doc_id, count(*) as n from s group by doc_id),
hot as (select g from s group by g having count(*) > 1),
h as (select s.doc_id, hash(s.g) as g from s join hot on hot.g = s.g),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from h a join h b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
both_ways as (select x, y from e union select y, x from e),
r as (select doc_id as x, doc_id as y from w union select r.x, b.y from r join both_ways b on r.y = b.x)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, (select min(y) from r where r.x = w.doc_id) as component_id
from w left join n on n.doc_id = w.doc_id
"""
