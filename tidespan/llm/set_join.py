"""Exact set-similarity join of texts by prefix filtering, rarest shingles first.

Units are whole documents or their lines; a unit's set holds its distinct word shingles, as 64-bit hashes; a unit of fewer
words than a shingle is one shingle, its whole sequence. Two units match when den * |intersection| >= num * |union|. Units
with equal sets are one node, so copies cost one comparison.

1. rarity: shingles of the whole corpus in a fixed number of counters. The order "rarer counter first, then hash" is the
   same total order for every unit, which is all that exactness needs.
2. units: every unit's size and node, and its prefix (size - ceil(t * size) + 1 shingles in that order) packed in one value;
   matching units share a prefix shingle.
3. live shingles: those in the prefixes of two nodes. Tasks send at most the least and greatest node of a shingle for each
   slice of text, so that a shingle of a third of all rows stays small; the answer is a bitmap of fixed size, which only
   spares postings that join with nothing (a set bit too many costs a row, never a result).
4. postings: one row a live prefix shingle, with its position, how many live ones stand before it, and the one just before.
5. the callers compare each node of a list (the postings of one shingle) with one or two leaders of the list, and then all
   pairs that are still open. Leaders are the nodes with the least shingles that no other prefix holds: in a group of
   near copies those are nearest to what was copied, so that what they don't match hardly matches anything.
6. verification, once a pair: sets are built again for candidate units alone; the suffix filter compares how the sets fall
   into ranges of hashes before they are intersected.

Nodes are 64-bit hashes with a second one beside them; where two different sets meet in the first, both get another. Nothing
of the corpus is collected but the counters and the bitmaps, all of fixed size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidespan.llm.arrow_text import ByteHash, blobs, bytes_of, gathered, mixed, slices, starts_of, texts_of, unblobbed
from tidespan.session import discard, settings, store

COUNTERS = 1 << 20
CHUNKS = 256
TASKS_TOGETHER = 256
BITMAP_BITS = 27
SLICE = 2 << 20
#: Odd factors of the words of a shingle.
FACTORS = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)

Wanted = Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Sets:
    """What is compared: unit "document" or "line", shingles of `words` words, matches from num/den on. Units of fewer than least words have no set.

    ranges: of hashes that the suffix filter counts, a power of two; 0 where sets are small, which are compared at once.
    node_bits: of the hash that names a set.
    """

    unit: str = "document"
    words: int = 5
    num: int = 80
    den: int = 100
    least: int = 1
    ranges: int = 256
    node_bits: int = 64

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - -(-n * self.num // self.den) + 1


@dataclass
class Units:
    """Of a slice: row and number of each unit, its size, and its distinct shingles in order, one unit after another."""

    row: np.ndarray
    number: np.ndarray
    size: np.ndarray
    shingles: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.size)), self.size)

    def node(self, salt: int, bits: int = 64) -> np.ndarray:
        """A hash of each set, whatever the order of its members; 0 for empty sets."""
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(self.shingles ^ np.uint64(salt)), dtype=np.uint64)])
        ends = starts_of(self.size)
        h = mixed((total[ends[1:]] - total[ends[:-1]]) ^ self.size.astype(np.uint64))
        return np.where(self.size > 0, h >> np.uint64(64 - bits), np.uint64(0)).astype(np.int64)


_HASH: list[ByteHash] = []


def shingled(texts: pa.Array, sets: Sets, wanted: Wanted | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and number of each unit; owner and hash of each of its shingles, repeats and all. wanted: which units, by row and number."""
    if not _HASH:
        _HASH.append(ByteHash())
    data, bounds = bytes_of(texts)
    row, number = np.arange(len(texts)), np.zeros(len(texts), np.int64)
    if sets.unit == "line":
        feeds = np.flatnonzero(data == 10)
        lines = 1 + np.diff(np.searchsorted(feeds, bounds))
        # a line begins where its text does or after a line feed; lines and texts of no bytes begin where the next does
        bounds = np.append(np.sort(np.concatenate([bounds[:-1], feeds + 1]), kind="stable"), bounds[-1])
        row = np.repeat(row, lines)
        number = np.arange(len(row)) - np.repeat(starts_of(lines)[:-1], lines)
    if wanted is not None:
        take = np.flatnonzero(wanted(row, number))
        row, number = row[take], number[take]
        each = (bounds[1:] - bounds[:-1])[take]
        data, bounds = data[gathered(bounds[take], each)], starts_of(each)
    w, unit = _HASH[0].words(data, bounds) if len(row) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    k, n = sets.words, len(w)
    whole = np.flatnonzero(unit[: n - k + 1] == unit[k - 1 :]) if n >= k else np.zeros(0, np.int64)
    h = np.zeros(max(0, n - k + 1), np.uint64)
    for i in range(k if len(h) else 0):
        h += w[i : i + len(h)] * FACTORS[i]
    owner, h = unit[whole], mixed(h[whole])
    lengths = np.bincount(unit, minlength=len(row))
    few = np.flatnonzero((lengths > 0) & (lengths >= sets.least) & (lengths < k))
    if len(few):
        # a sequence shorter than k words is one shingle of its own length
        first = np.searchsorted(unit, few)
        own = mixed(lengths[few].astype(np.uint64))
        for i in range(k - 1):
            own += np.where(i < lengths[few], w[np.minimum(first + i, n - 1)] * FACTORS[i], np.uint64(0))
        owner, h = np.concatenate([owner, few]), np.concatenate([h, mixed(own)])
    return row, number, owner, h


def ordered(owner: np.ndarray, high: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The order by owner, then high (20 bits), then h. One 64-bit key sorts nearly all; ties of the key are sorted in full."""
    if len(h) < 2:
        return np.arange(len(h))
    key = (owner.astype(np.uint64) << np.uint64(44)) | (high.astype(np.uint64) << np.uint64(24)) | (h >> np.uint64(40))
    order = np.argsort(key)
    k, x = key[order], h[order]
    tied = k[1:] == k[:-1]
    if (tied & (x[1:] != x[:-1])).any() or owner.max() >= 1 << 20:
        return np.lexsort((h, high, owner))
    return order


def units_of(texts: pa.Array, sets: Sets, rank: np.ndarray | None = None, wanted: Wanted | None = None) -> Units:
    """The units and their sets, each by the rank of its counters and then by hash, or by hash alone."""
    row, number, owner, h = shingled(texts, sets, wanted)
    high = (h >> np.uint64(44)) if rank is None else rank[counter_of(h)]
    order = ordered(owner, high, h << np.uint64(20) if rank is None else h)
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return Units(row, number, np.bincount(owner[new], minlength=len(row)).astype(np.int64), h[new])


def counter_of(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(COUNTERS - 1)).astype(np.int64)


def rarity(docs: DataFrame, sets: Sets) -> np.ndarray:
    """The rank of each counter by the number of its shingles in all units. Counters are summed by tasks that each hold as many as TASKS_TOGETHER partial ones."""
    each = COUNTERS // CHUNKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                counts += np.bincount(counter_of(shingled(texts_of(part.column("text")), sets)[3]), minlength=COUNTERS)
        if counts.any():
            task = pa.array(np.full(CHUNKS, TaskContext.get().partitionId() // TASKS_TOGETHER), pa.int32())
            packed = [pa.compress(counts[i * each : (i + 1) * each].tobytes(), "zstd", asbytes=True) for i in range(CHUNKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), task, pa.array(packed, pa.binary())], names=["chunk", "task", "counts"])

    def total(t: pa.Table) -> pa.Table:
        s = sum(np.frombuffer(pa.decompress(b, 8 * each, "zstd"), np.int64) for b in t.column("counts").to_pylist())
        return pa.table({"chunk": t.column("chunk")[:1], "counts": pa.array([pa.compress(s.tobytes(), "zstd", asbytes=True)], pa.binary())})

    parts = store(docs.select("text").mapInArrow(run, "chunk int, task int, counts binary"), "counters")
    sums = parts.groupBy("chunk", "task").applyInArrow(total, "chunk int, counts binary")
    counts = np.zeros(COUNTERS, np.int64)
    with settings(docs.sparkSession):
        rows = sums.groupBy("chunk").applyInArrow(total, "chunk int, counts binary").collect()
    for r in rows:
        counts[r["chunk"] * each : (r["chunk"] + 1) * each] = np.frombuffer(pa.decompress(r["counts"], 8 * each, "zstd"), np.int64)
    discard(parts)
    rank = np.empty(COUNTERS, np.uint32)
    rank[np.argsort(counts, kind="stable")] = np.arange(COUNTERS, dtype=np.uint32)
    return rank


def cut_units(docs: DataFrame, sets: Sets) -> DataFrame:
    """(doc_id, number, size, node, check, prefix) of every unit with a set or every document, written. Of equal sets in a slice the first alone has its prefix."""
    held = docs.sparkSession.sparkContext.broadcast(rarity(docs, sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = held.value
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                u = units_of(texts_of(part.column("text")), sets, rank)
                node, check = u.node(1, sets.node_bits), u.node(2)
                keep = np.flatnonzero((u.size > 0) | (sets.unit == "document"))
                # the first unit of each set that has an id
                known = np.flatnonzero((u.size > 0) & np.asarray(part.column("doc_id").is_valid())[u.row])
                order = known[np.lexsort((check[known], node[known]))]
                first = np.ones(len(order), bool)
                first[1:] = (node[order][1:] != node[order][:-1]) | (check[order][1:] != check[order][:-1])
                length = np.zeros(len(node), np.int64)
                length[order[first]] = sets.prefix(u.size[order[first]])
                starts = starts_of(u.size)[:-1]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(u.row[keep])), pa.array(u.number[keep].astype(np.int32)), pa.array(u.size[keep].astype(np.int32)), pa.array(node[keep]), pa.array(check[keep]), blobs(u.shingles[gathered(starts[keep], length[keep])], length[keep])],
                    names=["doc_id", "number", "size", "node", "check", "prefix"],
                )

    return store(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, number int, size int, node long, check long, prefix binary"), "units")


def named_nodes(units: DataFrame, *aggregates: Column) -> tuple[DataFrame, DataFrame]:
    """units and a written table of their nodes (node, check, and the aggregates). Where different sets share a node's hash, they are named anew until none do."""
    at = getattr(units, "_stored_at", None)
    while True:
        nodes = store(units.groupBy("node").agg(F.min("check").alias("check"), F.max("check").alias("_other"), *aggregates), "nodes")
        clash = nodes.where("check <> _other").select("node", F.lit(True).alias("_clash"))
        units._stored_at = at
        if clash.isEmpty():
            return units, nodes
        units = units.join(clash, "node", "left").withColumn("node", F.when(F.col("_clash"), F.xxhash64("node", "check")).otherwise(F.col("node"))).drop("_clash")


def live_bitmap(units: DataFrame, sets: Sets) -> np.ndarray:
    """Bits of shingle hashes (by their highest bits) that the prefixes of two nodes or more share."""
    n = units.where("size > 0").agg(F.sum(F.expr(f"size - ceil(size * {sets.num} / {sets.den}) + 1"))).first()[0] or 0
    log = int(min(16, max(6, np.ceil(np.log2(max(1, float(n)) / 1_000_000)) + 4)))
    bits = BITMAP_BITS - log

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(hs: list, nodes: list) -> pa.RecordBatch:
            h, node = np.concatenate(hs), np.concatenate(nodes)
            order = np.argsort(h)
            h, node = h[order], node[order]
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            low, high = np.minimum.reduceat(node, at), np.maximum.reduceat(node, at)
            two = low != high
            times = 1 + two
            h = np.repeat(h[at], times)
            node = np.repeat(low, times)
            node[np.cumsum(times)[two] - 1] = high[two]
            ends = np.searchsorted(h >> np.uint64(64 - log), np.arange((1 << log) + 1, dtype=np.uint64))
            some = np.flatnonzero(np.diff(ends))
            each = np.diff(ends)[some]
            # a bucket's hashes differ in the bits below the first; 32 of them tell all but a few apart
            rest = ((h << np.uint64(log)) >> np.uint64(32)).astype(np.uint32)
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), blobs(rest, each), blobs(node, each)], names=["bucket", "hs", "nodes"])

        hs, nodes, n = [], [], 0
        for batch in batches:
            h, each = unblobbed(batch.column("prefix"), np.uint64)
            if len(h):
                hs.append(h)
                nodes.append(np.repeat(np.asarray(batch.column("node")), each))
                n += len(h)
            if n >= 1_000_000:
                yield flush(hs, nodes)
                hs, nodes, n = [], [], 0
        if n:
            yield flush(hs, nodes)

    def merge(t: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(b, np.uint32) for b in t.column("hs").to_pylist()])
        node = np.concatenate([np.frombuffer(b, np.int64) for b in t.column("nodes").to_pylist()])
        order = np.argsort(h)
        h, node = h[order], node[order]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        live = h[at][np.minimum.reduceat(node, at) != np.maximum.reduceat(node, at)]
        flags = np.zeros(1 << bits, bool)
        flags[live >> np.uint32(32 - bits)] = True
        return pa.table({"bucket": t.column("bucket")[:1], "flags": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    packed = units.where("octet_length(prefix) > 0").select("node", "prefix").mapInArrow(pack, "bucket int, hs binary, nodes binary")
    with settings(units.sparkSession):  # what it shuffles is nearly as large as all prefixes, and of no more use then
        rows = packed.groupBy("bucket").applyInArrow(merge, "bucket int, flags binary").collect()
    out = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    each = 1 << (bits - 3)
    for r in rows:
        out[r["bucket"] * each : (r["bucket"] + 1) * each] = np.frombuffer(r["flags"], np.uint8)
    return out


def place_of(doc_id: np.ndarray, number: np.ndarray) -> pa.Array:
    """doc_id * 2^31 + number as decimal(38): one value that orders units, and of a width that hash aggregates can hold."""
    both = np.stack([(doc_id << np.int64(31)) | number.astype(np.int64), doc_id >> np.int64(33)], axis=1)
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(doc_id), [None, pa.py_buffer(np.ascontiguousarray(both))])


def unit_at(place: str) -> tuple[Column, Column]:
    """doc_id and number of a place."""
    number = F.expr(f"pmod({place}, 2147483648BD)")
    return F.expr(f"({place} - pmod({place}, 2147483648BD)) div 2147483648BD").cast("long").alias("doc_id"), number.cast("int").alias("number")


def live_postings(units: DataFrame, sets: Sets) -> DataFrame:
    """(h, node, check, size, pos, rank, prev, place): the live prefix shingles of each unit that has its prefix; rank: how many live ones stand before, prev: the last of them or 0; place: see place_of."""
    held = units.sparkSession.sparkContext.broadcast(live_bitmap(units, sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = held.value
        for batch in batches:
            h, each = unblobbed(batch.column("prefix"), np.uint64)
            slot = (h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
            live = np.flatnonzero((flags[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1)
            row = np.repeat(np.arange(len(each)), each)[live]
            pos = live - starts_of(each)[row]
            n = np.bincount(row, minlength=len(each))
            rank = np.arange(len(live)) - starts_of(n)[row]
            h = h[live].astype(np.int64)
            prev = np.where(rank > 0, np.concatenate([[0], h[:-1]]) if len(h) else h, 0)
            at = pa.array(row)
            place = place_of(np.asarray(batch.column("doc_id"))[row], np.asarray(batch.column("number"))[row])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), batch.column("node").take(at), batch.column("check").take(at), batch.column("size").take(at), pa.array(pos.astype(np.int32)), pa.array(rank.astype(np.int32)), pa.array(prev), place],
                names=["h", "node", "check", "size", "pos", "rank", "prev", "place"],
            )

    some = units.where("octet_length(prefix) > 0 and doc_id is not null").select("node", "check", "size", "doc_id", "number", "prefix")
    return some.mapInArrow(run, "h long, node long, check long, size int, pos int, rank int, prev long, place decimal(38,0)")


def side(postings: DataFrame, x: str, *more: str) -> DataFrame:
    """Postings with their columns named for one side of a pair: h, x, nx, px, lx, and more."""
    return postings.select("h", F.col("node").alias(x), F.col("size").alias(f"n{x}"), F.col("pos").alias(f"p{x}"), F.col("rank").alias(f"l{x}"), *more)


def fits(sets: Sets) -> Column:
    """Of one shared shingle of x and y: whether sizes (length filter) and what may be shared before, at and after it (positional filter) can still reach the overlap that is needed.

    A shingle of one prefix that comes before a shared one is in the other prefix or not in the other set at all (the order
    is the same for all), so at most the lesser rank among live shingles is shared before it.
    """
    need = F.ceil(F.lit(sets.num) * (F.col("nx") + F.col("ny")) / F.lit(sets.num + sets.den))
    most = F.least("lx", "ly") + 1 + F.least(F.col("nx") - 1 - F.col("px"), F.col("ny") - 1 - F.col("py"))
    return (sets.den * F.least("nx", "ny") >= sets.num * F.greatest("nx", "ny")) & (most >= need)


def slot_flags(wanted: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of the units (doc_id, number) of wanted by hash, of 2^16 to 2^27 bits; and that power. A bit too many only costs time."""
    log = int(min(BITMAP_BITS, max(16, np.ceil(np.log2(max(1, wanted.count()))) + 6)))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = slot_of(np.asarray(batch.column("doc_id")), np.asarray(batch.column("number")), log)
            bits = np.uint64(1) << (s & 63).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(s >> 6), pa.array(bits.astype(np.int64))], names=["w", "bits"])

    with settings(wanted.sparkSession):
        found = wanted.select("doc_id", "number").mapInArrow(words, "w long, bits long").groupBy("w").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    flags = np.zeros(1 << (log - 6), np.uint64)
    flags[found.column("w").to_numpy()] = found.column("bits").to_numpy().astype(np.uint64)
    return flags, log


def marked(flags: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (flags[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1) > 0


def slot_of(doc_id: np.ndarray, number: np.ndarray, log: int) -> np.ndarray:
    return (mixed(mixed(doc_id.astype(np.uint64)) + number.astype(np.uint64)) >> np.uint64(64 - log)).astype(np.int64)


def verified(docs: DataFrame, sets: Sets, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets match, written. nodes: (node, check, place), one unit that holds the node. pairs must be a written table.

    Where sets are large, pairs first meet with how their sets fall into ranges of hashes alone (the suffix filter), and only
    sets of pairs that pass are sent.
    """
    asked = _wanted(pairs, nodes)
    text = docs.where("doc_id is not null").select("doc_id", "text")
    held = docs.sparkSession.sparkContext.broadcast(slot_flags(asked))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, log = held.value
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids = np.asarray(part.column("doc_id"))

                def wanted(row: np.ndarray, number: np.ndarray, ids: np.ndarray = ids) -> np.ndarray:
                    return marked(flags, slot_of(ids[row], number, log))

                u = units_of(texts_of(part.column("text")), sets, None, wanted)
                some = np.flatnonzero(u.size > 0)
                counts = np.bincount(u.owner() * sets.ranges + (u.shingles >> np.uint64(64 - sets.ranges.bit_length() + 1)).astype(np.int64), minlength=sets.ranges * len(u.size)) if sets.ranges else np.zeros(0, np.int64)
                counts = counts.reshape(len(u.size), sets.ranges)[some].ravel().astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[u.row[some]]), pa.array(u.number[some].astype(np.int32)), pa.array(u.node(2)[some]), blobs(counts, np.full(len(some), sets.ranges)), blobs(u.shingles, u.size[some])],
                    names=["doc_id", "number", "check", "ranges", "members"],
                )

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (unblobbed(batch.column(c), np.uint32)[0].reshape(-1, sets.ranges).astype(np.int64) for c in ("xa", "xb"))
            good = (sets.num + sets.den) * np.minimum(x, y).sum(axis=1) >= sets.num * (x.sum(axis=1) + y.sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                good[i] = (sets.num + sets.den) * len(np.intersect1d(x, y, assume_unique=True)) >= sets.num * (len(x) + len(y))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good))

    made = text.mapInArrow(sets_of, "doc_id long, number int, check long, ranges binary, members binary")
    if sets.ranges:
        made = store(made, "members")
        close = store(_met(pairs, made, asked, "ranges").mapInArrow(near, "a long, b long"), "close-pairs")
        still = _wanted(close, nodes)
        again = docs.sparkSession.sparkContext.broadcast(slot_flags(still))

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flags, log = again.value
            for batch in batches:
                yield batch.filter(pa.array(marked(flags, slot_of(np.asarray(batch.column("doc_id")), np.asarray(batch.column("number")), log))))

        rest = made.select("doc_id", "number", "check", "members")
        out = store(_met(close, rest.mapInArrow(kept, rest.schema), still, "members").mapInArrow(match, "a long, b long"), "links")
        for df in (made, close, still):
            discard(df)
    else:
        out = store(_met(pairs, made, asked, "members").mapInArrow(match, "a long, b long"), "links")
    discard(asked)
    return out


def _wanted(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, check, doc_id, number) of all nodes in pairs, written."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return store(ends.join(nodes, "node").select("node", "check", *unit_at("place")), "wanted")


def _met(pairs: DataFrame, made: DataFrame, wanted: DataFrame, value: str) -> DataFrame:
    """pairs with the value of both nodes, xa and xb."""
    # rows that share doc_id would give a node twice
    own = made.select("doc_id", "number", "check", value).join(wanted, ["doc_id", "number", "check"]).select("node", value).dropDuplicates(["node"])
    a = own.select(F.col("node").alias("a"), F.col(value).alias("xa"))
    b = own.select(F.col("node").alias("b"), F.col(value).alias("xb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "xa", "xb")
