"""Fingerprints of documents: one-permutation MinHash with optimal densification, kept as low-order bits.

Every five-word shingle is hashed once; part of the hash names its bin, the rest competes for the bin's least value. An empty
bin looks at the other bins in an order of its own, the same for all documents, and takes the value of the first that holds
one. Values are mixed with their bin, so that copies of one value have bits of their own in each bin, and the low `bits` bits
are packed; as two different values share them by chance once in 2^bits, the share of equal bins is corrected for that before
it counts as likeness.

Words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; a text of fewer than five words is one shingle, its whole sequence. A text
without words (or null, which counts as empty) has an empty fingerprint: its likeness to another such text is 1, to any other
0. Whole texts are read, however long; columns other than the id and the text are ignored.

neighbours(): documents are dealt by range of id, so that the next one is the next row of the task; the last row of a task and
the first of the following one meet in a join of two rows a task. Null ids come first; documents of one id follow each other
by a hash of their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidespan.llm.arrow_text import gathered_slices, mixed, strings_of, texts_of
from tidespan.llm.set_join import Sets, shingled
from tidespan.session import store

SLICE = 2 << 20
EMPTY = np.uint64((1 << 64) - 1)
PRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


@dataclass(frozen=True)
class Prints:
    """bins: a power of two; bits: 1, 2, 4 or 8 of each bin's value."""

    words: int = 5
    bins: int = 512
    bits: int = 4


_ORDERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def orders(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bin, the order in which it looks at the others when empty, and the place of each bin in that order."""
    if bins not in _ORDERS:
        x = mixed(np.arange(bins * bins, dtype=np.uint64) + np.uint64(0x5DEECE66D)).reshape(bins, bins)
        order = np.argsort(x, axis=1).astype(np.int16)
        _ORDERS[bins] = order, np.argsort(order, axis=1).astype(np.int16)
    return _ORDERS[bins]


def densified(table: np.ndarray) -> np.ndarray:
    """Values of all bins; rows without any value stay empty."""
    n, bins = table.shape
    order, place = orders(bins)
    full = table != EMPTY
    held = full.sum(axis=1)
    out = table.copy()
    row, b = np.nonzero(~full & (held > 0)[:, None])
    # a few looks settle rows with many values; where few bins hold one, all of those are compared by their place
    for k in range(8):
        to = order[b, k]
        met = full[row, to]
        out[row[met], b[met]] = table[row[met], to[met]]
        row, b = row[~met], b[~met]
    edges = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    for a, z in zip(edges, np.append(edges[1:], len(row))):
        own = np.flatnonzero(full[row[a]])
        out[row[a], b[a:z]] = table[row[a], own[place[b[a:z]][:, own].argmin(axis=1)]]
    return out


def low_bits(texts: pa.Array, prints: Prints) -> tuple[np.ndarray, np.ndarray]:
    """The low bits of every bin of each text, and which texts have words."""
    _, _, owner, h = shingled(texts, Sets(words=prints.words))
    table = np.full(len(texts) * prints.bins, EMPTY)
    shift = np.uint64(prints.bins.bit_length() - 1)
    np.minimum.at(table, owner * prints.bins + (h & np.uint64(prints.bins - 1)).astype(np.int64), h >> shift)
    table = table.reshape(len(texts), prints.bins)
    # else the copies of a small set's few values would agree with another's by chance all at once
    own = mixed(densified(table) ^ (np.arange(prints.bins, dtype=np.uint64) << np.uint64(48)))
    return (own & np.uint64((1 << prints.bits) - 1)).astype(np.uint8), (table != EMPTY).any(axis=1)


def packed(low: np.ndarray, some: np.ndarray, bits: int) -> list[bytes]:
    """Fingerprints: the bits of the bins one after another, high first; empty for texts without words."""
    each = 8 // bits
    x = np.zeros((len(low), low.shape[1] // each), np.uint8)
    for k in range(each):
        x |= low[:, k::each] << np.uint8(8 - bits * (k + 1))
    return [r.tobytes() if s else b"" for r, s in zip(x, some.tolist(), strict=True)]


def unpacked_bins(prints_of: list[bytes], prints: Prints) -> tuple[np.ndarray, np.ndarray]:
    """What packed() packed."""
    width = prints.bins * prints.bits // 8
    some = np.array([len(p) > 0 for p in prints_of], bool)
    x = np.frombuffer(b"".join(p or bytes(width) for p in prints_of), np.uint8).reshape(-1, width)
    shifts = np.arange(8 - prints.bits, -1, -prints.bits, dtype=np.uint8)
    return ((x[:, :, None] >> shifts) & np.uint8((1 << prints.bits) - 1)).reshape(len(x), -1), some


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray, bits: int) -> np.ndarray:
    """The estimated Jaccard similarity, row by row, corrected for low bits that agree by chance."""
    chance = 1 / (1 << bits)
    same = (a == b).mean(axis=1)
    return np.where(some_a & some_b, np.clip((same - chance) / (1 - chance), 0, 1), (some_a == some_b).astype(float))


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as many code points of what follows, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def rows_of(ids: list, texts: list[str], following: list[str], prints: Prints) -> pa.RecordBatch:
    """PRINTS of texts and what follows each."""
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    # what follows is nearly always the next text of the list: it is hashed once
    chained = all(a is b for a, b in zip(following[:-1], texts[1:]))
    own, some = low_bits(texts_of(pa.array(texts + following[-1:] if chained else texts, pa.large_string())), prints)
    after, some_after = (own[1:], some[1:]) if chained else low_bits(texts_of(pa.array(following, pa.large_string())), prints)
    own, some = own[: len(texts)], some[: len(texts)]
    new, some_new = low_bits(texts_of(pa.array(changed, pa.large_string())), prints)
    columns = [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        pa.array(packed(own, some, prints.bits), pa.binary()),
        pa.array(packed(new, some_new, prints.bits), pa.binary()),
        pa.array(likeness(own, new, some, some_new, prints.bits)),
        pa.array(likeness(own, after, some, some_after, prints.bits)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[f.split(" ")[0] for f in PRINTS.split(", ")])


def fingerprints(docs: DataFrame, prints: Prints = Prints(), id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every text, as hexadecimal digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered_slices(batches, "text", SLICE):
            low, some = low_bits(texts_of(part.column("text")), prints)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(packed(low, some, prints.bits), pa.binary())], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return store(rows.mapInArrow(run, "doc_id long, fingerprint binary"), "prints").withColumn("fingerprint", F.lower(F.hex("fingerprint")))


def neighbours(docs: DataFrame, prints: Prints = Prints(), id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Of every document: its fingerprint, that of its text with the last half replaced by the next document's beginning, and its likeness to both; the last document is followed by the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held_id, held, first = TaskContext.get().partitionId(), None, None, True

        def border(kind: str, doc_id: int | None, t: str) -> pa.RecordBatch:
            return shaped(None, kind, doc_id, t)

        def shaped(rows: pa.RecordBatch | None, kind: str = "row", doc_id: int | None = None, t: str | None = None) -> pa.RecordBatch:
            n = rows.num_rows if rows is not None else 1
            columns = list(rows.columns) if rows is not None else [pa.array([doc_id], pa.int64()), *(pa.nulls(1, k) for k in kinds[1:])]
            return pa.RecordBatch.from_arrays([*columns, pa.array([part] * n, pa.int32()), pa.array([kind] * n), pa.array([t] * n, pa.string())], names=names)

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
        names = [*(f.split(" ")[0] for f in PRINTS.split(", ")), "part", "kind", "text"]
        for batch in gathered_slices(batches, "text", SLICE):
            ids, texts = batch.column("doc_id").to_pylist(), strings_of(texts_of(batch.column("text")))
            if not texts:
                continue
            if first:
                yield border("head", ids[0], texts[0])
            else:
                ids, texts = [held_id, *ids], [held, *texts]
            first, held_id, held = False, ids[-1], texts[-1]
            if len(texts) > 1:
                yield shaped(rows_of(ids[:-1], texts[:-1], texts[1:], prints))
        if not first:
            yield border("tail", held_id, held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield rows_of([r["doc_id"]], [r["text"]], [r["following"]], prints)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("_tie", F.xxhash64("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    found = store(dealt.mapInArrow(run, f"{PRINTS}, part int, kind string, text string"), "prints", records=500)
    heads = found.where("kind = 'head'").select("part", "text")
    tails = found.where("kind = 'tail'").select("doc_id", "part", "text")
    # the tasks that had rows, each with the one after it: numbers alone
    circle = heads.select("part", F.lead("part").over(Window.orderBy("part")).alias("_next"), F.min("part").over(Window.partitionBy(F.lit(1))).alias("_first"))
    after = circle.select("part", F.coalesce("_next", "_first").alias("_to"))
    met = tails.join(after, "part").join(heads.select(F.col("part").alias("_to"), F.col("text").alias("following")), "_to")
    names = [f.split(" ")[0] for f in PRINTS.split(", ")]
    return found.where("kind = 'row'").select(*names).unionByName(met.select("doc_id", "text", "following").mapInArrow(meet, PRINTS))


def op12_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    out = neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
