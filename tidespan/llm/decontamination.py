"""Benchmark decontamination by q-gram lemma filtering.

Texts are compared letter by letter, lower-cased, with runs of white space as one space. A benchmark item of m letters
leaks where some stretch of a document is within k = floor(budget * m) edits of it. Such a stretch shares at least
m - q + 1 - k * q of its q-grams with the item, all of them on neighbouring diagonals (document position minus item
position). So shared q-grams are counted in overlapping bands of diagonals, bands that reach the bound are kept, and a
banded alignment decides. k is lowered where the bound would fall below one q-gram.

The benchmark is read in blocks of at most block_chars letters, each a pass over the documents; only a block's index is
sent to the tasks, so its size is bounded whatever the benchmark's. Documents are read where they are; nothing of them
is shuffled.

Defined results: items of fewer than min_chars letters are too short to be told from chance and never leak; null and
empty texts leak nothing; each row is judged by itself, repeated rows alike; null ids come back as null; other columns
are not read by find_leaks and pass through without_leaks; empty tables give no leaks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidespan.llm.arrow_text import gathered, mixed, slices, starts_of, texts_of

LEAKS = "doc_id long, item_id long, start long, end long, edits int"
SPACE_CODES = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x2028, 0x2029, 0x202F, 0x3000, *range(0x2000, 0x200B)])
BREAK = 0x10FFFF


@dataclass(frozen=True)
class Budget:
    q: int = 12
    share: float = 0.07
    min_chars: int = 40
    block_chars: int = 2_000_000

    def edits(self, m: int) -> int:
        """The most edits allowed for an item of m letters."""
        return max(0, min(int(self.share * m), (m - self.q) // self.q))

    def bound(self, m: int) -> int:
        """The least number of shared q-grams of a stretch within the edits."""
        return m - self.q + 1 - self.edits(m) * self.q


def lower_table() -> np.ndarray:
    """Lower-case letters of the basic plane, where they are single letters."""
    low = [chr(c).lower() if not 0xD800 <= c < 0xE000 else chr(0) for c in range(0x10000)]
    return np.array([ord(x) if len(x) == 1 and x != "\0" else c for c, x in enumerate(low)], np.uint32)


def letters_of(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised letters of the texts, each text ended by BREAK; where each text starts; and each letter's position in its own text."""
    raw = np.frombuffer("\U0010ffff".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    first = starts_of(sizes)
    at = np.arange(len(raw)) - np.repeat(first[:-1], sizes)
    small = raw < 0x10000
    x = np.where(small, table[np.where(small, raw, 0)], raw)
    space = np.isin(x, SPACE_CODES) if (x > 127).any() else (x == 32) | ((x >= 9) & (x <= 13))
    x = np.where(space, 32, x)
    keep = np.ones(len(x), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    owner_ends = np.cumsum(keep)[first[1:] - 1] if len(texts) else np.zeros(0, np.int64)
    return x[keep].astype(np.uint32), np.concatenate([[0], owner_ends]), at[keep]


def grams(x: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q letters from each position on."""
    n = len(x) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    power, width, block = base, 1, x.astype(np.uint64) + np.uint64(1)
    out, done = np.zeros(len(x), np.uint64), 0
    rest = q
    while rest:
        if rest & 1:
            # out covers `done` letters; append this block of `width` letters after them
            out = out[: len(x) - done] * power if done else out
            m = len(x) - done - width + 1
            out = out[:m] + block[done : done + m]
            done += width
        rest >>= 1
        if rest:
            block = block[: len(block) - width] * power + block[width:]
            with np.errstate(over="ignore"):  # products are taken modulo 2^64
                power = power * power
            width *= 2
    return mixed(out[:n])


@dataclass
class Index:
    """q-grams of a block of items: sorted hashes with their (item, position), and a table of hash bits that most q-grams of documents fail."""

    ids: list
    texts: list
    hashes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    flags: np.ndarray
    k: np.ndarray
    bound: np.ndarray


def index_of(items: list[tuple], budget: Budget) -> Index:
    table = lower_table()
    ids, texts = [i for i, _ in items], [letters_of([t], table)[0][:-1] for _, t in items]
    h = [grams(t, budget.q) for t in texts]
    sizes = np.array([len(x) for x in h], np.int64)
    flat = np.concatenate(h) if h else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(h)), sizes)
    pos = gathered(np.zeros(len(h), np.int64), sizes)
    order = np.argsort(flat, kind="stable")
    flat, item, pos = flat[order], item[order], pos[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    flags = np.zeros(1 << 24, bool)
    flags[(flat >> np.uint64(40)).astype(np.int64)] = True
    m = [len(t) for t in texts]
    return Index(ids, texts, flat[first], np.append(first, len(flat)), item, pos, np.packbits(flags), np.array([budget.edits(x) for x in m]), np.array([budget.bound(x) for x in m]))


def banded(item: np.ndarray, window: np.ndarray, low: int, high: int, k: int) -> tuple[int, int] | None:
    """Least edits of the item to a stretch of the window that starts at offsets low to high or within k of them, and that stretch's end; None beyond k edits.

    Cell (i, d) stands for i letters of the item and window position i + d; only diagonals low - k to high + k are kept.
    """
    a = low - k
    d = np.arange(a, high + k + 1)
    far = np.int64(1 << 30)
    row = np.where((d >= 0) & (d <= len(window)), 0, far).astype(np.int64)
    steps = np.arange(len(d))
    for i, c in enumerate(item.tolist()):
        j = i + d
        inside = (j >= 0) & (j < len(window))
        same = np.full(len(d), 1, np.int64)
        same[inside] = window[j[inside]] != c
        best = np.where(inside, row + same, far)
        # a letter of the item without one of the window moves down a diagonal; one of the window alone moves up
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)
        best[(j + 1 < 0) | (j + 1 > len(window))] = far
        row = np.minimum.accumulate(best - steps) + steps
        if row.min() > k:
            return None
    e = int(row.argmin())
    return int(row[e]), int(len(item) + d[e])


def leaks_in(texts: list[str], index: Index, budget: Budget, table: np.ndarray) -> list[tuple]:
    """(text number, item number, start, end, edits), by position in the text, of the best alignment of each region that passes."""
    x, first, at = letters_of(texts, table)
    h = grams(x, budget.q)
    if not len(h) or not len(index.hashes):
        return []
    slot = (h >> np.uint64(40)).astype(np.int64)
    hit = np.flatnonzero(index.flags[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1)
    g = np.searchsorted(index.hashes, h[hit])
    g[g == len(index.hashes)] = 0
    good = index.hashes[g] == h[hit]
    hit, g = hit[good], g[good]
    each = index.first[g + 1] - index.first[g]
    where = gathered(index.first[g], each)
    p = np.repeat(hit, each)
    item, diagonal = index.item[where], p - index.pos[where]
    # bands of 2k + 2 diagonals (at least 8), the next one starting half a band later: any k + 1 neighbours lie in one band
    half = np.maximum(index.k + 1, 4)[item]
    band = np.floor_divide(diagonal, half)
    key_item, key_band, key_doc = (np.concatenate([v, v]) for v in (item, band, np.searchsorted(first, p, side="right") - 1))
    key_band[len(band) :] -= 1
    order = np.lexsort((key_band, key_item, key_doc))
    ks = (key_doc[order], key_item[order], key_band[order])
    if not len(order):
        return []
    new = np.concatenate([[True], (ks[0][1:] != ks[0][:-1]) | (ks[1][1:] != ks[1][:-1]) | (ks[2][1:] != ks[2][:-1])])
    begin = np.flatnonzero(new)
    counts = np.diff(np.append(begin, len(order)))
    out: dict = {}
    for b in begin[counts >= index.bound[ks[1][begin]]]:
        n, it, ba = int(ks[0][b]), int(ks[1][b]), int(ks[2][b])
        k, w, m = int(index.k[it]), int(max(index.k[it] + 1, 4)), len(index.texts[it])
        lo, hi = int(first[n]), int(first[n + 1]) - 1
        a = max(lo, ba * w - k)
        z = min(hi, (ba + 2) * w + m + k)
        window = x[a:z]
        found = banded(index.texts[it], window, ba * w - a, (ba + 2) * w - a, k)
        if found is None:
            continue
        edits, end = found
        back = banded(index.texts[it][::-1], window[:end][::-1], 0, 0, k)
        start = end - (back[1] if back else m)
        spot = (n, it, int(at[a + start]), int(at[min(a + end, hi) - 1]) + 1, edits)
        # neighbouring bands find the same stretch
        same = [s for s in out.get((n, it), []) if s[2] < spot[3] and spot[2] < s[3]]
        if not same:
            out.setdefault((n, it), []).append(spot)
        elif all(edits < s[4] for s in same):
            out[n, it] = [s for s in out[n, it] if s not in same] + [spot]
    return sorted(s for v in out.values() for s in v)


def blocks_of(benchmark: DataFrame, budget: Budget) -> Iterator[list[tuple]]:
    """Items in blocks of at most block_chars letters, or one item."""
    block, size = [], 0
    usable = benchmark.where(F.length("text") >= budget.min_chars).orderBy("item_id", "text")
    for r in usable.toLocalIterator():
        if len(re.sub(r"\s+", " ", r["text"])) < budget.min_chars:
            continue
        if block and size + len(r["text"]) > budget.block_chars:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, budget: Budget = Budget(), id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a leaking stretch: doc_id, item_id, start and end (positions in the document's text) and edits."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = []
    for block in blocks_of(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), budget):
        held = spark.sparkContext.broadcast(index_of(block, budget))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index, table = held.value, lower_table()
            for batch in batches:
                for part in slices(batch, "text", 4 << 20):
                    ids = part.column("doc_id").to_pylist()
                    rows = leaks_in(texts_of(part.column("text")).to_pylist(), index, budget, table)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[r[0]] for r in rows], pa.int64()), pa.array([index.ids[r[1]] for r in rows], pa.int64()), *[pa.array([r[i] for r in rows], t) for i, t in ((2, pa.int64()), (3, pa.int64()), (4, pa.int32()))]],
                        names=["doc_id", "item_id", "start", "end", "edits"],
                    )

        parts.append(docs.mapInArrow(run, LEAKS))
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], LEAKS)


def without_leaks(docs: DataFrame, benchmark: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """docs without the documents that leak."""
    from tidespan.session import store

    gone = store(find_leaks(docs, benchmark, budget).select(F.col("doc_id").alias("_leaks")).distinct(), "leaks")
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_leaks"), "left_anti")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
