"""Sum-of-squares packing of tokenised documents into sequences of a fixed capacity.

Each piece goes where the sum, over all residual gaps, of the squared number of open sequences with that gap becomes
smallest (a new sequence counts as one choice). Only documents longer than the capacity are cut. Pieces are tokenised
where their text is; what moves afterwards is one small row a piece. Pieces are dealt round-robin to shards of a fixed
size, so that no shard grows with the input, whatever repeats in it; a shard leaves at most a few sequences unfilled.

Defined results: null or empty text is a document of the end id alone; repeated rows are packed each; other columns of
the input are not read; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidespan.llm.arrow_text import encoder, gathered_slices, starts_of, texts_of
from tidespan.session import store

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
SHARD_ROWS = 50_000


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece: doc_id, piece, start, length and the crc32 of its ids. The ids of a document are those of its whole text and end_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, words=True)
        for part in gathered_slices(batches, "text"):
            ids, lengths = enc.encode(texts_of(part.column("text")))
            bounds = starts_of(lengths)
            rows: tuple[list, ...] = ([], [], [], [], [])
            for i, doc in enumerate(part.column("doc_id").to_pylist()):
                own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(own), capacity)):
                    x = own[at : at + capacity]
                    for column, value in zip(rows, (doc, k, at, len(x), zlib.crc32(x.tobytes())), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.selectExpr(f"`{id_column}` as doc_id", f"`{text}` as text").mapInArrow(run, PIECES)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size, in the order given."""
    n_open = np.zeros(capacity + 1, dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins = np.empty(len(sizes), np.int64)
    offsets = np.empty(len(sizes), np.int64)
    made = 0
    cost = np.empty(capacity + 1, dtype=np.int64)
    never = np.iinfo(np.int64).max
    for i, s in enumerate(sizes.tolist()):
        if s == capacity:
            bins[i], offsets[i] = made, 0
            made += 1
            continue
        # a sequence with gap g goes to gap g - s: what the sum of squares changes by; a full one no longer counts
        gaps = n_open[s:capacity]
        c = cost[s:capacity]
        np.multiply(n_open[: capacity - s], 2, out=c)
        c += 2
        c[0] = 1
        c -= 2 * gaps
        c[gaps == 0] = never
        k = int(c.argmin()) if len(c) else 0
        if len(c) and c[k] < 2 * n_open[capacity - s] + 1:
            g = s + k
            b = stacks[g].pop()
            n_open[g] -= 1
        else:
            g, b = capacity, made
            made += 1
        bins[i], offsets[i] = b, capacity - g
        if g > s:
            stacks[g - s].append(b)
            n_open[g - s] += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """pieces with sequence_id and offset. pieces must be a written table, as it is counted first."""
    shards = max(1, -(-pieces.count() // shard_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = sum_of_squares(np.asarray(rows.column("length")), capacity)
        rows = rows.append_column("sequence_id", pa.array(bins + (shard << 32), pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))
        yield from rows.combine_chunks().to_batches()

    return pieces.repartition(shards).mapInArrow(run, PACKED)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    return pack(store(pieces_of(docs, tokenizer, capacity, end_id), "pieces"), capacity)


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
