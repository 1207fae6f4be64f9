"""Token-id files: each document is compressed by itself with one Zstandard dictionary trained on serialized id arrays.

A file row is a block: magic, version, id width, the dictionary's hash, an index of (doc_id, offset, size, n_tokens) and
the documents' frames. A document is read by its block (doc_id ranges are columns, so the scan prunes) and its offset,
without touching its neighbours. Blocks hold ascending doc_id (null first, then equal ids by length and checksum) and
are cut at about block_bytes, or hold one longer document.

Texts are encoded where they are; what is shuffled is compressed frames, once, by ranges of doc_id. The number of ranges
follows the documents, up to max_ranges; their token totals (one row a range) give each document its global start.

Blocks, dictionary and range starts are tables below one path, from which any session opens them.

Defined results: null or empty text has the end id alone; repeated rows are kept, one after another; an empty table gives
no blocks and a dictionary of no bytes.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidespan.llm.arrow_text import encoder, gathered_slices, starts_of, texts_of
from tidespan.session import settings, shared_dir

MAGIC = b"TSID"
HEAD = "<4sBB16sI"
ENTRY = np.dtype([("doc_id", "<i8"), ("is_null", "u1"), ("offset", "<u8"), ("size", "<u4"), ("n_tokens", "<u8")])
BLOCKS = "range_no int, block_no int, first_id long, last_id long, start_in_range long, n_tokens long, block binary"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


@dataclass(frozen=True)
class TokenFiles:
    """Opened files: blocks is read from path as it is used; the dictionary (of bounded size) and the number of tokens before each range (as many as there are ranges) were read from it."""

    path: str
    blocks: DataFrame
    dictionary: bytes
    bases: dict


def sample_hash_limit(docs: DataFrame, most: int, max_chars: int) -> DataFrame:
    """At most about `most` short documents, the lowest hashes of doc_id; only hashes are sorted, never texts."""
    short = docs.where(F.length("text").between(1, max_chars))
    lowest = [r[0] for r in short.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(most).collect()]
    return short.where(F.xxhash64("doc_id") <= (lowest[-1] if lowest else -(1 << 63))).limit(2 * most)


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: str, size: int = 65_536, most: int = 2_000, max_chars: int = 8_192) -> bytes:
    """A dictionary from the serialized ids of a bounded sample of short documents; empty where there is too little to train on."""
    import zstandard

    texts = [r["text"] for r in sample_hash_limit(docs, most, max_chars).select("text").collect()]
    if not texts:
        return b""
    ids, lengths = encoder(tokenizer, words=False).encode(pa.array(texts, pa.large_string()))
    bounds = starts_of(lengths)
    samples = [np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype(width).tobytes() for i in range(len(texts))]
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:  # the library refuses samples that are too few or too small
        return b""


def write(docs: DataFrame, tokenizer: str, end_id: int = 0, width: str = "<u2", block_bytes: int = 4 << 20, range_docs: int = 600, max_ranges: int = 100_000, level: int = 3, path: str | None = None) -> TokenFiles:
    """Writes blocks, dictionary and range starts as tables below path (by default below the folder that all executors share), and opens them. width: "<u2" for vocabularies of up to 65,536 ids, else "<u4"; a larger id stops the run."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex[:12]}"
    largest = np.iinfo(width).max
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_ranges = max(1, min(max_ranges, -(-docs.count() // range_docs)))
    shares = [i / n_ranges for i in range(1, n_ranges)]
    cuts = sorted(set(docs.select(F.percentile_approx("doc_id", shares, 20 * n_ranges)).first()[0] or [])) if shares else []
    dictionary = train_dictionary(docs, tokenizer, end_id, width)
    dict_hash = hashlib.sha256(dictionary).digest()[:16]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc = encoder(tokenizer, words=False)
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if trained:
            trained.precompute_compress(level=level)  # else each document would digest the dictionary anew
        one = zstandard.ZstdCompressor(level=level, dict_data=trained)
        for part in gathered_slices(batches, "text"):
            ids, lengths = enc.encode(texts_of(part.column("text")))
            if max(ids.max(initial=0), end_id) > largest:
                raise ValueError(f"an id needs more than the {np.dtype(width).itemsize} bytes that ids are written in")
            bounds = starts_of(lengths)
            frames = [one.compress(np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype(width).tobytes()) for i in range(len(lengths))]
            docs_in = part.column("doc_id").to_pylist()
            ranges = [0 if d is None else bisect_right(cuts, d) for d in docs_in]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ranges, pa.int32()), pa.array(docs_in, pa.int64()), pa.array(lengths + 1, pa.int64()), pa.array(frames, pa.binary())],
                names=["range_no", "doc_id", "n_tokens", "frame"],
            )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        state = {"range": None, "block": 0, "start": 0, "bytes": 0}

        def flush():
            entries = np.zeros(len(held), ENTRY)
            at = 0
            for k, (d, n, f) in enumerate(held):
                entries[k] = (d or 0, d is None, at, len(f), n)
                at += len(f)
            block = struct.pack(HEAD, MAGIC, 1, np.dtype(width).itemsize, dict_hash, len(held)) + entries.tobytes() + b"".join(f for _, _, f in held)
            known = [d for d, _, _ in held if d is not None]
            total = sum(n for _, n, _ in held)
            row = (state["range"], state["block"], min(known, default=None), max(known, default=None), state["start"], total, block)
            state["start"] += total
            state["block"] += 1
            state["bytes"] = 0
            held.clear()
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["range_no", "block_no", "first_id", "last_id", "start_in_range", "n_tokens", "block"])

        for batch in batches:
            for r, d, n, f in zip(*(batch.column(c).to_pylist() for c in ("range_no", "doc_id", "n_tokens", "frame")), strict=True):
                if held and (r != state["range"] or state["bytes"] + len(f) > block_bytes):
                    yield flush()
                if r != state["range"]:
                    state |= {"range": r, "block": 0, "start": 0}
                held.append((d, n, f))
                state["bytes"] += len(f)
        if held:
            yield flush()

    frames = docs.mapInArrow(encode, "range_no int, doc_id long, n_tokens long, frame binary")
    in_order = frames.repartition(len(cuts) + 1, "range_no").sortWithinPartitions("range_no", F.col("doc_id").asc_nulls_first(), "n_tokens", "frame")
    with settings(spark):
        in_order.mapInArrow(gather, BLOCKS).write.parquet(f"{path}/blocks")
    before = F.sum("n").over(Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1))
    totals = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("range_no").agg(F.sum("n_tokens").alias("n"))
    totals.select("range_no", F.coalesce(before, F.lit(0)).alias("base")).write.parquet(f"{path}/ranges")
    spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    return open_files(spark, path)


def open_files(spark, path: str) -> TokenFiles:
    """Files that write() left below path, in this or another session."""
    dictionary = bytes(spark.read.schema("dictionary binary").parquet(f"{path}/dictionary").first()[0])
    bases = {r["range_no"]: r["base"] for r in spark.read.schema("range_no int, base long").parquet(f"{path}/ranges").toLocalIterator()}
    return TokenFiles(path, spark.read.schema(BLOCKS).parquet(f"{path}/blocks"), dictionary, bases)


def open_block(block: bytes, dictionary: bytes):
    """(entries, function of an entry that gives its ids). Raises where the block was written with another dictionary."""
    import zstandard

    magic, version, width, dict_hash, n = struct.unpack_from(HEAD, block)
    if magic != MAGIC or version != 1:
        raise ValueError("not a block of token ids")
    if dict_hash != hashlib.sha256(dictionary).digest()[:16]:
        raise ValueError("another dictionary is needed for this block")
    entries = np.frombuffer(block, ENTRY, n, struct.calcsize(HEAD))
    first = struct.calcsize(HEAD) + n * ENTRY.itemsize
    one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    view = memoryview(block)

    def ids(e) -> np.ndarray:
        at = first + int(e["offset"])
        return np.frombuffer(one.decompress(view[at : at + int(e["size"])]), f"<u{width}").astype("<u4")

    return entries, ids


def read(files: TokenFiles) -> DataFrame:
    """One row a document, from the blocks alone."""
    dictionary, bases = files.dictionary, files.bases

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                entries, ids = open_block(batch.column("block")[i].as_py(), dictionary)
                counts = entries["n_tokens"].astype(np.int64)
                starts = bases[batch.column("range_no")[i].as_py()] + batch.column("start_in_range")[i].as_py() + np.cumsum(counts) - counts
                crcs = [zlib.crc32(ids(e).tobytes()) for e in entries]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(entries["doc_id"], pa.int64(), mask=entries["is_null"].astype(bool)), pa.array(starts), pa.array(counts), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return files.blocks.select("range_no", "start_in_range", "block").mapInArrow(run, READ)


def lookup(files: TokenFiles, doc_id: int) -> list[np.ndarray]:
    """The ids of one document (each of its rows), decompressing nothing else."""
    out = []
    for r in files.blocks.where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).orderBy("range_no", "block_no").toLocalIterator():
        entries, ids = open_block(bytes(r["block"]), files.dictionary)
        out += [ids(e) for e in entries if e["doc_id"] == doc_id and not e["is_null"]]
    return out


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = write(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return read(open_files(spark, written.path))
