"""Katz backoff bigram model: Good-Turing discounted counts, exactly normalised backoff weights, scored over whole texts.

Texts are cut into words once, into chunks of bounded size that keep a local dictionary and codes. Tables of counts are
partitioned by hash; a chunk asks each partition for its distinct words, and then for its distinct word pairs, as packed
arrays, and gets counts back in the order asked. So what is shuffled is one entry for each distinct word or pair of a
chunk, not one for each token; the tables are never broadcast, and nothing of them is collected but counts of counts.
Pairs are partitioned by their first word, whose backoff weight needs them together; a first word with more than its
share of all tokens is split over parts by the second word, and its partial sums (all of them; at most SHARES such words,
of at most 2 * SHARES parts together) are added.

P(w | h) = d(c(h, w)) * c(h, w) / c(h), where the pair was seen, else a(h) * P(w); P(w) = d(c(w)) * c(w) / N, and words
never seen share the mass that is left as one event. a(h) makes the sum over all words exactly 1. Where discounting
leaves a history nothing for other words, one is added to its total; the same holds for words.

Defined results: null or empty text is its end token alone; the first token's history is a start mark; repeated rows are
scored each (and learned from each); a null doc_id counts as an empty string for the fold; with no training rows every
word is unseen and scores log10(1) = 0, by the model, and by the base as its formula says; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidespan.llm.arrow_text import coded, flat_words, gathered_slices, hashes_of, starts_of, texts_of
from tidespan.session import discard, store

END, START = np.uint64(0x1D), np.uint64(0x57)
TOP = 5
SHARES = 1024
LEAST_HOT = 1_000_000
CHUNK_BYTES = 8 << 20
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def packed(x: np.ndarray) -> bytes:
    """Compressed, all first bytes of the numbers before all second ones: what is mostly zero or alike lies together."""
    import zstandard

    x = np.ascontiguousarray(x).reshape(-1)
    return bytes([x.dtype.itemsize]) + zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes(), 1)


def unpacked(b: bytes, kind) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.decompress(b[1:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(b[0], -1).T).reshape(-1).view(kind)


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing discounts d(1..k), from the numbers n[r - 1] of events seen r times; empty where no k up to TOP gives discounts in (0, 1]."""
    for k in range(TOP, 0, -1):
        if min(n[:k], default=0) <= 0 or (k + 1) * n[k] >= n[0]:
            continue
        rest = (k + 1) * n[k] / n[0]
        d = np.array([((r + 1) * n[r] / (r * n[r - 1]) - rest) / (1 - rest) for r in range(1, k + 1)])
        if (d > 0).all() and (d <= 1).all():
            return d
    return np.zeros(0)


@dataclass(frozen=True)
class Words:
    """What the driver knows of single words: N, V and counts of counts."""

    tokens: int
    distinct: int
    times: tuple

    def probability(self, c: np.ndarray) -> np.ndarray:
        d = discounts(list(self.times))
        factor = np.concatenate([[0.0], d])
        n = float(self.tokens)
        c = c.astype(np.float64)
        left = sum(r * self.times[r - 1] * (1 - d[r - 1]) for r in range(1, len(d) + 1))
        if left <= 0:
            n, left = n + 1, 1.0
        small = c <= len(d)
        out = np.where(small, factor[np.where(small, c, 0).astype(np.int64)], 1.0) * c / n
        return np.where(c > 0, out, left / n)


def chunks_of(docs: DataFrame, fold: int, folds: int) -> DataFrame:
    """Packed chunks: doc ids, held-out flags, tokens a document, codes of tokens, and the chunk's distinct words with their training counts. Words are sorted by hash."""
    schema = "chunk long, docs binary, nulls binary, held binary, lengths binary, codes binary, words binary, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        for part in gathered_slices(batches, "text", CHUNK_BYTES):
            words, lengths = flat_words(pc.ascii_lower(texts_of(part.column("text"))))
            codes, distinct = coded(words)
            # words whose hashes are equal would be one word; END and START are hashes of none
            h = np.concatenate([hashes_of(distinct), [END, START]]).astype(np.uint64)
            order = np.argsort(h)
            place = np.empty(len(h), np.int64)
            place[order] = np.arange(len(h))
            ends = starts_of(lengths + 1)
            stream = np.full(ends[-1], place[len(h) - 2], np.int64)
            body = np.ones(len(stream), bool)
            body[ends[1:] - 1] = False
            stream[body] = place[codes]
            ids = part.column("doc_id").to_pylist()
            held = np.array([zlib.crc32(b"" if d is None else str(d).encode()) % folds == fold for d in ids], bool)
            counts = np.bincount(stream[np.repeat(~held, lengths + 1)], minlength=len(h))
            rows = (np.array([d or 0 for d in ids], np.int64), np.array([d is None for d in ids], bool), held, lengths + 1, stream.astype(np.uint32), h[order], counts.astype(np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *[pa.array([packed(x)], pa.binary()) for x in rows]], names=["chunk", "docs", "nulls", "held", "lengths", "codes", "words", "counts"])
            at += 1

    return store(docs.select("doc_id", "text").mapInArrow(run, schema), "lm-chunks")


def part_of_words(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def word_table(chunks: DataFrame, parts: int) -> tuple[DataFrame, Words]:
    """For each chunk and partition: the training count of each asked word in the whole corpus, and its id. And N, V and counts of counts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h, c = unpacked(batch.column("words")[i].as_py(), np.uint64), unpacked(batch.column("counts")[i].as_py(), np.uint32)
                p = part_of_words(h, parts)
                order = np.argsort(p, kind="stable")
                ends = np.searchsorted(p[order], np.arange(parts + 1))
                some = np.flatnonzero(np.diff(ends))
                cut = [order[ends[k] : ends[k + 1]] for k in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)), pa.array([batch.column("chunk")[i].as_py()] * len(some), pa.int64()), pa.array([packed(h[o]) for o in cut], pa.binary()), pa.array([packed(c[o]) for o in cut], pa.binary())],
                    names=["part", "chunk", "words", "counts"],
                )

    def answer(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        asked = [unpacked(b, np.uint64) for b in t.column("words").to_pylist()]
        given = np.concatenate([unpacked(b, np.uint32) for b in t.column("counts").to_pylist()]).astype(np.int64)
        known, where = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.zeros(len(known), np.int64)
        np.add.at(total, where, given)
        ids = (np.arange(len(known), dtype=np.int64) * parts + part)[where]
        cuts = np.cumsum([len(a) for a in asked])[:-1]
        stats = np.array([total.sum(), (total > 0).sum(), *[(total == r).sum() for r in range(1, TOP + 2)]], np.int64)
        return pa.table(
            {
                "part": t.column("part").cast(pa.int32()),
                "chunk": t.column("chunk"),
                "counts": pa.array([packed(x) for x in np.split(total[where], cuts)], pa.binary()),
                "ids": pa.array([packed(x) for x in np.split(ids, cuts)], pa.binary()),
                "stats": pa.array([stats.tobytes()] + [None] * (len(asked) - 1), pa.binary()),
            }
        )

    asked = chunks.select("chunk", "words", "counts").mapInArrow(ask, "part int, chunk long, words binary, counts binary")
    table = store(asked.groupBy("part").applyInArrow(answer, "part int, chunk long, counts binary, ids binary, stats binary"), "lm-words")
    s = sum((np.frombuffer(r["stats"], np.int64) for r in table.where("stats is not null").select("stats").collect()), np.zeros(TOP + 3, np.int64))
    return table, Words(int(s[0]), int(s[1]), tuple(int(x) for x in s[2:]))


SETTLED = "chunk long, docs binary, nulls binary, held binary, lengths binary, codes binary, start long, counts binary, ids binary"


def settled(chunks: DataFrame, table: DataFrame, word_parts: int) -> DataFrame:
    """Chunks with the count and id of each distinct word in place of its hash, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                h = unpacked(row["words"], np.uint64)
                order = np.argsort(part_of_words(h, word_parts), kind="stable")
                answers = sorted(row["by_part"], key=lambda a: a["part"])
                count, ids = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
                count[order] = np.concatenate([unpacked(a["counts"], np.int64) for a in answers])
                ids[order] = np.concatenate([unpacked(a["ids"], np.int64) for a in answers])
                # the start mark stands before as many words as documents end
                count[np.searchsorted(h, START)] = count[np.searchsorted(h, END)]
                kept = [row[c] for c in ("docs", "nulls", "held", "lengths", "codes")]
                values = [row["chunk"], *kept, int(np.searchsorted(h, START)), packed(count), packed(ids)]
                types = [pa.int64(), *[pa.binary()] * 5, pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=[c.split()[0] for c in SETTLED.split(", ")])

    by_chunk = table.groupBy("chunk").agg(F.collect_list(F.struct("part", "counts", "ids")).alias("by_part"))
    return store(chunks.drop("counts").join(by_chunk, "chunk").mapInArrow(run, SETTLED), "lm-settled", records=1)


class Pairs:
    """The tokens of a settled chunk, and the distinct pairs of each partition, always in the same order."""

    def __init__(self, row: dict, parts: int, hot: float):
        self.count, self.id = unpacked(row["counts"], np.int64), unpacked(row["ids"], np.int64)
        self.docs, self.nulls = unpacked(row["docs"], np.int64), unpacked(row["nulls"], bool)
        self.held, self.lengths = unpacked(row["held"], bool), unpacked(row["lengths"], np.int64)
        self.token = unpacked(row["codes"], np.uint32).astype(np.int64)
        first = starts_of(self.lengths)[:-1]
        history = np.empty_like(self.token)
        history[1:] = self.token[:-1]
        history[first] = row["start"]
        key = (history << 32) | self.token
        pairs, self.of_token = np.unique(key, return_inverse=True)
        self.h, self.w = pairs >> 32, pairs & 0xFFFFFFFF
        self.train = np.bincount(self.of_token[np.repeat(~self.held, self.lengths)], minlength=len(pairs))
        # a history with more than its share of tokens is dealt by the second word too
        share = np.maximum(1, np.ceil(self.count[self.h] / hot)).astype(np.int64)
        self.part = ((self.id[self.h] + (self.id[self.w] % share) * 7919) % parts).astype(np.int64)
        self.order = np.lexsort((self.w, self.h, self.part))
        self.ends = np.searchsorted(self.part[self.order], np.arange(parts + 1))


def pair_table(chunks: DataFrame, words: Words, parts: int, hot: float) -> DataFrame:
    """For each chunk and partition: the count of each asked pair in the whole corpus, and of each asked history its total, its numbers of pairs seen 1 to TOP times, and the probability of the words seen after it."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                x = Pairs(row, parts, hot)
                some = np.flatnonzero(np.diff(x.ends))
                cut = [x.order[x.ends[k] : x.ends[k + 1]] for k in some]
                # the count of a second word matters where its pair was seen, and then some chunk that saw it says it
                fields = [x.id[x.h], x.id[x.w], np.where(x.train > 0, x.count[x.w], 0), x.train.astype(np.uint32)]
                # the histories dealt by the second word too, known by their count in the whole corpus
                dealt = [np.unique(x.id[x.h[o][x.count[x.h[o]] > hot]]) for o in cut]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)), pa.array([row["chunk"]] * len(some), pa.int64()), *[pa.array([packed(f[o].astype(np.uint32) if f.max(initial=0) < 1 << 32 else f[o]) for o in cut], pa.binary()) for f in fields], pa.array([len(o) for o in cut], pa.int64()), pa.array([packed(a) if len(a) else None for a in dealt], pa.binary())],
                    names=["part", "chunk", "h", "w", "cw", "train", "n", "dealt"],
                )

    def wide(blobs: list[bytes]) -> np.ndarray:
        out = []
        for b in blobs:
            out.append(unpacked(b, np.uint32 if b[0] == 4 else np.int64).astype(np.int64))
        return np.concatenate(out)

    def answer(t: pa.Table) -> pa.Table:
        sizes = t.column("n").to_pylist()
        h, w, cw, train = (wide(t.column(c).to_pylist()) for c in ("h", "w", "cw", "train"))
        order = np.lexsort((w, h))
        new = np.ones(len(order), bool)
        hs, ws = h[order], w[order]
        new[1:] = (hs[1:] != hs[:-1]) | (ws[1:] != ws[:-1])
        group = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        total = np.add.reduceat(train[order], begin)
        back = np.empty(len(order), np.int64)
        back[order] = total[group]
        ph, seen = hs[begin], total > 0
        heads, at = np.unique(ph, return_inverse=True)
        columns = [np.bincount(at, total, len(heads))]
        columns += [np.bincount(at[total == r], minlength=len(heads)).astype(float) for r in range(1, TOP + 1)]
        columns.append(np.bincount(at, np.where(seen, words.probability(np.maximum.reduceat(cw[order], begin)), 0.0), len(heads)))
        table = np.stack(columns, axis=1)
        cuts = np.cumsum(sizes)[:-1]
        asked = [np.unique(x) for x in np.split(h, cuts)]
        dealt = [unpacked(b, np.int64) for b in t.column("dealt").to_pylist() if b]
        whole = np.column_stack([heads.astype(float), table])[np.isin(heads, np.concatenate([np.zeros(0, np.int64), *dealt]))]
        stats = np.array([(total == r).sum() for r in range(1, TOP + 2)], np.int64)
        return pa.table(
            {
                "part": t.column("part").cast(pa.int32()),
                "chunk": t.column("chunk"),
                "counts": pa.array([packed(x.astype(np.uint32)) for x in np.split(back, cuts)], pa.binary()),
                "heads": pa.array([packed(a) for a in asked], pa.binary()),
                "sums": pa.array([packed(table[np.searchsorted(heads, a)]) for a in asked], pa.binary()),
                "stats": pa.array([stats.tobytes()] + [None] * (len(sizes) - 1), pa.binary()),
                "whole": pa.array([packed(whole)] + [None] * (len(sizes) - 1), pa.binary()),
            }
        )

    asked = chunks.mapInArrow(ask, "part int, chunk long, h binary, w binary, cw binary, train binary, n long, dealt binary")
    return store(asked.groupBy("part").applyInArrow(answer, "part int, chunk long, counts binary, heads binary, sums binary, stats binary, whole binary"), "lm-pairs")


def pair_scores(seen: np.ndarray, sums: np.ndarray, p_word: np.ndarray, d: np.ndarray) -> np.ndarray:
    """log10 P of pairs, from their counts, their histories' sums and their words' probabilities."""
    total = sums[:, 0]
    taken = sum((r * sums[:, r] * (1 - d[r - 1]) for r in range(1, len(d) + 1)), np.zeros(len(total)))
    none = taken <= 0
    base = np.where(none, total + 1, np.maximum(total, 1))
    left = np.where(none, 1.0, taken) / base
    factor = np.concatenate([[0.0], d])
    small = seen <= len(d)
    direct = np.where(small, factor[np.where(small, seen, 0).astype(np.int64)], 1.0) * seen / base
    backoff = left / np.maximum(1 - sums[:, TOP + 1], 1e-300)
    p = np.where(total == 0, p_word, np.where(seen > 0, direct, backoff * p_word))
    return np.log10(p)


def score(docs: DataFrame, fold: int = 2, folds: int = 7, id_column: str = "doc_id", text: str = "text", least_hot: int = LEAST_HOT) -> DataFrame:
    """Scores of all documents by a model of those outside the fold (crc32 of doc_id, modulo folds, is fold). least_hot: what a history may hold, at least, before it is dealt over partitions."""
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    chunks = chunks_of(docs, fold, folds)
    # entries of a chunk are bounded by its slice of text, so partitions follow the number of chunks
    n = chunks.count()
    word_parts, parts = max(8, n // 2), max(8, 3 * n)
    table, words = word_table(chunks, word_parts)
    hot = max(least_hot, words.tokens / SHARES)
    # written, so that what it is made of can go before the pairs, the largest exchange
    ready = settled(chunks, table, word_parts)
    discard(chunks)
    discard(table)
    pairs = pair_table(ready, words, parts, hot)
    times = sum((np.frombuffer(r["stats"], np.int64) for r in pairs.where("stats is not null").select("stats").collect()), np.zeros(TOP + 1, np.int64))
    d = discounts(times.tolist())
    split: dict[int, np.ndarray] = {}
    for r in pairs.where("whole is not null").select("whole").toLocalIterator():
        for x in unpacked(r["whole"], np.float64).reshape(-1, TOP + 3):
            split[int(x[0])] = split.get(int(x[0]), 0) + x[1:]
    split_ids = np.array(sorted(split), np.int64)
    split_sums = np.array([split[k] for k in split_ids.tolist()]).reshape(-1, TOP + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                x = Pairs(row, parts, hot)
                of_pair = np.empty(len(x.h))
                # one partition's answers after another: the sums of all histories at once would be the largest array here
                for a in row.pop("pair_parts"):
                    o = x.order[x.ends[a["part"]] : x.ends[a["part"] + 1]]
                    own = x.id[x.h[o]]
                    sums = unpacked(a["sums"], np.float64).reshape(-1, TOP + 2)[np.searchsorted(unpacked(a["heads"], np.int64), own)]
                    if len(split_ids):
                        k = np.minimum(np.searchsorted(split_ids, own), len(split_ids) - 1)
                        is_split = split_ids[k] == own
                        sums[is_split] = split_sums[k[is_split]]
                    of_pair[o] = pair_scores(unpacked(a["counts"], np.uint32).astype(np.int64), sums, words.probability(x.count[x.w[o]]), d)
                each = of_pair[x.of_token]
                c = x.count[x.token]
                first = starts_of(x.lengths)[:-1]
                base = np.log10((c + 1) / (words.tokens + words.distinct + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(x.docs, mask=x.nulls),
                        pa.array(x.held),
                        pa.array(x.lengths),
                        pa.array(np.add.reduceat((c > 0).astype(np.int64), first)),
                        pa.array(np.full(len(first), words.tokens, np.int64)),
                        pa.array(np.add.reduceat(base, first)),
                        pa.array(np.add.reduceat(each, first)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    of_pairs = pairs.groupBy("chunk").agg(F.collect_list(F.struct("part", "counts", "heads", "sums")).alias("pair_parts"))
    out = store(ready.join(of_pairs, "chunk").mapInArrow(run, SCORES), "lm-scores", records=1)
    for t in (ready, pairs):
        discard(t)
    return out


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
