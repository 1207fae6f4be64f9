"""Whitening of embeddings by a covariance that is computed in tiles.

1. vectors are scaled to whole numbers, x = floor(scale * c); the fit list holds each distinct x once.
2. tasks cut the fit list into row-blocks, and each of those into blocks of `tile` columns; exact sums give the mean.
3. every pair of column blocks (i <= j) is a tile key. A column block goes to the tiles of its group of row-blocks that it
   takes part in; there the two centred blocks of each row-block are multiplied and summed. Products are summed per tile over
   all groups, combined before they are shuffled.
4. the tiles are put together to a symmetric matrix of width x width (the driver holds that and no rows) and decomposed.

The driver sees the sums, the tiles and a few totals: their number follows the vectors' width and not their number.

Rows whose vector is null or holds null, NaN or infinite entries are left out, as are vectors that are not as wide as most (of
equally frequent widths the widest counts). Repeated rows all get their rows of output; one distinct vector alone, or a
component without spread, has a null whitened value. Without any vector there is no output. Null ids are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidespan.session import discard, store

ROWS, TILE = 1024, 32
#: Row-blocks' worth of vectors whose products are summed at once.
TOGETHER = 4
#: A component whose share of the variance is below this has no spread.
NO_SPREAD = 1e-13

COLUMN_BLOCKS = "row_block long, col int, n int, x binary"
TILES = "ti int, tj int, entries array<double>"


@dataclass
class Whitening:
    """n vectors of the fit list with their sums per dimension; eigenvalues falling, with a row of components each; the trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def scaled(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, x) of the rows that count, written."""
    whole = F.forall(F.col(column), lambda e: e.isNotNull() & (F.abs(e.cast("double")) < float("inf")))
    x = F.transform(F.col(column), lambda e: F.floor(scale * e.cast("double")))
    rows = store(vectors.where(F.col(column).isNotNull() & whole).select(F.col(id_column).alias("vec_id"), x.alias("x")), "scaled-vectors")
    widths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    out = rows.where(F.size("x") == (widths["d"] if widths else 0)).where("size(x) > 0")
    out._stored_at = rows._stored_at
    return out


def matrix(column: pa.Array) -> np.ndarray:
    """A batch of arrays of one width, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def column_blocks(rows: DataFrame, size: int, tile: int) -> DataFrame:
    """The distinct vectors in row-blocks of at most `size`, cut into blocks of columns, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                x = matrix(batch.column("x").slice(at, size))
                cols = range(-(-x.shape[1] // tile))
                cut = [np.ascontiguousarray(x[:, c * tile : (c + 1) * tile]).tobytes() for c in cols]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(cut), pa.int64()), pa.array(cols, pa.int32()), pa.array([len(x)] * len(cut), pa.int32()), pa.array(cut, pa.binary())],
                    names=["row_block", "col", "n", "x"],
                )
                number += 1

    return store(rows.select("x").distinct().mapInArrow(run, COLUMN_BLOCKS), "column-blocks", records=size)


def ints(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, np.int64).reshape(n, -1)


def exact_sums(blocks: DataFrame, tile: int) -> tuple[int, list[int]]:
    """The number of vectors and the sums per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x = ints(r["x"], r["n"])
                # high and low halves apart, so that no sum of a block overflows
                total = [int(a) * (1 << 31) + int(b) for a, b in zip((x >> 31).sum(axis=0), (x & 0x7FFFFFFF).sum(axis=0), strict=True)]
                dims = range(r["col"] * tile, r["col"] * tile + len(total))
                yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array([r["n"]] * len(total), pa.int64()), pa.array([str(s) for s in total])], names=["dim", "n", "s"])

    parts = blocks.mapInArrow(run, "dim int, n long, s string")
    rows = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("dim").collect()
    return (rows[0]["n"] if rows else 0), [int(r["s"]) for r in rows]


def covariance(blocks: DataFrame, n: int, sums: list[int], tile: int, size: int = ROWS) -> np.ndarray:
    """The covariance, divisor n, of the vectors in blocks. Row-blocks are put into as many groups as n asks for, however many there are: a group and a tile key are one product."""
    d = len(sums)
    cols = -(-d // tile)
    mean = np.array([s / n for s in sums])

    def multiply(t: pa.Table) -> pa.Table:
        ti, tj = t.column("ti")[0].as_py(), t.column("tj")[0].as_py()
        waiting: dict[int, np.ndarray] = {}
        total = 0.0
        for block, col, rows, x in zip(*(t.column(c).to_pylist() for c in ("row_block", "col", "n", "x")), strict=True):
            part = ints(x, rows) - mean[col * tile : (col + 1) * tile]
            if ti == tj:
                total = total + part.T @ part
            elif block in waiting:
                other = waiting.pop(block)
                total = total + (part.T @ other if col == ti else other.T @ part)
            else:
                waiting[block] = part
        return pa.table({"ti": pa.array([ti], pa.int32()), "tj": pa.array([tj], pa.int32()), "entries": pa.array([total.ravel().tolist()], pa.list_(pa.float64()))})

    group = F.pmod(F.xxhash64("row_block"), F.lit(max(1, -(-n // (TOGETHER * size)))))
    keyed = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("other"), group.alias("group")).withColumns({"ti": F.least("col", "other"), "tj": F.greatest("col", "other")})
    products = keyed.drop("other").groupBy("group", "ti", "tj").applyInArrow(multiply, TILES)
    summed = products.select("ti", "tj", F.posexplode("entries").alias("pos", "v")).groupBy("ti", "tj", "pos").agg(F.sum("v").alias("v"))
    out = np.zeros((d, d))
    # as many rows as tiles, each of tile x tile numbers
    for r in summed.groupBy("ti", "tj").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("entries")).collect():
        a, b = r["ti"] * tile, r["tj"] * tile
        part = np.array([e["v"] for e in r["entries"]]).reshape(min(tile, d - a), -1)
        out[a : a + part.shape[0], b : b + part.shape[1]] = part
        out[b : b + part.shape[1], a : a + part.shape[0]] = part.T
    return out / n


def fit(blocks: DataFrame, tile: int = TILE, size: int = ROWS) -> Whitening | None:
    """The whitening of the vectors in blocks; None if there are none."""
    n, sums = exact_sums(blocks, tile)
    if not n:
        return None
    cov = covariance(blocks, n, sums, tile, size)
    values, vectors = np.linalg.eigh(cov)
    return Whitening(n, sums, values[::-1].copy(), vectors.T[::-1].copy(), float(np.trace(cov)))


def projected(w: Whitening, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k components over the root of their eigenvalue, and which of them have spread."""
    spread = w.values[:k] > max(w.trace, 0) * NO_SPREAD
    return w.components[:k] / np.sqrt(np.where(spread, w.values[:k], 1.0))[:, None], spread


def identity_error(blocks: DataFrame, w: Whitening, k: int) -> float:
    """How far the covariance of the first k whitened components over the fit list is from the identity."""
    directions, spread = projected(w, k)
    mean = w.mean

    def project(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["col"])
        y = (np.concatenate([ints(r["x"], r["n"]) for r in rows], axis=1) - mean) @ directions.T
        totals = np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])
        return pa.table({"v": pa.array([totals.tolist()], pa.list_(pa.float64()))})

    if not spread.any():
        return 0.0
    sums = blocks.groupBy("row_block").applyInArrow(project, "v array<double>").select(F.posexplode("v").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("v"))
    v = np.array([r["v"] for r in sums.orderBy("pos").collect()])
    m = v[: len(directions)] / w.n
    cov = v[len(directions) :].reshape(len(directions), -1) / w.n - np.outer(m, m)
    return float(np.abs((cov - np.eye(len(directions)))[spread][:, spread]).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n * x - S)^2, exact; None beyond a long."""
    bound = (int(np.abs(x).max(initial=0)) * n + max(map(abs, sums))) ** 2 * len(sums)
    if bound < 1 << 62:
        return (((x * n - np.array(sums, np.int64)) ** 2).sum(axis=1)).tolist()
    each = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [e if e < 1 << 63 else None for e in each]


def whitened(rows: DataFrame, w: Whitening, k: int, id_type: str = "long") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained): a row for each vector and component."""
    k = min(k, len(w.sums))
    directions, spread = projected(w, k)
    mean, n, sums = w.mean, w.n, w.sums
    share = (w.values[:k] / w.trace).tolist() if w.trace > 0 else [None] * k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = matrix(part.column("x"))
                y = (x - mean) @ directions.T
                each = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(each), n, np.int64)),
                        pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(each)),
                        pa.array(y.ravel(), mask=np.tile(~spread, len(x))),
                        pa.array(share * len(x), pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained"],
                )

    return rows.mapInArrow(run, f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double")


def whiten(vectors: DataFrame, k: int = 4, id_column: str = "vec_id", column: str = "embedding", scale: int = 256, size: int = ROWS, tile: int = TILE) -> DataFrame:
    """The first k whitened components of every vector, with identity_error."""
    rows = scaled(vectors, id_column, column, scale)
    blocks = column_blocks(rows, size, tile)
    w = fit(blocks, tile, size)
    id_type = dict(rows.dtypes)["vec_id"]
    if w is None:
        return vectors.sparkSession.createDataFrame([], f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(blocks, w, min(k, len(w.sums)))
    discard(blocks)
    return whitened(rows, w, k, id_type).withColumn("identity_error", F.lit(error))


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
