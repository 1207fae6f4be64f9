"""Session helpers that the operators share: where written intermediates go, and how tables are read."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint folder. Set only where it is unset, as in local tests."""
    ctx = spark.sparkContext
    found = ctx._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not ctx.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-checkpoint-")
    ctx.setCheckpointDir(path)
    return ctx._jsc.sc().getCheckpointDir().get()


@contextmanager
def settings(spark: SparkSession, records: int = 1000):
    """Settings of a write that ends a lineage: what it shuffled is of no more use, and may be as large as the input; and Arrow batches of so many rows at most, as texts may be long."""
    wanted = {
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(min(records, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))),
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def store(df: DataFrame, name: str, partition_by: list[str] | None = None, records: int = 1000) -> DataFrame:
    """Writes df as Parquet into the shared folder and returns a reader of it: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with settings(spark, records):
        writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what store() wrote, once nothing reads it any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """rows dealt by a hash of `by` over some tasks a core, for work that is long by row: a small file is one split, and would be one task's work. Spark does not join these tasks again. Sorted by `by` as well, rows that are alike follow each other, and what holds for one is at hand for the next."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)
