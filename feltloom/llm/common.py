"""What the text operators share: tables, the shared scratch folder and batch helpers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that a Python worker holds at once, whatever the size of the Arrow batches it gets.
SLICE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_passing: ContextVar[str | None] = ContextVar("passing", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a temporary one, which only a local master can share with its tasks.

    Within ``passing_tables`` it is that block's own folder below it.
    """
    if inner := _passing.get():
        return inner
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, *, partition_by: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """df written as Parquet into the shared folder, or to path, and read again: lineage ends there, and a lost executor costs a re-read only."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("error").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Remove a folder of whatever store Spark's path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[str]:
    """Tables written in this block go into a folder of their own, which is removed at its end, also after an error.

    Gives the folder outside of it. What the block computes has to be written there before it ends: nothing can be read of the block's tables later.
    """
    outer = shared_dir(spark)
    path = f"{outer}/passing-{uuid.uuid4().hex}"
    token = _passing.set(path)
    try:
        yield outer
    finally:
        _passing.reset(token)
        drop(spark, path)


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most this many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def bounded_sample(rows: DataFrame, by: str, key: str, most: int, seed: int, tie: str | None = None) -> DataFrame:
    """Up to ``most`` rows of each group, the first by a hash of key: the same in every run.

    A hash threshold for each group, a third above what is needed, leaves few rows before any are put in order, so
    that no group meets in one task as a whole. Rows of one key are told apart by a hash of ``tie``.
    """
    sizes = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).collect()
    if not sizes:
        return rows.where(F.lit(False))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r[by], min(1.0, (1.3 * most + 50) / r.n))])
    few = rows.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < F.coalesce(F.try_element_at(share, F.col(by)), F.lit(0.0)) * (1 << 30))
    order = W.partitionBy(by).orderBy(F.xxhash64(key, F.lit(seed)), key, *([F.xxhash64(tie)] if tie else []))
    return few.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).drop("_k")


_shipped: set[str] = set()


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow, on executors that have been sent this package, whether or not it is installed there."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent.parent
        path = Path(tempfile.mkdtemp(prefix="spark-package-")) / "package.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in (package / "__init__.py", *sorted((package / "llm").glob("*.py"))):
                z.write(f, f.relative_to(package.parent))
        context.addPyFile(str(path))
        _shipped.add(context.applicationId)
    return df.mapInArrow(run, schema)
