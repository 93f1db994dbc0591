"""The folder that driver and executors share, for text and tables that queries write and read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; where that is unset, in a temporary folder, which only a local master can share with its tasks."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: for what several later steps read."""
    path = folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_files(rows: DataFrame, base: str) -> int:
    """Write the ``value`` of each row to a file of its own, ``name`` below base; a task that runs again writes the same files. Returns how many.

    Spark's writers name their own files and make one at a time for each directory; here names matter and a file is a few lines.
    """

    def write(system, path: str, value: str) -> None:
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(path) as out:
            out.write(value.encode())

    return _each(rows.select("name", "value"), base, write)


def remove_files(rows: DataFrame, base: str) -> int:
    """Remove the files that ``write_files`` made of these rows, by the tasks, each with the folder that it is alone in; then what is left of base. A file that is gone already is passed over."""

    def remove(system, path: str, _: str) -> None:
        from pyarrow import fs

        above = path.rsplit("/", 1)[0]
        if system.get_file_info(above).type == fs.FileType.Directory:
            system.delete_dir(above)

    n = _each(rows.select("name", F.lit("").alias("value")), base, remove)
    at = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(base)
    at.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
    return n


def _each(rows: DataFrame, base: str, act) -> int:
    """act(file system, path, value) for each row's name below base, in the tasks. Returns how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(base)
        n = 0
        for b in batches:
            for name, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                act(system, f"{root}/{name}", value)
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
