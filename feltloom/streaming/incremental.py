"""Restartable, incremental replay: new files of hands become decisions and participant rows, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feltloom.operators import ledger
from feltloom.sources.parse import HANDS

TABLES = {"decisions": ledger.decisions, "hand_player": ledger.hand_player}
MANIFEST = "batch long, decisions string, hand_player string"


def _manifest(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{out}/commits")


def run(spark: SparkSession, source: str, out: str, state: str) -> None:
    """Take the files of ``source`` that ``state`` has not seen, and stop. A hand is one row, so no state is kept between batches.

    A batch is committed as one: its tables are written to folders named by its number, overwriting what a broken attempt may have left, and its line of the manifest comes
    last. ``read`` takes the batches of the manifest only. A batch that is committed but not yet ticked off in ``state`` is left as it is when it comes again.
    """
    spark.createDataFrame([], MANIFEST).write.mode("append").json(f"{out}/commits")

    def write(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        if not _manifest(own, out).where(F.col("batch") == number).isEmpty():
            return
        played = f"{out}/played/batch={number}"
        ledger.settled(ledger.replayed(batch)).write.mode("overwrite").parquet(played)
        done = own.read.parquet(played)
        paths = {name: f"{out}/{name}/batch={number}" for name in TABLES}
        for name, rows in TABLES.items():
            rows(done).write.mode("overwrite").option("compression", "zstd").parquet(paths[name])
        own.createDataFrame([(number, *paths.values())], MANIFEST).coalesce(1).write.mode("append").json(f"{out}/commits")

    stream = spark.readStream.schema(HANDS).option("maxFilesPerTrigger", 1000).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def read(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The rows of all committed batches, with their batch's number. The list of batches, a path each, reaches the driver, as any list of folders does."""
    paths = [r[0] for r in _manifest(spark, out).orderBy("batch").select(name).collect()]
    if not paths:
        none = spark.createDataFrame([], HANDS)
        return TABLES[name](ledger.settled(ledger.replayed(none))).withColumn("batch", F.lit(None).cast("int"))
    return spark.read.option("basePath", f"{out}/{name}").parquet(*paths)
