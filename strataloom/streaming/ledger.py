"""Streams with exactly-once effects: a ledger that keeps each key once, windows under a watermark, commits by version.

Checkpoints and results lie in folders that all executors share. A micro-batch that is run again after a loss writes the same
folder again, so nothing is doubled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.runtime import ship


def stream(spark: SparkSession, root: str, name: str, schema: T.StructType, files: int = 1) -> DataFrame:
    """One input table as a stream of its files."""
    ship(spark)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", f"{name}.parquet").option("recursiveFileLookup", "false").parquet(root)


def append_once(source: DataFrame, out: str, key: list[str], time: str | None = None, late: str = "7 days") -> None:
    """Append the first row of each key to ``out/rows``; ends when the input is read.

    Which of several rows of a key is first within a micro-batch isn't defined; that exactly one stays is. With ``time``, keys are
    forgotten once the watermark has passed them by ``late``, which bounds the state; without, every key is held, which a stream without end can't afford.
    """
    once = source.withWatermark(time, late).dropDuplicatesWithinWatermark(key) if time else source.dropDuplicates(key)
    once.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()


def windowed(source: DataFrame, out: str, time: str, width: str, late: str, by: list[str], *aggregates: Column) -> None:
    """Aggregates of time windows in ``out/rows``; every finished micro-batch replaces the totals so far."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows")

    grouped = source.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(*aggregates)
    grouped.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/state").outputMode("complete").trigger(availableNow=True).start().awaitTermination()


def committed(changes: DataFrame, key: str, version: str, expected: str, token: str) -> DataFrame:
    """State after a set of changes with optimistic versions: of each key, the chain of changes each expecting the version before.

    A change sent twice (same token) counts once; a change that expects a version that never was, or lost the race for it, is refused.
    Changes of a key are settled by their versions: the first token (by text) of those that expect a version wins it.
    """
    from pyspark.sql import Window

    once = changes.dropDuplicates([key, token])
    race = Window.partitionBy(key, expected).orderBy(token)
    won = once.withColumn("_r", F.row_number().over(race)).where("_r = 1").drop("_r")
    order = Window.partitionBy(key).orderBy(expected)
    place = won.withColumn("_i", F.row_number().over(order) - 1)
    return place.where(F.col(expected) == F.col("_i")).withColumn(version, F.col(expected) + 1).drop("_i")
