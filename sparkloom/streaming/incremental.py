"""Exports that keep arriving: counts and sections that grow batch by batch.

Each batch is reduced and written under its own id, so a batch that runs again after a failure replaces
itself. Reading adds up what the batches wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.classify import message_tier


def stream_table(spark: SparkSession, directory: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream over a table's Parquet files, present and to come. The path is a glob, so a table may be one file."""
    schema = spark.read.parquet(f"{directory}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{directory}/{name}.parque[t]")


def run_batches(stream: DataFrame, folder: str, reduce: Callable[[DataFrame], DataFrame]) -> str:
    """Runs all that is there now; returns the folder of the batches' rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        reduce(batch).write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return f"{folder}/rows"


def tier_counts(stream: DataFrame, folder: str, content: str = "content") -> DataFrame:
    """(role, tier, n) over all batches so far."""
    rows = run_batches(stream, folder, lambda b: b.groupBy("role", message_tier(F.col(content)).alias("tier")).agg(F.count(F.lit(1)).alias("n")))
    return stream.sparkSession.read.parquet(rows).groupBy("role", "tier").agg(F.sum("n").alias("n"))


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """A stream of (window, key, n); rows later than ``late`` are left out once their window has closed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))
