"""Reading tables of a directory of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def even_tasks(spark: SparkSession) -> int:
    """Three times as many tasks as there are cores, or as many as shuffles have."""
    return max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt evenly to three times as many tasks as there are cores, or to as many as shuffles have.

    For rows of few bytes that take long, which Spark, that plans tasks by bytes, gives to a few tasks.
    """
    return rows.repartition(even_tasks(rows.sparkSession))
