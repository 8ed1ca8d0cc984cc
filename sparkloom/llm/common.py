"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regular expression of one word of the contracts that split at ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"

#: Most labelled rows that a classifier or threshold search is fitted on.
MAX_LABELLED = 20_000

#: Bytes table: A-Z lower-cased, other ASCII but digits and letters to a space, the rest kept.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32
    for c in range(256)
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoints(spark: SparkSession) -> None:
    """Uses the cluster's shared checkpoint folder; sets one only where none is.

    Then it lies in the warehouse, which all executors share, or, where driver and executors are one
    process, in a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = tempfile.mkdtemp(prefix="ckpt") if sc.master.startswith("local[") or sc.master == "local" else f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder, and read again; Spark then knows its size."""
    spark = df.sparkSession
    ensure_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a written table that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most so many rows in a batch that goes to Python, for what is run within; bounds a worker that gets texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fold_of(key, n: int):
    """crc32 of the key's text, modulo n."""
    return F.crc32(key.cast("string")) % n


def labelled_ids(labels: DataFrame, label: str, train, max_rows: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, label) of at most max_rows labelled rows, chosen by a hash of doc_id; one row an id.

    train: condition on doc_id that training rows meet. Rows with a null id or label are left out;
    an id labelled more than once takes its highest label.
    """
    rows = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & train(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def with_labels(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text, label) of the labelled documents; ids has at most MAX_LABELLED rows, so it is broadcast."""
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def isotonic(scored: DataFrame) -> tuple[list[float], list[float]]:
    """Knots (score, probability) of the isotonic fit of ``label`` on ``score``; scored has a bounded sample's rows.

    Equal scores are summed to one weighted point first, so no task gets all rows of a common score.
    """
    from pyspark.ml.regression import IsotonicRegression

    points = scored.groupBy(F.col("score").cast("double").alias("score")).agg(F.avg(F.col("label").cast("double")).alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    if points.isEmpty():
        return [0.0, 1.0], [0.0, 1.0]
    fit = IsotonicRegression(featuresCol="score", labelCol="label", weightCol="weight").fit(points)
    return [float(x) for x in fit.boundaries.toArray()], [float(x) for x in fit.predictions.toArray()]
