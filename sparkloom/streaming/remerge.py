"""Records that patches and corrections keep arriving for: the current text, its version, and every version before.

Each batch folds its updates into the records they are for and writes those records alone, under the batch's id,
together with the versions they leave behind. What a batch reads are the folders of earlier batches, so one that
runs again after a failure finds what it found before and replaces what it wrote: a version is archived once.
Updates carry a number that grows within a record; those that aren't beyond the record's last are passed over, so
a file that arrives again changes nothing. Every ``COMPACT`` batches all current records are written together, and
later batches read from there. Folders are dealt by a hash of the record, of which a batch opens those it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import or_empty
from ..operators.records import apply_corrections, merge_patch, next_version
from ..sources.tables import even_tasks

BUCKETS = 64
COMPACT = 16
_VERSION = "version string, seq bigint, work string, persona string, corrections bigint"
SCHEMA = f"record string, {_VERSION}, archived array<struct<version:string,seq:bigint,work:string,persona:string,corrections:bigint>>, bucket int"
FIELDS = ("version", "seq", "work", "persona", "corrections")


def _updated(state: Column, u: Column) -> Column:
    """A record's state after one update; the state before is archived."""
    fixes = F.coalesce(u["fixes"], F.array().cast("array<struct<scene:string,wrong:string,correct:string>>"))
    patched = or_empty(u["persona_patch"]) != ""
    persona = F.when(patched, merge_patch(state["persona"], u["persona_patch"])).otherwise(apply_corrections(state["persona"], fixes))
    before = F.struct(*[state[f].alias(f) for f in FIELDS])
    return F.struct(
        next_version(state["version"]).alias("version"), u["seq"].alias("seq"), merge_patch(state["work"], u["work_patch"]).alias("work"), persona.alias("persona"),
        (state["corrections"] + F.when(patched, 0).otherwise(F.size(fixes))).cast("long").alias("corrections"), F.array_append(state["archived"], before).alias("archived"),
    )


def folded(updates: DataFrame, current: DataFrame) -> DataFrame:
    """(record, version, seq, work, persona, corrections, archived) of the records that updates change.

    updates: (record, seq, work_patch, persona_patch, fixes), fixes an array of (scene, wrong, correct); each is one
    version, and where it has a persona patch its corrections don't count. current: (record, version, seq, work,
    persona, corrections). A record's first update ever holds its texts and makes v1. Updates that repeat a number
    count once; those without a record or number are left out.
    """
    known = updates.where("record IS NOT NULL AND seq IS NOT NULL").dropDuplicates(["record", "seq"])
    each = known.groupBy("record").agg(F.array_sort(F.collect_list(F.struct("seq", "work_patch", "persona_patch", "fixes"))).alias("u"))
    both = each.join(current.select("record", F.struct(*FIELDS).alias("now")), "record", "left")
    fresh = both.withColumn("u", F.filter("u", lambda u: F.coalesce(u["seq"] > F.col("now.seq"), F.lit(True)))).where(F.size("u") > 0)
    one, none = F.get("u", F.lit(0)), F.array().cast(f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in _VERSION.split(', '))}>>")
    made = F.struct(F.lit("v1").alias("version"), one["seq"].alias("seq"), or_empty(one["work_patch"]).alias("work"), or_empty(one["persona_patch"]).alias("persona"), F.lit(0).cast("long").alias("corrections"))
    fresh = fresh.select("record", F.coalesce("now", made).alias("now"), F.when(F.col("now").isNull(), F.slice("u", 2, F.size("u"))).otherwise(F.col("u")).alias("u"))
    start = F.struct(*[F.col(f"now.{f}").alias(f) for f in FIELDS], none.alias("archived"))
    return fresh.select("record", F.aggregate("u", start, _updated).alias("s")).select("record", "s.*")


def _read(spark: SparkSession, folder: str, first: int, end: int) -> DataFrame:
    """Rows that the batches from first up to end have written."""
    rows = spark.read.schema(SCHEMA + ", batch int").parquet(f"{folder}/records")
    return rows.where((F.col("batch") >= first) & (F.col("batch") < end))


def current_records(spark: SparkSession, folder: str, end: int, compact: int = COMPACT, buckets: list[int] | None = None) -> DataFrame:
    """(record, version, seq, work, persona, corrections) after the batches before end."""
    whole = end // compact * compact - 1  # the last batch that wrote all records
    if not end:
        return spark.createDataFrame([], f"record string, {_VERSION}")
    rows = _read(spark, folder, whole + 1, end).select("record", *FIELDS, "batch", "bucket")
    if whole >= 0:
        rows = rows.unionByName(spark.read.schema(SCHEMA).parquet(f"{folder}/whole/batch={whole}").select("record", *FIELDS, F.lit(whole).alias("batch"), "bucket"))
    rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
    return rows.groupBy("record").agg(F.max_by(F.struct(*FIELDS), "batch").alias("s")).select("record", "s.*")


def archived_versions(spark: SparkSession, folder: str) -> DataFrame:
    """(record, version, seq, work, persona, corrections): every version that a later one took the place of."""
    return spark.read.schema(SCHEMA + ", batch int").parquet(f"{folder}/records").select("record", F.explode("archived").alias("a")).select("record", "a.*")


def dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """rows with a bucket, each bucket's in as many parts as keep all cores busy, so that few buckets aren't few tasks; small parts are put together."""
    return rows.repartition("bucket", F.pmod(F.hash("record"), F.lit(-(-even_tasks(rows.sparkSession) // buckets))))


def remerge_batch(batch: DataFrame, batch_id: int, folder: str, compact: int = COMPACT, buckets: int = BUCKETS) -> None:
    """Folds one batch into the records; running it again leaves the same files."""
    spark, bucket = batch.sparkSession, F.pmod(F.xxhash64("record"), F.lit(buckets)).cast("int")
    needed = sorted(r[0] for r in batch.where("record IS NOT NULL").select(bucket).distinct().collect())  # at most so many buckets
    changed = folded(batch, current_records(spark, folder, batch_id, compact, needed)).withColumn("bucket", bucket)
    dealt(changed, buckets).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/records/batch={batch_id}")
    if batch_id % compact == compact - 1:
        spark.catalog.refreshByPath(f"{folder}/records")
        rows = _read(spark, folder, batch_id, batch_id + 1).select("record", *FIELDS, F.lit(1).alias("late"))
        rows = rows.unionByName(current_records(spark, folder, batch_id, compact).withColumn("late", F.lit(0)))
        rows = rows.groupBy("record").agg(F.max_by(F.struct(*FIELDS), "late").alias("s")).select("record", "s.*")
        none = F.array().cast("array<struct<version:string,seq:bigint,work:string,persona:string,corrections:bigint>>")
        dealt(rows.withColumns({"archived": none, "bucket": bucket}), buckets).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/whole/batch={batch_id}")


def remerge(stream: DataFrame, folder: str, compact: int = COMPACT, buckets: int = BUCKETS) -> int:
    """Folds all that has arrived in the stream; returns the number of batches so far, which current_records() takes.

    A folder keeps the numbers of buckets and of batches between compactions that it was begun with.
    """
    spark = stream.sparkSession
    done = stream.writeStream.foreachBatch(lambda batch, k: remerge_batch(batch, k, folder, compact, buckets))
    done.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.schema(SCHEMA + ", batch int").parquet(f"{folder}/records").agg(F.max("batch")).first()[0]
    return 0 if last is None else last + 1
