"""Corpus pipeline: toxicity, near-duplicates, decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and works on every document its predecessor kept. All but the
last return the columns of documents. Stages are written as Parquet in the cluster's shared folder and
read again, so a lost executor costs at most one stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, minhash, mixing, secrets
from sparkloom.llm import toxicity as toxic
from sparkloom.llm.common import ensure_checkpoints, fold_of, read, remove


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents scored 0.5 or more; the score is learned from labels outside the held-out fold.

    Null and empty texts are scored like others and clean by their features; repeated rows go or stay
    together; other columns, whatever their names, come through. No rows in, none out.
    """
    scored = toxic.toxicity(docs.withColumn("__row", F.struct("*")), read(spark, sf_dir, "labels"), train=lambda k: fold_of(k, 5) != 0)
    return scored.where("score < 0.5").select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each near-duplicate group.

    Texts without words are in no group; rows that repeat an id are one document, so all of them go or
    stay; rows with a null id stay. Other columns come through. No rows in, none out.
    """
    return minhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more of the words stand in benchmark windows, and removes such
    words from the others, whose n_chars follows.

    Null and empty texts stay as they are; repeated rows are judged alike, each on its own. Other columns,
    whatever their names, come through. No rows in, none out.
    """
    return decontaminate.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret in the text by its kind, and n_chars follows; every document stays.

    Null texts stay null; repeated rows are redacted alike. Other columns, whatever their names, come
    through. No rows in, none out.
    """
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix takes, with size, source_size, target, copies and copy added.

    A column of docs that has one of these names keeps its values, and the added one is left out. Null
    sources are a source of their own; null and empty texts have size 0; repeated rows are sampled each
    on its own, alike in every run. No rows in, none out.
    """
    own = [c for c in docs.columns if c in ("size", "source_size", "target", "copies", "copy")]
    mixed = mixing.emit(mixing.mix(docs.withColumnsRenamed({c: f"__own_{c}" for c in own})))
    return mixed.drop(*own).withColumnsRenamed({f"__own_{c}": c for c in own})


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
]

#: The fitted scores and signatures of the first two stages have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another. A stage's folder is removed once the next one's is written."""
    ensure_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            here = f"{folder}/{k}-{name}"
            docs.write.parquet(here)
            docs = spark.read.parquet(here)
            if before:
                remove(spark, before)
            before = here
    return docs
