"""Counts of style: frequent terms, sentence lengths, punctuation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frequent_terms(rows: DataFrame, group: str, text: str, least: int = 3) -> DataFrame:
    """(group, term, n) of lower-cased words that occur at least ``least`` times; counted before the shuffle."""
    terms = rows.select(group, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[^\s\p{Punct}]+"), F.lit(0))).alias("term"))
    return terms.groupBy(group, "term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def sentence_bucket(n: Column) -> Column:
    return F.when(n < 15, "short").when(n <= 40, "medium").otherwise("long")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[.!?。！？\n]+"), lambda s: F.trim(s)), lambda s: s != "")


def rate(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))
