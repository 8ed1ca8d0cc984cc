"""Metrics over research notes: sections, bullets, URLs, weights, tracks and findings.

Notes are rows of (corpus, file, i, line). A section is carried forward within its file by a window over
the file's lines, so work is dealt by file and nothing is sorted globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_ws

#: Section names, lower-cased.
FINDINGS = ("evidence", "key findings", "paraphrased findings", "patterns and repeated themes")
CONTRADICTIONS = ("contradictions",)
INFERENCES = ("inferences", "inferences (clearly marked as inference, not fact)", "inferences (clearly marked)")
GAPS = ("gaps and missing information", "gaps", "missing information")
PATTERNS = "patterns and repeated themes"
METADATA = "source metadata"
TRACKS = ("01", "02", "03", "04", "05", "06")
#: Patterns of URLs, clock times and markers of primary sources.
URL = r"https?://[^\s)]+"
CLOCK = r"\b\d{2}:\d{2}:\d{2}(?:[.,]\d{1,3})?\b"
PRIMARY = r"(?i)\b(first-person|primary source)\b"
PRIMARY_FLAG = r"(?i)first-person|primary source|一手|原始"


def with_sections(lines: DataFrame) -> DataFrame:
    """lines with ``stripped``, ``heading`` (null but on heading lines) and ``section`` (empty before the first)."""
    stripped = strip_ws(F.col("line"))
    heading = F.when(stripped.rlike(r"^##\s+.+$"), F.lower(strip_ws(F.regexp_extract(stripped, r"^##\s+(.+)$", 1))))
    out = lines.withColumns({"stripped": stripped, "heading": heading})
    carried = F.last("heading", ignorenulls=True).over(Window.partitionBy("corpus", "file").orderBy("i"))
    return out.withColumn("section", F.coalesce(carried, F.lit("")))


def begins_with_any(x: Column, names) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | x.startswith(n)
    return out


def is_bullet() -> Column:
    return F.col("heading").isNull() & F.col("stripped").startswith("- ")


def section_counts() -> dict[str, Column]:
    """Aggregates over with_sections(); inferences and gaps go by the section's beginning."""
    s, n = F.col("section"), lambda c: F.count_if(c)
    bullet = is_bullet()
    contra = bullet & s.isin(*CONTRADICTIONS)
    infer = bullet & ~s.isin(*CONTRADICTIONS) & begins_with_any(s, INFERENCES)
    pattern = bullet & (s == PATTERNS)
    gap = bullet & ~s.isin(*CONTRADICTIONS, PATTERNS) & ~begins_with_any(s, INFERENCES) & begins_with_any(s, GAPS)
    return {"source_metadata_blocks": n(F.col("heading") == METADATA), "contradiction_bullets": n(contra), "inference_bullets": n(infer), "pattern_bullets": n(pattern), "gap_bullets": n(gap)}


def is_long_quote(line: Column, words: int = 25) -> Column:
    """A quoted line, one with a clock time, or one with a quote mark and over ``words`` words."""
    s = strip_ws(line)
    return F.when(s == "", False).when(s.startswith(">") | s.rlike(CLOCK), True).otherwise(s.rlike("[\"“”']") & (F.size(F.split(s, r"\s+")) > words))


def urls_of(line: Column, pattern: str = URL) -> Column:
    return F.regexp_extract_all(line, F.lit(pattern), F.lit(0))


def weights_of(line: Column) -> Column:
    found = F.regexp_extract_all(line, F.lit(r"(?i)source weight:\s*(\d)"), F.lit(1))
    return F.filter(F.transform(found, lambda w: w.cast("int")), lambda w: w.between(1, 7))


def track_of(file: Column) -> Column:
    return F.nullif(F.regexp_extract(file, r"^(\d{2})[-_]", 1), F.lit(""))


def tier_columns(weights: Column) -> dict[str, Column]:
    n = lambda low, high: F.size(F.filter(weights, lambda w: w.between(low, high)))
    return {"high": n(1, 3), "mid": n(4, 5), "low": n(6, 7)}


def primary_ratio(high: Column, total: Column) -> Column:
    """Percentage, halves to even; null without weights."""
    return F.when(total > 0, F.bround(100.0 * high / total, 0).cast("long"))


def key_findings(sectioned: DataFrame, per_file: int = 2, most: int = 10) -> DataFrame:
    """(corpus, place, file, finding): the first findings of each file, then the corpus's first in file order."""
    rows = sectioned.where(is_bullet() & F.col("section").isin(*FINDINGS))
    rows = rows.select("corpus", "file", "i", strip_ws(F.expr("substr(stripped, 3)")).alias("finding"))
    first = F.row_number().over(Window.partitionBy("corpus", "file").orderBy("i"))
    rows = rows.withColumn("k", first).where(F.col("k") <= per_file)
    place = F.row_number().over(Window.partitionBy("corpus").orderBy("file", "i"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("corpus", "place", "file", "finding")


def corpus_metrics(lines: DataFrame) -> DataFrame:
    """One row per corpus. Lines are first reduced to a row per file, then to one per corpus.

    Distinct URLs are counted over (corpus, URL) rows, so no corpus's URLs meet in one value.
    """
    rows = with_sections(lines)
    seen = lines.select("corpus", F.explode(urls_of(F.col("line"))).alias("url"))
    seen = seen.groupBy("corpus", "url").agg(F.count(F.lit(1)).alias("n")).groupBy("corpus").agg(F.sum("n").alias("url_mentions"), F.count(F.lit(1)).alias("unique_urls"))
    tiers = {t: F.sum(n) for t, n in tier_columns(weights_of(F.col("line"))).items()}
    per_file = rows.groupBy("corpus", "file").agg(
        F.sum(F.length("line") + 1).alias("chars"),
        F.sum(F.regexp_count("line", F.lit(PRIMARY))).alias("primary_source_markers"),
        F.count_if(is_long_quote(F.col("line"))).alias("long_quote_lines"),
        *[c.alias(t) for t, c in tiers.items()],
        *[c.alias(n) for n, c in section_counts().items()],
    )
    totals = ["primary_source_markers", "long_quote_lines", *section_counts()]
    out = per_file.groupBy("corpus").agg(
        F.count(F.lit(1)).alias("files_scanned"),
        F.sum("chars").alias("total_chars"),
        *[F.sum(t).alias(t) for t in totals],
        F.sum("high").alias("high_tier_sources"), F.sum("mid").alias("mid_tier_sources"), F.sum("low").alias("low_tier_sources"),
        F.count_distinct(track_of(F.col("file"))).alias("track_coverage_count"),
    )
    out = out.join(seen, "corpus", "left").fillna(0, ["url_mentions", "unique_urls"])
    total = F.col("high_tier_sources") + F.col("mid_tier_sources") + F.col("low_tier_sources")
    return out.withColumn("weighted_source_primary_ratio", F.coalesce(primary_ratio(F.col("high_tier_sources"), total), F.lit(0)).cast("long"))


# Distinct counts that merge -------------------------------------------------------------------------

#: Base-two logarithm of a sketch's registers; the standard error is about 1.04 / sqrt(registers).
LG_K = 12


def sketch_error(lg_k: int = LG_K) -> float:
    return 1.04 / 2 ** (lg_k / 2)


def distinct_sketches(rows: DataFrame, keys: list[str], value: str, lg_k: int = LG_K) -> DataFrame:
    """(keys, sketch): a HyperLogLog sketch of each group's values, of bounded size, to be kept beside the files it is of.

    Null values don't count. Sketches of new files are added to those kept, so old files aren't read again.
    """
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(value, F.lit(lg_k)).alias("sketch"))


def merged_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, distinct): the estimate over all sketches of each group."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))
