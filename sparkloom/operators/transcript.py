"""Subtitles to paragraphs, and lines in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BREAKS, GAPS, let

#: A cue's timing, and settings that follow it.
TIMING = r"(?:\d{2}:\d{2}:\d{2}[.,]\d{3}|\d{2}:\d{2}[.,]\d{3})"
SETTINGS = rf"\b(?:align|position|size|line):[^\s{GAPS}]+"


def without_vtt_headers(text: Column) -> Column:
    """Without the file's head and its notes, each up to a blank line; line ends come out as new lines."""
    x = F.when(text.contains("\r"), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)
    x = let(x, lambda t: F.when(t.startswith("WEBVTT"), F.regexp_replace(t, r"(?s)^WEBVTT.*?\n\n", "")).otherwise(t))
    return let(x, lambda t: F.when(t.contains("NOTE"), F.regexp_replace(t, r"(?dms)^NOTE.*?\n\n", "")).otherwise(t))


#: White space other than a space and a new line, which few captions hold.
_ODD_GAPS, _ODD_BREAKS = GAPS[1:], BREAKS.replace("\n", "")


def cue_lines(text: Column) -> Column:
    """Spoken lines in order: no numbers, timings, tags or settings; white space squeezed.

    A line ends at any of the line and page separators, as well as at a new line. White space of other kinds is
    made plain first, where there is any, so the patterns that follow are short; each is tried only on lines that
    hold the character that it needs.
    """
    x = without_vtt_headers(text)
    x = let(x, lambda t: F.when(t.rlike(f"[{_ODD_GAPS}{_ODD_BREAKS}]"), F.regexp_replace(F.regexp_replace(t, f"[{_ODD_BREAKS}]", "\n"), f"[{_ODD_GAPS}]", " ")).otherwise(t))
    lines = F.filter(F.split(x, "\n"), lambda line: ~line.rlike(rf"^ *(?:\p{{Nd}}+ *|{TIMING} +--> .*)$"))
    lines = F.transform(lines, lambda line: F.when(line.contains("<"), F.regexp_replace(line, r"<[^>]+>", "")).otherwise(line))
    lines = F.transform(lines, lambda line: F.when(line.contains(":"), F.regexp_replace(line, SETTINGS, "")).otherwise(line))
    lines = F.transform(lines, lambda line: F.when(line.contains("  "), F.regexp_replace(line, " {2,}", " ")).otherwise(line))
    return F.filter(F.transform(lines, lambda line: F.btrim(line, F.lit(" "))), lambda line: line != "")


def without_repeats(lines: Column) -> Column:
    """The first line of each run of equal ones, within an array. Lines are evaluated once."""
    return let(lines, lambda xs: F.filter(xs, lambda x, i: (i == 0) | (x != F.coalesce(F.get(xs, i - 1), F.lit("")))))


def consecutive_distinct(rows: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """The first row of each run of equal values, over rows of a group in order."""
    before = F.lag(value).over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("__before", before).where(F.col("__before").isNull() | (F.col("__before") != F.col(value))).drop("__before")


def paragraphs(lines: Column, full: int = 240) -> Column:
    """Lines joined by spaces; a paragraph ends once it is ``full`` characters long or a sentence ends."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc, line):
        joined = F.when(acc["open"] == "", line).otherwise(F.concat_ws(" ", acc["open"], line))
        ends = (F.length(joined) >= full) | line.rlike("[.!?。！？]$")
        return F.struct(F.when(ends, F.concat(acc["done"], F.array(joined))).otherwise(acc["done"]).alias("done"), F.when(ends, "").otherwise(joined).alias("open"))

    return F.aggregate(lines, start, add, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def transcript(text: Column) -> Column:
    """Paragraphs of a caption file, a blank line between; null stays null."""
    return F.array_join(paragraphs(without_repeats(cue_lines(text))), "\n\n")
