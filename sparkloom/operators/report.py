"""Markdown reports, as rows that sort into a text.

A report is never gathered into one value: its lines stay rows of (key, section, moment, seq, place, line), in
whose order they make the text, and write_report() writes them by ranges of that order.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_empty, strip_ws
from ..functions.urls import doc_token
from .select import head_per_group


class Section(NamedTuple):
    """Rows of one section: which, their line, their order (moment, then the rows' seq), and how many at most."""

    titles: tuple[str, ...]
    where: Column
    line: Column
    at: Column | None = None
    most: int | None = None
    optional: bool = False


def report_lines(rows: DataFrame, key: str, head: list[Column], sections: list[Section], seq: str = "seq") -> DataFrame:
    """(key, section, moment, seq, place, line) of one report per key.

    head: lines from the key's counts, ``total`` and ``n1``, ``n2``, … by section. A section's titles come
    first, in order of place; an optional section without rows has none. Sections without a cap are dealt
    out in one pass; in a capped one each key is cut before the shuffle.
    """
    totals = rows.groupBy(key).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(s.where).alias(f"n{k}") for k, s in enumerate(sections, 1)])
    none_at, none_seq = F.lit(None).cast("string").alias("moment"), F.lit(None).cast("long").alias("seq")
    titles = [F.when(F.lit(not s.optional) | (F.col(f"n{k}") > 0), F.array(*map(F.lit, s.titles))) for k, s in enumerate(sections, 1)]
    fixed = F.array(F.array(*head), *titles)
    out = totals.select(key, F.posexplode(fixed).alias("section", "lines")).select(key, "section", none_at, none_seq, F.posexplode("lines").alias("place", "line"))
    entry = lambda k, s: F.struct(F.lit(k).alias("section"), (F.lit("") if s.at is None else s.at).alias("moment"), s.line.alias("line"))
    whole = [F.when(s.where, entry(k, s)) for k, s in enumerate(sections, 1) if s.most is None]
    parts = [rows.select(key, F.col(seq).alias("seq"), F.explode(F.array_compact(F.array(*whole))).alias("e"))] if whole else []
    for k, s in enumerate(sections, 1):
        if s.most is not None:
            some = rows.where(s.where).select(key, F.col(seq).alias("seq"), entry(k, s).alias("e"))
            parts.append(head_per_group(some, [key], [F.col("e.moment"), F.col("seq")], s.most))
    for p in parts:
        out = out.unionByName(p.select(key, "e.section", "e.moment", "seq", F.lit(0).alias("place"), "e.line"))
    return out


ORDER = ("section", "moment", "seq", "place")


def write_report(lines: DataFrame, key: str, path: str) -> None:
    """Text files in one folder per key; read in the order of their names they make the report.

    Ranges of the report's order are sorted each on its own, so a report of any length is written by many tasks.
    """
    dealt = lines.repartitionByRange(key, *ORDER).sortWithinPartitions(key, *ORDER)
    dealt.select(key, F.col("line").alias("value")).write.partitionBy(key).text(path)


def tier_sections(titles: list[tuple[str, str]], line: Column, caps: dict[str, int]) -> list[Section]:
    """A section for each (tier, title) of a tiered table."""
    return [Section(("", "---", "", f"## {title}", ""), F.col("tier") == t, line, most=caps.get(t)) for t, title in titles]


#: Titles of the report of a channel's threads, and of a person's messages with direct talk.
THREADS = ("## 话题发起消息（权重最高：观点/决策/技术分享）", "## 长消息（观点/方案/讨论类）", "## 日常消息（风格参考）")
PERSON = ("## 长消息（观点/决策/技术类）", "## 日常消息（风格参考）", "## 私聊对话上下文（含双方消息）")


def thread_report(rows: DataFrame, key: str, shorts: int = 300) -> DataFrame:
    """Thread starters, long messages, and the first short ones. rows: (key, seq, tier, time, channel, content)."""
    tier, first = F.col("tier"), F.concat(F.lit("["), "time", F.lit("]"))
    placed = F.concat(first, F.lit("[#"), "channel", F.lit("] "), "content", F.lit("\n"))
    says = lambda label, n: F.concat(F.lit(label), F.col(n).cast("string"), F.lit(" 条"))
    head = [F.lit("# Slack 消息记录（自动采集）"), F.concat(F.lit("目标："), key), F.concat(says("共 ", "total"), F.lit("消息")), says("  话题发起消息：", "n1"), says("  长消息（>50字）：", "n2"), says("  短消息：", "n3")]
    return report_lines(rows, key, head, [
        Section(("", "---", "", THREADS[0], ""), tier == "thread", placed),
        Section(("---", "", THREADS[1], ""), tier == "long", placed),
        Section(("---", "", THREADS[2], ""), tier == "short", F.concat(first, F.lit(" "), "content"), most=shorts),
    ])


def person_report(rows: DataFrame, key: str, direct: str = "私聊", longer_than: int = 50, shorts: int = 300, talk: int = 500) -> DataFrame:
    """A person's long messages, first short ones, and the direct talk of both sides in order of time.

    rows: (key, seq, time, chat, is_target, content).
    """
    size, target = F.length(F.coalesce("content", F.lit(""))), F.col("is_target")
    time = F.concat(F.lit("["), "time", F.lit("]"))
    n = lambda c: F.col(c).cast("string")
    head = [F.lit("# 飞书消息记录（自动采集）"), F.concat(F.lit("目标："), key), F.concat(F.lit("共 "), n("total"), F.lit(" 条消息（目标用户 "), n("n4"), F.lit(" 条，对话方 "), (F.col("total") - F.col("n4")).cast("string"), F.lit(" 条）"))]
    who = F.when(target, F.concat(F.lit("["), key, F.lit("]"))).otherwise("[对方]")
    return report_lines(rows, key, head, [
        Section(("", "---", "", PERSON[0], ""), target & (size > longer_than), F.concat(time, F.lit("["), "chat", F.lit("] "), "content", F.lit("\n"))),
        Section(("---", "", PERSON[1], ""), target & (size <= longer_than), F.concat(time, F.lit(" "), "content"), most=shorts),
        Section(("", "---", "", PERSON[2], ""), F.col("chat") == direct, F.concat(time, F.lit(" "), who, F.lit(" "), "content"), at=F.col("time"), most=talk, optional=True),
        Section((), target, F.lit(None).cast("string"), most=0),  # counted for the head alone
    ]).where("line IS NOT NULL")


def doc_blocks(docs: DataFrame, least: int = 20) -> DataFrame:
    """docs (title, url, creator, content) that have a token in their URL and content enough, with their ``block`` of the report."""
    body = strip_ws(or_empty(F.col("content")))
    kept = docs.where(doc_token(F.col("url"))[0].isNotNull() & (F.length(body) >= least))
    block = F.concat(F.lit("---\n## 《"), F.coalesce("title", F.lit("无标题")), F.lit("》\n链接："), "url", F.lit("\n创建人："), or_empty(F.col("creator")), F.lit("\n\n"), body, F.lit("\n"))
    return kept.withColumn("block", block)


def resolved_docs(links: DataFrame, nodes: DataFrame, objects: DataFrame) -> DataFrame:
    """links (url, …) with the content of the object that each names, directly or, for a wiki page, by its node.

    nodes: (token, obj_token); objects: (token, content). A node may name another node; one step is taken, as
    nodes of nodes do not occur. Two shuffle joins on tokens; a link without an object has null content.
    """
    token, kind = doc_token(F.col("url"))
    rows = links.withColumns({"__token": token, "__kind": kind})
    via = nodes.select(F.col("token").alias("__node"), "obj_token")
    rows = rows.join(via, (F.col("__kind") == "wiki") & (F.col("__token") == F.col("__node")), "left")
    rows = rows.withColumn("__object", F.coalesce("obj_token", "__token")).drop("__node", "obj_token", "__token", "__kind")
    found = objects.select(F.col("token").alias("__t"), F.col("content"))
    return rows.join(found, F.col("__object") == F.col("__t"), "left").drop("__t", "__object")


#: The summary's labels, in order, and the metric of each.
SUMMARY = (
    ("Files scanned", "files_scanned"),
    ("Unique URLs", "unique_urls"),
    ("Total source mentions", "url_mentions"),
    ("Primary-source markers", "primary_source_markers"),
    ("Source metadata blocks", "source_metadata_blocks"),
    ("Contradiction bullets", "contradiction_bullets"),
    ("Inference bullets", "inference_bullets"),
    ("Pattern bullets", "pattern_bullets"),
    ("Gap bullets", "gap_bullets"),
    ("Total note chars", "total_chars"),
    ("Potential long quote lines", "long_quote_lines"),
    ("Track coverage count", "track_coverage_count"),
    ("Tier 1-3 (high-quality primary)", "high_tier_sources"),
    ("Tier 4-5 (medium / short-form firsthand)", "mid_tier_sources"),
    ("Tier 6-7 (external / secondhand)", "low_tier_sources"),
)


def summary_report(metrics: DataFrame, key: str) -> DataFrame:
    """(key, report): a corpus's metrics as a Markdown list."""
    lines = [F.concat(F.lit(f"- {label}: "), F.col(name).cast("string")) for label, name in SUMMARY]
    ratio = F.concat(F.lit("- Weighted-source primary ratio: "), F.col("weighted_source_primary_ratio").cast("string"), F.lit("%"))
    none = F.lit("- Weighted-source primary ratio: n/a (no weights annotated)")
    some = F.col("high_tier_sources") + F.col("mid_tier_sources") + F.col("low_tier_sources") > 0
    return metrics.select(key, F.concat_ws("\n", F.lit("# Research Summary\n"), *lines, F.when(some, ratio).otherwise(none)).alias("report"))


def gate_report(named: dict[str, Column], passed: Column) -> Column:
    """One PASS or FAIL line a check, and the overall one."""
    says = lambda ok: F.when(ok, "PASS").otherwise("FAIL")
    return F.concat_ws("\n", *[F.concat(says(ok), F.lit(f"  {name}")) for name, ok in named.items()], F.concat(F.lit("OVERALL "), says(passed)))


def gate_json(named: dict[str, Column], passed: Column, bullet_count: Column, grounded: Column, profile: Column, metrics: dict[str, Column]) -> Column:
    """The gate's outcome as JSON: checks by name, counts, profile and the metrics it was judged by."""
    fields = lambda d: F.struct(*[c.alias(k) for k, c in d.items()])
    return F.to_json(F.struct(passed.alias("passed"), fields(named).alias("checks"), bullet_count.alias("bullet_count"), grounded.alias("grounded_url_count"), profile.alias("profile"), fields(metrics).alias("research_metrics")))
