"""Gates over drafts and research metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import is_concrete_source
from .classify import copyright_safe, source_tier

#: Patterns that a draft must show, without regard to case.
PATTERNS = {
    "mental_models": "mental model|心智模型",
    "limitations": "limitations|boundary|局限|边界",
    "expression_dna": "expression DNA|表达 DNA|sentence rhythm|metaphor",
    "honest_boundaries": "honest boundar|诚实边界|what .* does not know",
    "internal_tension": "contradiction|tension|矛盾|张力",
    "intellectual_genealogy": "intellectual genealogy|influenced by|智识谱系|influenced:",
    "agentic_protocol": "agentic protocol|research dimensions|step 1.*classify|分析协议",
}
#: Floors of the strict profile.
FLOORS = {"files_scanned": 6, "unique_urls": 8, "primary_source_markers": 3, "source_metadata_blocks": 6, "contradiction_bullets": 6, "inference_bullets": 6, "track_coverage_count": 6}
STRICT = "budget-unfriendly"


def bullets(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?m)^\s*[-*]\s+"))


def grounded_urls(text: Column) -> Column:
    """Distinct URLs of the text, without closing dots and commas, that name a concrete source."""
    found = F.regexp_extract_all(text, F.lit(r"https?://[^\s)>\]]+"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, lambda u: F.regexp_replace(u, "[.,]+$", "")), lambda u: is_concrete_source(u)))


def checks(text: Column, profile: Column, metric) -> dict[str, Column]:
    """name -> whether the draft passes. metric(name): its column, null counting as 0 or false."""
    strict = profile == STRICT
    n = lambda name: F.coalesce(metric(name).cast("long"), F.lit(0))
    yes = lambda name: F.coalesce(metric(name), F.lit(False))
    shows = lambda name: text.rlike(f"(?i){PATTERNS[name]}")
    depth = F.lit(True)
    for name, floor in FLOORS.items():
        depth = depth & (n(name) >= floor)
    reviews = F.lit(True)
    for name in ("research_audit_present", "synthesis_review_present", "validation_review_present", "research_audit_pass", "validation_review_pass"):
        reviews = reviews & yes(name)
    out = {name: shows(name) for name in ("limitations", "expression_dna", "honest_boundaries", "internal_tension")}
    out["mental_models"] = (bullets(text) >= 3) & shows("mental_models")
    out["source_grounding"] = F.size(grounded_urls(text)) >= F.when(strict, 4).otherwise(2)
    out["copyright_safety"] = copyright_safe(text) & (n("long_quote_lines") == 0)
    only_strict = {
        "intellectual_genealogy": shows("intellectual_genealogy"),
        "agentic_protocol": shows("agentic_protocol"),
        "source_hierarchy": (n("weighted_source_primary_ratio") >= 50) | (n("high_tier_sources") >= 3),
        "review_chain": reviews,
        "validation_depth": (n("known_answer_questions") >= 2) & (n("edge_case_markers") >= 1),
        "research_depth": depth,
    }
    return out | {k: ~strict | v for k, v in only_strict.items()}


def check_map(named: dict[str, Column]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(k) for k in named]), F.array(*named.values()))


def passed(check: Column) -> Column:
    return F.forall(F.map_values(check), lambda ok: ok)


def triple_gate(*gates: Column) -> Column:
    """keep if all hold, demote if some do, discard otherwise."""
    n = sum((g.cast("int") for g in gates[1:]), gates[0].cast("int"))
    return F.when(n == len(gates), "keep").when(n >= 1, "demote").otherwise("discard")


#: The hierarchy of sources, best first, as (weight, class), and sources that are never evidence, by host or title.
HIERARCHY = ((1, "local material"), (2, "first-person work"), (3, "long-form interview"), (4, "documented decision"), (5, "short first-person post"), (6, "external analysis"), (7, "secondhand summary"))
BLACKLIST = (("zhihu", r"(?i)\bzhihu\.com|知乎"), ("wechat", r"(?i)\bmp\.weixin\.qq\.com|微信公众号"), ("baike", r"(?i)\bbaike\.baidu\.com|百度百科"))
#: Kinds of source that are never evidence wherever they stand: name, what names it, what it must go with, what excuses it.
#: A list of lessons may quote primary sources with links; an encyclopedia may point to sources, but isn't a primary one.
GENERAL = (
    ("content farm", r"(?i)\bcontent farm|\bseo\b|\bsearch[- ]optimi[sz]ed\b", None, None),
    ("generated biography", r"(?i)\b(?:ai|machine)[- ](?:generated|written)\b|\b(?:generated|written) by (?:an? )?(?:ai|language model)\b", None, None),
    ("listicle", r"(?i)\b\d+\s+(?:\w+\s+)?(?:lessons|things|ways|facts|quotes|reasons|tips|secrets|habits|rules)\b", None, r"(?is)(?=.*https?://)(?=.*\b(?:primary|first-person)\b)"),
    ("encyclopedia", r"(?i)\bwikipedia\b|维基百科", r"(?i)\bprimary\b|\bfirst-person\b|一手", None),
)


def hierarchy(spark: SparkSession) -> DataFrame:
    """(weight, class, tier): seven rows."""
    return spark.createDataFrame(HIERARCHY, "weight int, class string").withColumn("tier", source_tier(F.col("weight")))


def blacklist(spark: SparkSession) -> DataFrame:
    """(source, pattern, only_with, unless): a row for each kind of source that is never evidence, named ones and general ones."""
    return spark.createDataFrame([(n, p, None, None) for n, p in BLACKLIST] + list(GENERAL), "source string, pattern string, only_with string, unless string")


def blacklisted(lines: DataFrame, listed: DataFrame, column: str = "line") -> DataFrame:
    """The rows that cite a listed source, with its name; one row for each source that a line cites. listed: a dimension of a few patterns."""
    cites = F.expr(f"`{column}` RLIKE pattern AND (only_with IS NULL OR `{column}` RLIKE only_with) AND (unless IS NULL OR NOT `{column}` RLIKE unless)")
    return lines.join(F.broadcast(listed), cites).drop("pattern", "only_with", "unless")


def audit(metrics: DataFrame, cited: DataFrame, key: str = "corpus") -> DataFrame:
    """metrics with one column for each condition and ``passed``. cited: rows of blacklisted(), one or more per key.

    All tracks, 8 URLs or more, more than half of the weighted sources primary, 3 contradictions or more, no
    listed source, and fewer sources of weights 5 to 7 than of the better ones where the weights are known by tier.
    """
    out = metrics.join(cited.select(key).distinct().withColumn("__cited", F.lit(True)), key, "left")
    named = {
        "all_tracks": F.col("track_coverage_count") >= 6,
        "grounded": F.col("unique_urls") >= 8,
        "primary": F.col("weighted_source_primary_ratio") > 50,
        "contradictions": F.col("contradiction_bullets") >= 3,
        "clean": F.col("__cited").isNull(),
        "not_bottom_heavy": F.col("low_tier_sources") <= F.col("high_tier_sources") + F.col("mid_tier_sources"),
    }
    ok = F.lit(True)
    for c in named.values():
        ok = ok & c
    return out.withColumns(named | {"passed": ok}).drop("__cited")
