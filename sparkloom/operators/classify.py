"""First-match classification of messages, noise predicates and name normalization."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import contains_any, or_empty, strip_ws

#: Words that mark a chat reply as a decision.
CHAT_DECISIONS = ("同意", "不行", "觉得", "建议", "应该", "不应该", "可以", "不可以", "方案", "思路", "考虑", "决定", "确认", "拒绝", "推进", "暂缓", "没问题", "有问题", "风险", "评估", "判断")
#: Words that mark a mail, in lower case, as a decision.
MAIL_DECISIONS = ("同意", "不同意", "建议", "方案", "觉得", "应该", "决定", "确认", "approve", "reject", "lgtm", "suggest", "recommend", "think", "我的看法", "我认为", "我觉得", "需要", "必须", "不需要")
#: Contents that stand for something that isn't text.
EXPORT_PLACEHOLDERS = ("[图片]", "[文件]", "[撤回了一条消息]", "[语音]")
API_PLACEHOLDERS = ("[图片]", "[文件]", "[表情]", "[语音]")
#: Other names of families.
FAMILY_ALIASES = {"ex": "relationship", "self": "relationship", "yourself": "relationship", "icon": "celebrity", "character": "celebrity", "fictional-character": "celebrity", "nuwa": "celebrity"}
FAMILIES = ("colleague", "relationship", "celebrity")


def message_tier(content: Column, longer_than: int = 50, decisions=CHAT_DECISIONS) -> Column:
    """long, decision or daily. Length counts code points."""
    c = or_empty(content)
    return F.when(F.length(c) > longer_than, "long").when(contains_any(c, decisions), "decision").otherwise("daily")


def mail_tier(body: Column, longer_than: int = 200, decisions=MAIL_DECISIONS) -> Column:
    b = or_empty(body)
    return F.when(F.length(b) > longer_than, "long").when(contains_any(F.lower(b), decisions), "decision").otherwise("daily")


def thread_tier(content: Column, is_starter: Column, longer_than: int = 50) -> Column:
    return F.when(is_starter, "thread").when(F.length(or_empty(content)) > longer_than, "long").otherwise("short")


def source_tier(weight: Column) -> Column:
    return F.when(weight <= 3, "high").when(weight <= 5, "mid").otherwise("low")


def is_placeholder(content: Column, placeholders=EXPORT_PLACEHOLDERS) -> Column:
    """Empty after stripping, or one of the placeholders."""
    c = strip_ws(or_empty(content))
    return (c == "") | c.isin(*placeholders)


def is_noise(content: Column, least: int = 2) -> Column:
    """Less than ``least`` characters besides mentions, links and emoji names."""
    c = strip_ws(F.regexp_replace(or_empty(content), r"<[^>]+>", ""))
    return F.length(strip_ws(F.regexp_replace(c, r":[a-z_]+:", ""))) < least


def key_kind(key: Column) -> Column:
    """What a person is looked up by: mail, phone or name."""
    digits = F.regexp_replace(key, r"[+-]", "")
    return F.when(key.contains("@"), "mail").when(digits.rlike("^[0-9]+$"), "phone").otherwise("name")


def family(name: Column, aliases=FAMILY_ALIASES, known=FAMILIES, default: str = "colleague") -> Column:
    """A family's own name from any of its names; the default for others."""
    n = F.lower(strip_ws(or_empty(name)))
    pairs = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    full = F.coalesce(F.element_at(pairs, n), n)
    return F.when(full.isin(*known), full).otherwise(F.lit(default))


def review_passes(text: Column) -> Column:
    return or_empty(text).rlike(r"(?i)Status:\s*PASS\b|Release readiness:\s*ready\b|Verdict:?\s*PASS\b")


def copyright_safe(text: Column) -> Column:
    """No code fence, no quoted line, no clock time."""
    t = or_empty(text)
    return ~t.contains("```") & ~t.rlike(r"(?m)^\s*>") & ~t.rlike(r"\b\d{2}:\d{2}:\d{2}(?:[.,]\d{1,3})?\b")
