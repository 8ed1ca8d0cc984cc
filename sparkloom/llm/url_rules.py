"""URL filtering by association rules that FP-growth mines.

A URL becomes a set of tokens: its host's labels, path segments by place, shapes, extension and query names.
URLs that a given host rule decides are the labelled transactions; their verdict is one more item. FP-growth
finds frequent item sets, and rules "tokens -> verdict" of enough support and confidence remain, less those
that a rule over fewer of the same tokens, at least as sure, makes superfluous.

Tokens that stand in the same labelled URLs are one item, as they tell no more together than each alone; so
a long path makes one item and not a set for each choice of its parts.

Rules match by an inverted index: each rule is posted under its rarest token, a URL's tokens look up their
postings, and a rule applies when all its tokens are the URL's. Rules are pruned by the same index. Everything is built-in functions and
Spark's own FP-growth.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Fixed values: (verdict, host, path) of the host rules.
HOST_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
VERDICTS = ("v=allow", "v=block")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url or one without '://'."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    none = F.lit("")
    return F.coalesce(F.translate(host, _UPPER, _LOWER), none), F.coalesce(path, none)


def host_rule(host: Column, path: Column, rules=HOST_RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a domain above it and begins the path; else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL; numbers count by their shape alone."""
    shape = lambda x: F.when(x.rlike("^[0-9]+$"), F.lit("#")).otherwise(F.regexp_replace(F.lower(x), "[0-9]+", "#"))
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0)), lambda x: x != "")
    parts = [
        F.transform(F.reverse(labels), lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit("="), shape(x))),
        F.transform(segments, lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit("="), shape(x))),
        F.transform(names, lambda x: F.concat(F.lit("q="), F.lower(x))),
        F.filter(F.array(F.concat(F.lit("x="), F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1))), lambda x: x != "x="),
    ]
    return F.array_distinct(F.coalesce(F.concat(*parts), F.array().cast("array<string>")))


def pruned(rules: DataFrame) -> DataFrame:
    """rules without those that have one of the same verdict, over fewer of their tokens, with no less confidence."""
    index = rules.select("rarest", "verdict", F.col("tokens").alias("part"), F.col("confidence").alias("reach"))
    posted = rules.select("id", "verdict", "tokens", "confidence", F.explode("tokens").alias("rarest")).join(index, ["rarest", "verdict"])
    within = (F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0)
    return rules.join(posted.where((F.col("reach") >= F.col("confidence")) & within).select("id").distinct(), "id", "left_anti")


def mine(labelled: DataFrame, support: float, confidence: float) -> DataFrame:
    """(id, tokens, verdict, confidence, support, rarest), pruned. labelled: (tokens, verdict)."""
    basket = F.concat("tokens", F.array(F.concat(F.lit("v="), F.col("verdict"))))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(labelled.select(basket.alias("items")))
    says = F.get("consequent", F.lit(0))
    found = model.associationRules.where(says.isin(*VERDICTS) & ~F.exists("antecedent", lambda x: x.isin(*VERDICTS)))
    found = found.select(F.sort_array("antecedent").alias("tokens"), F.substring(says, 3, 10).alias("verdict"), "confidence", "support").withColumn("id", F.xxhash64("tokens", "verdict"))
    common = model.freqItemsets.where(F.size("items") == 1).select(F.get("items", F.lit(0)).alias("token"), "freq")
    rarest = found.select("id", F.explode("tokens").alias("token")).join(common, "token").groupBy("id").agg(F.min_by("token", F.struct("freq", "token")).alias("rarest"))
    return cut(pruned(cut(found.join(rarest, "id"))))


def token_classes(labelled: DataFrame, support: float) -> DataFrame:
    """(token, class) of the frequent tokens. labelled: written (row, tokens, verdict).

    A class is named by its least token; tokens are alike if the numbers and the summed hashes of their rows are.
    """
    n = labelled.count()
    held = labelled.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("rows"))
    held = held.where(F.col("n") >= support * n)
    return cut(held.join(held.groupBy("n", "rows").agg(F.min("token").alias("class")), ["n", "rows"]).select("token", "class"))


def in_classes(rows: DataFrame, key: str, classes: DataFrame) -> DataFrame:
    """(key, tokens) with the tokens' classes in place of tokens; a row without a frequent token has none."""
    known = rows.select(key, F.explode("tokens").alias("token")).join(classes, "token").groupBy(key).agg(F.sort_array(F.collect_set("class")).alias("tokens"))
    return rows.drop("tokens").join(known, key, "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, __learned): the verdict of the best rule that applies. urls: distinct (url, tokens).

    Rules are joined as Spark finds best by their size; a URL meets only rules whose rarest token it has.
    """
    posted = urls.select("url", "tokens", F.explode("tokens").alias("rarest"))
    index = rules.select("rarest", F.col("tokens").alias("needed"), "verdict", "confidence", "support")
    found = posted.join(index, "rarest").where(F.size(F.array_except("needed", "tokens")) == 0)
    best = F.max_by("verdict", F.struct("confidence", F.size("needed"), "support", "verdict"))
    return found.groupBy("url").agg(best.alias("__learned"))


def judge_urls(pages: DataFrame, host_rules=HOST_RULES, support: float = 0.01, confidence: float = 0.8) -> DataFrame:
    """pages with ``host, path, rule, verdict`` added, replacing such columns.

    A host rule's verdict stands. Elsewhere the best association rule decides, and "allow" if none
    applies. A null url or one without '://' has empty host and path and no tokens, so it is allowed.
    Of rules that are equally sure the one over more tokens decides, then support, then name. Repeated rows are judged alike and
    all kept; long URLs are read whole; other columns come through. Without URLs that a host rule decides
    nothing is mined, and an empty table gives an empty result.
    """
    pages = pages.select(*[c for c in pages.columns if c not in ("host", "path", "rule", "verdict")])
    host, path = host_and_path(F.col("url"))
    out = pages.withColumns({"host": host, "path": path})
    rule, verdict = host_rule(F.col("host"), F.col("path"), host_rules)
    out = out.withColumns({"rule": rule, "__given": verdict})
    urls = out.select("url", "host", "path", "__given")
    tokens = url_tokens(F.col("url"), F.col("host"), F.col("path"))
    labelled = cut(urls.where("__given IS NOT NULL").select(F.monotonically_increasing_id().alias("row"), tokens.alias("tokens"), F.col("__given").alias("verdict")))
    if labelled.isEmpty():
        return out.withColumn("verdict", F.lit("allow")).drop("__given")
    classes = token_classes(labelled, support)
    rules = mine(in_classes(labelled, "row", classes), support, confidence)
    open_ = urls.where(F.col("__given").isNull() & F.contains("url", F.lit("://"))).select("url", tokens.alias("tokens")).distinct()
    # Decided URLs are not among the learned ones, so the url itself is the key. Written, so that AQE can split a hot one.
    learned = cut(matches(in_classes(open_, "url", classes), rules).withColumnRenamed("url", "__url"))
    out = out.join(learned, F.col("url") == F.col("__url"), "left")
    return out.withColumn("verdict", F.coalesce("__given", "__learned", F.lit("allow"))).drop("__given", "__url", "__learned")
