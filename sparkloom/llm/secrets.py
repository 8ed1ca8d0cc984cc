"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean trigram query is derived: an OR of ANDs of trigrams that
every match must contain. The index has one posting (trigram, document key) for each trigram of a rule
that a document holds. Postings are intersected by counting, per document and conjunction, how many of
its trigrams are posted. Only the documents a rule's query leaves are searched with the rule's regular
expression; a rule without mandatory trigrams scans every document.

Everything on rows is built-in functions. Trigrams are taken of lower-cased text, so case never hides
a match. Spans are code points, end exclusive.
"""

from __future__ import annotations

import re._parser as regex_parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """pattern: Java regular expression. min_length: of group ``group``; shorter matches are dropped
    after matching, so they still use up their text."""

    kind: str
    pattern: str
    group: int = 0
    min_length: int = 1
    base: bool = False


_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: Rules in the order in which spans of one start are listed; base rules first.
RULES = (
    Rule("assign", "(?i:" + _ASSIGN[: _ASSIGN.index("[\"']?")] + ")" + _ASSIGN[_ASSIGN.index("[\"']?"):], 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]+", 0, 16, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("login", r"[a-z][a-z0-9+]{1,15}://[A-Za-z0-9._-]{1,64}:[^\x20\x09-\x0D/@:]{3,128}@"),
)

#: Most strings that a part of a pattern may stand for and still be used.
MAX_STRINGS = 24


def _strings(items) -> set[str] | None:
    """All (lower-cased) strings that a parsed piece matches; None if they are too many."""
    out = {""}
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            part = {chr(arg)}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            part = {chr(c) for _, c in arg}
        elif name == "SUBPATTERN":
            part = _strings(arg[3])
        elif name == "BRANCH":
            each = [_strings(x) for x in arg[1]]
            part = None if None in each else set().union(*each)
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] <= 5:
            one = _strings(arg[2])
            part = None if one is None else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(one, repeat=n)}
        else:
            part = None
        if part is None or len(out) * len(part) > MAX_STRINGS:
            return None
        out = {a + b.lower() for a in out for b in part}
    return out


def _stretches(items: list) -> list[list[frozenset[str]]]:
    """Runs of pieces that every match holds one after another, each as the trigrams of the strings it may be.

    Pieces that stand for few strings are joined while they stay few. The run with the most trigrams in its
    poorest string comes first; what stands before it and after it is looked through in the same way.
    """
    best, at, score = [], (0, 0), 0
    for i in range(len(items)):
        for j in range(i + 1, len(items) + 1):
            strings = _strings(items[i:j])
            if strings is None:
                break
            each = [frozenset(s[k:k + 3] for k in range(len(s) - 2)) for s in strings]
            if (poorest := min(map(len, each))) > score:
                best, at, score = sorted(set(each), key=sorted), (i, j), poorest
    return [best, *_stretches(items[: at[0]]), *_stretches(items[at[1]:])] if score else []


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Conjunctions of trigrams, one of which every match of pattern holds in full; [] if none is mandatory.

    All stretches of the pattern's top level are joined, while the alternatives stay few.
    """
    out: set[frozenset[str]] = set()
    for each in _stretches(list(regex_parser.parse(pattern))):
        more = {a | b for a in out or {frozenset()} for b in each}
        if not out or len(more) <= MAX_STRINGS:
            out = more
    return sorted(out, key=sorted)


def conjunctions(rules=RULES) -> list[tuple[str, int, frozenset[str]]]:
    return [(r.kind, k, grams) for r in rules for k, grams in enumerate(trigram_query(r.pattern))]


def _key(df: DataFrame) -> DataFrame:
    """df with the key of its rows' contents: rows alike share it, so repeated rows stay repeated."""
    id_ = F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.lit("n"))
    return df.withColumn("__key", F.concat_ws(":", id_, F.hex(F.xxhash64(F.col("__text")))))


def postings(docs: DataFrame, rules=RULES) -> DataFrame:
    """(gram, __key): the index over every trigram that some rule asks for."""
    grams = sorted(set().union(*(g for _, _, g in conjunctions(rules)), frozenset()))
    low = F.lower(F.col("__text"))
    held = F.filter(F.array(*[F.when(F.contains(F.col("__low"), F.lit(g)), F.lit(g)) for g in grams]), F.isnotnull)
    return docs.select("__key", low.alias("__low")).select("__key", F.explode(held).alias("gram"))


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """(__key, kinds) of documents whose postings meet some rule's query."""
    spark = docs.sparkSession
    rows = [(g, kind, k, len(grams)) for kind, k, grams in conjunctions(rules) for g in sorted(grams)]
    asked = spark.createDataFrame(rows, "gram string, kind string, part int, needed int")
    met = postings(docs, rules).join(F.broadcast(asked), "gram")  # asked: a few rows per rule
    met = met.groupBy("__key", "kind", "part").agg(F.count_distinct("gram").alias("n"), F.first("needed").alias("needed"))
    return met.where("n = needed").groupBy("__key").agg(F.collect_set("kind").alias("kinds"))


def _scanning(rule: Rule) -> Rule:
    """A whole-match rule over one repeated class may skip its short runs while matching; the result is the same."""
    if rule.group == 0 and rule.pattern == "[0-9a-f]+":
        return Rule(rule.kind, f"(?<![0-9a-f])[0-9a-f]{{{rule.min_length},}}+", 0, rule.min_length, rule.base)
    return rule


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """array<struct<start, end, rank, kind>> of a rule's matches that are long enough.

    The text is split at the matches; summing the lengths of pieces and matches gives the places.
    """
    rule = _scanning(rule)
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    shown = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,rank:int,kind:string>>").alias("out"))

    def step(acc, m):
        start = acc["at"] + F.length(m["piece"])
        end = start + F.length(m["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(F.length(m["shown"]) >= rule.min_length, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    matches = F.filter(F.arrays_zip(F.split(text, rule.pattern, -1).alias("piece"), found.alias("hit"), shown.alias("shown")), lambda m: F.isnotnull(m["hit"]))
    return F.aggregate(matches, zero, step, lambda acc: acc["out"])


def find_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """docs with ``secret_spans`` added: array<struct<start, end, rank, kind>> in order of start, then rule.

    A column of that name is replaced; others come through. Null text counts as empty; long texts are
    scanned whole. Repeated rows are scanned alike and all kept; a null doc_id is a value like others. Spans
    of one start are in the order of the rules. An empty table gives an empty result.
    """
    none = F.array().cast("array<struct<start:int,end:int,rank:int,kind:string>>")
    rows = _key(docs.withColumn("__text", F.coalesce(F.col("text"), F.lit(""))))
    queried = [r for r in rules if trigram_query(r.pattern)]
    scanned = [r for r in rules if r not in queried]
    keyed = rows.select("__key", "__text")
    hits = keyed.join(candidates(keyed, queried), "__key")
    each = [F.when(F.array_contains("kinds", r.kind), spans(F.col("__text"), r, rules.index(r))).otherwise(none) for r in queried]
    verified = hits.select("__key", F.concat(*each).alias("__verified")).where(F.size("__verified") > 0)
    verified = verified.groupBy("__key").agg(F.first("__verified").alias("__verified"))
    full = F.concat(none, *[spans(F.col("__text"), r, rules.index(r)) for r in scanned])
    slim = rows.withColumn("__full", full).drop("__text").join(verified, "__key", "left")
    every = F.sort_array(F.concat(F.col("__full"), F.coalesce(F.col("__verified"), none)))
    return slim.withColumn("secret_spans", every).drop("__key", "__full", "__verified")


def join_spans(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(found, one), ",")


def redact(docs: DataFrame, rules=RULES) -> DataFrame:
    """docs with every secret in text replaced by [kind]; of overlapping spans the first one's kind stands.

    Columns stay as they are, one named secret_spans too, but n_chars, where there is one, follows the new
    text. A null text stays null; repeated rows are redacted alike and all kept.
    """
    own = "secret_spans" in docs.columns
    found = find_secrets(docs.withColumnRenamed("secret_spans", "__own_spans") if own else docs, rules)
    merged = F.aggregate(
        F.col("secret_spans"),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length(F.col("text")))),
    )
    text = F.when(F.size("secret_spans") > 0, merged).otherwise(F.col("text"))
    out = found.withColumn("__new", text)
    cols = [F.col("__new").alias(c) if c == "text" else F.length("__new").cast(out.schema[c].dataType).alias(c) if c == "n_chars" else F.col("__own_spans").alias(c) if c == "secret_spans" else F.col(c) for c in docs.columns]
    return out.select(*cols)
