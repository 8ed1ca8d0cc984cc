"""Quality rules whose cutoffs carry a risk guarantee.

Each rule is a rate that junk drives up or down, with a fixed grid of cutoffs from mild to harsh. The
labelled holdout is dealt by a hash of the id: a third is the guide, the rest the guard. The guide lines up,
for each stratum (length class of the document), the cutoffs that pay into one sequence, from those that
cost fewest good documents on. The guard, which had no part in that, tests the sequence: step by step, as long
as the exact binomial test rejects "the cutoffs so far together falsely reject more than ``alpha`` of the
stratum's good documents" at the stratum's level. Levels are dealt as Holm's are: each stratum has
``delta / number of strata``, and one whose whole sequence has passed leaves its level to the others in equal
parts. The last step that passes gives the stratum's cutoffs; so with probability 1 - ``delta`` no
stratum loses more than ``alpha`` of its good documents to them. All labelled rows of the holdout count.

All work on rows is built-in functions; only counts per (stratum, label, cutoff or step), whose number the
grid fixes, reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORD, cut, fold_of

#: ASCII white space of the contract, as characters to delete.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Upper ends of the length classes, in words; the last class is open.
STRATA = (150, 600)


#: The columns that base_columns() adds.
BASE = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks")


def _rules() -> dict[str, tuple[Column, tuple[float, ...]]]:
    """name -> (rate over the base columns, grid from mild to harsh); a document above a cutoff is rejected."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    grid = (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02)
    return {
        "symbols": (F.col("n_symbols") / words, (2.0, 1.0, *grid)),
        "capitals": (F.col("n_upper") / chars, grid),
        "marks": (F.col("n_marks") / words, (2.0, 1.0, *grid)),
        "digits": (F.col("n_digits") / chars, grid),
        "dup_lines": (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), grid),
        "repeats": (F.col("n_repeat_words") / words, grid),
        "long_words": (F.col("word_chars") / words, (40.0, 25.0, 18.0, 14.0, 12.0, 10.0)),
        "short_words": (words / chars, (1.0, 0.7, 0.5, 0.4, 0.35, 0.3)),
    }


def _gone(text: Column, chars: str) -> Column:
    """Characters of text that are one of chars; translate() deletes them."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body uses it and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeats(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more, found by 64-bit hash.

    Sorting (hash, place) puts equal windows side by side, n log n; a text without any stops at the
    distinct count.
    """
    n = F.size(words)
    window = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    hashes = F.transform(F.sequence(F.lit(0), n - 3), window)

    def covered(pairs: Column) -> Column:
        again = F.filter(pairs, lambda p, k: (F.get(pairs, k - 1)["h"] == p["h"]) | (F.get(pairs, k + 1)["h"] == p["h"]))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda p: F.array(p["i"], p["i"] + 1, p["i"] + 2)))))

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(ordered, covered))

    return F.when(n < 3, F.lit(0)).otherwise(_let(hashes, count))


def base_columns(docs: DataFrame) -> DataFrame:
    """docs with the columns of BASE added, in place of columns of these names.

    Null text counts as empty: all counts 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    by_words = lambda w: F.struct(F.size(w).alias("n"), _repeats(w).alias("again"))
    has_word = lambda x: F.length(F.translate(x, SPACES, "")) > 0
    by_lines = lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("kinds"))
    out = docs.withColumns({
        "__words": _let(F.regexp_extract_all(text, F.lit(f"({SPACE_WORD})"), F.lit(1)), by_words),
        "__lines": _let(F.filter(F.split(text, "\n"), has_word), by_lines),
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": _gone(text, SYMBOLS).cast("long"),
        "n_upper": _gone(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long"),
        "n_digits": _gone(text, "0123456789").cast("long"),
        "n_marks": _gone(text, "!?;:=_~^@").cast("long"),
    })
    return out.withColumns({
        "n_words": F.col("__words.n").cast("long"),
        "n_repeat_words": F.col("__words.again").cast("long"),
        "n_lines": F.col("__lines.n").cast("long"),
        "n_dup_lines": (F.col("__lines.n") - F.col("__lines.kinds")).cast("long"),
    }).drop("__words", "__lines")


def stratum() -> Column:
    out = F.lit(len(STRATA))
    for k in reversed(range(len(STRATA))):
        out = F.when(F.col("n_words") < STRATA[k], F.lit(k)).otherwise(out)
    return out


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p), summed in logarithms; from k down, until terms no longer count."""
    if n == 0 or k >= n:
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    total = 0.0
    for i in range(k, -1, -1):
        term = math.exp(log(i))
        total += term
        if i < n * p and term < 1e-18 * total:  # below the mean they only fall
            break
    return min(1.0, total)


def _places() -> Column:
    """For each rule the number of cutoffs of its grid that the document stays under: the first, from 0, that rejects it."""
    over = lambda rate, c: F.coalesce(rate > c, F.lit(False))
    return F.struct(*[sum((F.when(over(rate, c), 0).otherwise(1) for c in grid), F.lit(0)).alias(name) for name, (rate, grid) in _rules().items()])


def sequence(marginals: dict[tuple[str, int], tuple[int, int]]) -> list[tuple[str, int]]:
    """Steps (rule, place in its grid) by the good documents that they cost in the guide, those first that catch most.

    marginals: step -> (good documents rejected, junk rejected) by this cutoff alone; cutoffs that catch no junk are left out.
    """
    order = {name: k for k, name in enumerate(_rules())}
    paying = [(good, -junk, order[name], k) for (name, k), (good, junk) in marginals.items() if junk]
    names = list(order)
    return [(names[r], k) for _, _, r, k in sorted(paying)]


def _first_step(path: list[tuple[str, int]]) -> Column:
    """The first step, from 0, that rejects the document; null for none."""
    if not path:
        return F.lit(None).cast("int")
    steps = [F.when(F.col("places")[name] <= k, F.lit(i)) for i, (name, k) in enumerate(path)]
    return F.least(*steps, F.lit(None).cast("int"))


def longest_safe(rejected_at: dict[int, int], n: int, steps: int, alpha: float, level: float) -> int:
    """Number of steps, from the first, that pass the test. rejected_at: step -> good documents that it is the first to reject."""
    bad = 0
    for k in range(steps):
        bad += rejected_at.get(k, 0)
        if n == 0 or bad > n * alpha or binomial_tail(bad, n, alpha) > level:
            return k
    return steps


def certified(paths: dict[int, list], rejected_at: dict[int, dict], alpha: float, delta: float) -> dict[int, int]:
    """Number of steps that pass in each stratum; strata that pass all of theirs leave their level to the others."""
    passed, waiting = {}, list(paths)
    while waiting:
        safe = {s: longest_safe(rejected_at[s], sum(rejected_at[s].values()), len(paths[s]), alpha, delta / len(waiting)) for s in waiting}
        through = [s for s in waiting if safe[s] == len(paths[s])]
        passed |= {s: safe[s] for s in (through or waiting)}
        waiting = [s for s in waiting if s not in passed]
    return passed


def _by_step(rows: DataFrame, paths: dict[int, list]) -> dict[tuple[int, int], dict[int | None, int]]:
    """(stratum, label) -> first rejecting step, or None, -> documents."""
    step = F.lit(None).cast("int")
    for s, path in paths.items():
        step = F.when(F.col("stratum") == s, _first_step(path)).otherwise(step)
    out: dict = {}
    for r in rows.groupBy("stratum", "label", step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect():
        out.setdefault((r["stratum"], r["label"]), {})[r["step"]] = r["n"]
    return out


def fit_cutoffs(holdout: DataFrame, alpha: float = 0.04, delta: float = 0.1) -> dict[tuple[int, str], float]:
    """(stratum, rule) -> cutoff. holdout: rows of base_columns() with doc_id and label (1 good, 0 junk), without base failures."""
    rules, strata = _rules(), range(len(STRATA) + 1)
    rows = cut(holdout.select("label", stratum().alias("stratum"), (F.shiftright(F.crc32(F.col("doc_id").cast("string")), 8) % 3 == 0).alias("guide"), _places().alias("places")))
    guide, guard = rows.where("guide"), rows.where(~F.col("guide") & (F.col("label") == 1))
    aggs = [F.count_if(F.col("places")[name] <= k).alias(f"{name}__{k}") for name, (_, grid) in rules.items() for k in range(len(grid))]
    alone = {(r["stratum"], r["label"]): r for r in guide.groupBy("stratum", "label").agg(*aggs).collect()}
    paths = {}
    for s in strata:
        n = lambda label, step: alone[s, label][f"{step[0]}__{step[1]}"] if (s, label) in alone else 0  # noqa: B023, E731
        paths[s] = sequence({step: (n(1, step), n(0, step)) for step in ((name, k) for name, (_, grid) in rules.items() for k in range(len(grid)))})
    together = _by_step(guide, paths)
    for s, path in paths.items():  # a step pays if the share of junk that only it catches is above the share of good documents
        good, junk = together.get((s, 1), {}), together.get((s, 0), {})
        m, n = max(1, sum(good.values())), max(1, sum(junk.values()))
        paths[s] = [step for k, step in enumerate(path) if junk.get(k, 0) / n > good.get(k, 0) / m]
    tested = {key: counts for key, counts in _by_step(guard, paths).items() if key[1] == 1}
    out = {}
    for s, passed in certified(paths, {s: tested.get((s, 1), {}) for s in strata}, alpha, delta).items():
        for name, k in paths[s][:passed]:
            c = rules[name][1][k]
            out[s, name] = min(c, out.get((s, name), c))
    return out


def rejected(cutoffs: dict[tuple[int, str], float]) -> Column:
    rules, out = _rules(), F.lit(False)
    for (s, name), c in cutoffs.items():
        out = out | ((stratum() == s) & F.coalesce(rules[name][0] > c, F.lit(False)))
    return out


def holdout_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of the holdout, one row an id; an id labelled more than once takes its highest label."""
    rows = labels.select("doc_id", F.col("quality").cast("int").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold_of(F.col("doc_id"), 4) != 2))
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))


def judged(counted: DataFrame, labels: DataFrame, alpha: float = 0.04, delta: float = 0.1) -> DataFrame:
    """counted, rows of base_columns(), with base_failed and kept added; no text is read."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    slim = counted.select("doc_id", *BASE).where(~failed)
    # The labels grow with the documents: a shuffle join, of counts alone.
    holdout = slim.join(holdout_labels(labels).hint("shuffle_hash"), "doc_id")
    cutoffs = fit_cutoffs(holdout, alpha, delta)
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~rejected(cutoffs))


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.04, delta: float = 0.1) -> DataFrame:
    """docs with the base columns, base_failed and kept added, in place of columns of these names.

    base_failed: fewer than 50 words, or over half the words in repeated 3-word windows. kept: neither
    that nor rejected by a certified cutoff. A stratum needs 84 good documents in the guard to certify
    anything at the default alpha and delta, 74 or 57 once one or two others are through; without, and with no labels, the base rules alone decide. Null
    and empty texts have no words and fail; long texts are counted whole. Rows that repeat an id, and those
    that tie at a cutoff, are judged alike, each on its own; a null id is judged like any other but never
    labelled. Empty tables give empty results.
    """
    return judged(base_columns(docs), labels, alpha, delta)
