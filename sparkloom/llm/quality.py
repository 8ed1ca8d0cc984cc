"""Quality scores: ridge regression over random Fourier features, calibrated by isotonic regression.

Document statistics are standardized and mapped to cosines of random projections, whose inner products
approximate a Gaussian kernel. Each partition sums its share of the normal equations; Spark adds the
shares entry by entry, and the small system is solved once. A part of the labelled rows held back from
the fit calibrates the scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, MAX_LABELLED, cut, isotonic, labelled_ids, with_labels

STATISTICS = (
    "log_chars", "log_words", "word_length", "longest", "upper", "digits", "symbols", "bars", "exclaims", "stops", "commas",
    "non_ascii", "lines", "dup_lines", "variety", "common", "repeats", "tokens",
)
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
NON_ASCII = bytes(range(128, 256))


def _deleted(raw: bytes, chars: bytes) -> int:
    return len(raw) - len(raw.translate(None, chars))


def statistics(text: str | None) -> list[float]:
    """STATISTICS of a text; all 0 for an empty or null text."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
    ws = raw.split()
    if not ws:
        return [0.0] * len(STATISTICS)
    n, size = len(ws), len(raw)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    kinds = set(ws)
    longest = max(map(len, kinds))
    folded = raw.translate(FOLD).split()
    pairs = set(zip(ws, ws[1:], ws[2:]))
    return [
        math.log1p(size), math.log1p(n), size / n, math.log(longest), _deleted(raw, UPPER) / size, _deleted(raw, DIGITS) / size,
        _deleted(raw, b"#*$%&<>") / n, raw.count(b"|") / n, raw.count(b"!") / n, raw.count(b".") / n, raw.count(b",") / n,
        _deleted(raw, NON_ASCII) / size, len(lines) / n, 1 - len(set(lines)) / len(lines), len(kinds) / n,
        sum(map(len, folded)) / size, 1 - len(pairs) / max(1, n - 2) if n > 2 else 0.0, len(folded) / n,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    @F.pandas_udf("array<double>")
    def compute(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    return docs.withColumn("__stats", compute(F.col("text")))


class FourierMap:
    """cos(z W + b) of standardized statistics z; inner products approximate exp(-gamma |z - z'|^2)."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, size: int, gamma: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0.0, math.sqrt(2 * gamma), (len(mean), size))
        self.b = rng.uniform(0, 2 * math.pi, size)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / self.w.shape[1]) * np.cos(z @ self.w + self.b), z / 10, np.ones((len(z), 1))])


def fit_ridge(labelled: DataFrame, mapping: FourierMap, ridge: float) -> np.ndarray:
    """Weights from the normal equations, summed by partition and then by entry."""
    size = mapping.w.shape[1] + len(mapping.mean) + 1
    upper = np.triu_indices(size)

    def share(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, right = np.zeros((size, size)), np.zeros(size)
        for b in batches:
            if len(b):
                x = mapping(np.stack(b["__stats"].to_numpy()))
                gram += x.T @ x
                right += x.T @ b["label"].to_numpy(dtype=float)
        yield pd.DataFrame({"entry": np.arange(len(upper[0]) + size), "value": np.concatenate([gram[upper], right])})

    sums = labelled.select("__stats", "label").mapInPandas(share, "entry int, value double").groupBy("entry").agg(F.sum("value").alias("value"))
    flat = np.zeros(len(upper[0]) + size)
    for r in sums.collect():  # as many as the system has entries
        flat[r["entry"]] = r["value"]
    gram = np.zeros((size, size))
    gram[upper] = flat[: len(upper[0])]
    gram = gram + np.triu(gram, 1).T
    return np.linalg.solve(gram + ridge * np.eye(size), flat[len(upper[0]):])


def quality(docs: DataFrame, labels: DataFrame, train, max_labelled: int = MAX_LABELLED, size: int = 96, gamma: float = 0.05, ridge: float = 0.1, seed: int = 5) -> DataFrame:
    """docs with ``score`` (0 to 1) added, replacing such a column.

    train: condition on doc_id for rows whose labels may be used. Null and empty texts are scored by the
    same model, from statistics of 0. Without labels the score is 0.5. Repeated rows get equal scores; an
    empty table gives an empty result.
    """
    docs = docs.select(*[c for c in docs.columns if c != "score"])
    labelled = with_statistics(with_labels(docs, labelled_ids(labels, "quality", train, max_labelled)))
    labelled = cut(labelled.select("doc_id", "label", "__stats"))
    k = len(STATISTICS)
    aggs = [f(F.get("__stats", F.lit(i))).alias(f"{n}{i}") for i in range(k) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    moments = labelled.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
    if not moments["n"]:
        return docs.withColumn("score", F.lit(0.5))
    scale = np.array([moments[f"s{i}"] or 1.0 for i in range(k)])
    mapping = FourierMap(np.array([moments[f"m{i}"] for i in range(k)]), np.where(scale < 1e-9, 1.0, scale), size, gamma, seed)
    held = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(4)) == 0
    weights = fit_ridge(labelled.where(~held), mapping, ridge)

    @F.pandas_udf("double")
    def raw_score(stats: pd.Series) -> pd.Series:
        return pd.Series(mapping(np.stack(stats.to_numpy())) @ weights if len(stats) else np.zeros(0))

    knots = isotonic(labelled.where(held).select(raw_score(F.col("__stats")).alias("score"), "label"))

    @F.pandas_udf("double")
    def final(texts: pd.Series) -> pd.Series:
        stats = np.array([statistics(t) for t in texts], dtype=float).reshape(len(texts), k)
        return pd.Series(np.interp(mapping(stats) @ weights, *knots))

    return docs.withColumn("score", final(F.col("text")))
