"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of lexicon words (a short fixed list and one mined from labelled rows:
words and word beginnings far likelier in toxic texts), how many of them stand near a second-person
word, capitals, punctuation, and rates of obfuscated words (letters mixed with digits or masks).

Labelled rows (a bounded sample, chosen by hash of the id) are dealt by another hash to three parts:
one mines the lexicon, one fits the trees, one calibrates.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, MAX_LABELLED, cut, isotonic, labelled_ids, with_labels

#: Insults that count without any labels.
INSULTS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb jerk imbecile idiota estupido imbécil basura idiote imbécile ordure dummkopf trottel abschaum"
#: Second-person words of the languages met.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deiner ihr euch sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros"
LEET = bytes.maketrans(b"0134578@$", b"oieastbas")
NEAR = 5
#: Lengths, in bytes, of the word beginnings that are mined.
BEGINNINGS = (4, 5, 6)
#: An entry stands in this share of the toxic texts that the lexicon is mined from, at least, so there are at
#: most 1 / LEAST_SHARE times as many entries as a toxic text has keys on the average.
LEAST_SHARE = 0.002
#: Part of the score that comes straight from the trees, so that it orders texts which calibration puts level.
RAW_SHARE = 0.01
UPPER = bytes(range(65, 91))
MASKED = re.compile(rb"[A-Za-z\x80-\xff]+[*@$#0-9!]+[A-Za-z\x80-\xff]+")

FEATURES = ("hits", "density", "best", "weight", "near_you", "fixed", "you", "capitals", "exclaims", "marks", "obfuscated", "log_words")


def keys_of(word: bytes) -> list[bytes]:
    return [b"=" + word, *(word[:n] for n in BEGINNINGS if len(word) > n)]


def _words(raw: bytes) -> list[bytes]:
    return raw.translate(FOLD).split()


def features(text: str | None, lexicon: dict[bytes, float]) -> list[float]:
    """FEATURES of a text; an empty or null text has all of them 0."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
    ws = _words(raw)
    masked = MASKED.findall(raw)
    plain = [m.translate(LEET).lower() for m in masked]
    if not ws:
        return [0.0] * len(FEATURES)
    weights: dict[bytes, float] = {}
    for w in {*ws, *plain}:
        best = max([lexicon.get(b"=" + w, 0.0), *(lexicon.get(w[:n], 0.0) for n in BEGINNINGS if len(w) > n)])
        if best or w in _INSULTS:
            weights[w] = best or 1.0
    you = [i for i, w in enumerate(ws) if w in _SECOND]
    places = [i for i, w in enumerate(ws) if w in weights] if weights else []
    hits = len(places) + sum(w in weights for w in plain)
    at = np.searchsorted(you, places) if you and places else []
    near = sum(1 for p, k in zip(places, at) if (k < len(you) and you[k] - p <= NEAR) or (k and p - you[k - 1] <= NEAR))
    n, letters = len(ws), max(1, len(raw))
    return [
        float(min(hits, 20)), hits / n, max(weights.values(), default=0.0), sum(weights.values()) / math.sqrt(n), near / n,
        float(sum(w in _INSULTS for w in weights)), len(you) / n, (len(raw) - len(raw.translate(None, UPPER))) / letters,
        raw.count(b"!") / n, sum(raw.count(c) for c in (b"?", b".", b",", b"*", b"#", b"$")) / n, len(masked) / n, math.log1p(n),
    ]


_INSULTS = {w.encode() for w in INSULTS.split()}
_SECOND = {w.encode() for w in SECOND_PERSON.split()}


def mine_lexicon(labelled: DataFrame, least: int = 4, least_odds: float = 2.5) -> dict[bytes, float]:
    """Words and beginnings by their log odds of standing in a toxic text; LEAST_SHARE bounds their number."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts: dict[bytes, list[int]] = {}
            for text, label in zip(b["text"], b["label"]):
                ws = _words(text.encode("utf-8", "surrogatepass")) if isinstance(text, str) else []
                for k in {k for w in set(ws) for k in keys_of(w)}:
                    counts.setdefault(k, [0, 0])[int(label)] += 1
            yield pd.DataFrame({"key": list(counts), "clean": [c[0] for c in counts.values()], "toxic": [c[1] for c in counts.values()]})

    n = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return {}
    seen = labelled.select("text", "label").mapInPandas(explode, "key binary, clean long, toxic long")
    seen = seen.groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("toxic") >= max(least, LEAST_SHARE * n[1]))
    odds = F.log((F.col("toxic") + 0.1) / n[1]) - F.log((F.col("clean") + 0.1) / n[0])
    top = seen.withColumn("odds", odds).where(F.col("odds") >= least_odds)
    return {bytes(r["key"]): float(r["odds"]) for r in top.collect()}


def with_features(docs: DataFrame, lexicon: dict[bytes, float]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # LEAST_SHARE bounds its entries

    @F.pandas_udf("array<double>")
    def compute(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value
        for batch in texts:
            yield pd.Series([features(t, known) for t in batch])

    return docs.withColumn("__features", compute(F.col("text")))


def toxicity(docs: DataFrame, labels: DataFrame, train, max_labelled: int = MAX_LABELLED, trees: int = 20, seed: int = 11) -> DataFrame:
    """docs with ``score`` (0 to 1) added, replacing such a column.

    train: condition on doc_id for rows whose labels may be used. Null and empty texts are scored by the
    same model, from features of 0; long texts are read whole. Without labels of both kinds the score is the
    share of toxic labels (0.0 with none). Rows of equal texts get equal scores; other columns come through,
    whatever their names; an empty table gives an empty result.
    """
    docs = docs.select(*[c for c in docs.columns if c != "score"])
    labelled = cut(with_labels(docs, labelled_ids(labels, "toxic", train, max_labelled)))
    part = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(5))
    lexicon = mine_lexicon(labelled.where(part < 2))
    rest = cut(with_features(labelled.where(part >= 2).withColumn("part", part), lexicon).select("label", "part", array_to_vector("__features").alias("__features")).repartition(6))
    fitting = rest.where("part < 4")
    kinds = {r["label"]: r["n"] for r in fitting.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        return docs.withColumn("score", F.lit(float(kinds.get(1, 0) > 0)))
    boosted = GBTClassifier(featuresCol="__features", labelCol="label", maxIter=trees, maxDepth=4, stepSize=0.25, seed=seed)
    for param, column in ((boosted.rawPredictionCol, "__raw"), (boosted.probabilityCol, "__p"), (boosted.predictionCol, "__label")):
        boosted.set(param, column)
    model = boosted.fit(fitting)
    probability = F.get(vector_to_array("__p"), F.lit(1))
    knots = isotonic(model.transform(rest.where("part = 4")).select(probability.alias("score"), "label"))
    out = with_features(docs, lexicon).withColumn("__features", array_to_vector("__features"))
    return model.transform(out).select(*docs.columns, ((1 - RAW_SHARE) * calibrated(probability, *knots) + RAW_SHARE * probability).alias("score"))


def calibrated(score, boundaries: list[float], values: list[float]):
    """Piecewise-linear interpolation between the knots, as built-in functions."""
    if len(boundaries) == 1:
        return F.lit(values[0])
    slope = lambda k: (values[k + 1] - values[k]) / (boundaries[k + 1] - boundaries[k]) if boundaries[k + 1] > boundaries[k] else 0.0
    knots = F.array(*[F.struct(F.lit(boundaries[k]).alias("x"), F.lit(values[k]).alias("y"), F.lit(slope(k)).alias("m")) for k in range(len(boundaries) - 1)])
    below = F.filter(knots, lambda k: k["x"] <= score)
    last = F.get(below, F.size(below) - 1)
    line = last["y"] + last["m"] * (F.least(score, F.lit(boundaries[-1])) - last["x"])
    return F.coalesce(line, F.lit(values[0]))
