"""Toxicity and quality scores against plain re-computations of each step."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.llm import quality, toxicity
from sparkloom.llm.common import isotonic

TEXTS = st.one_of(st.text(max_size=80), st.lists(st.sampled_from(["You", "your", "idiot", "id!ot", "st*pid", "fine", "Fine", "word!", "a|b", "x\n", "\n\n", "12", "Été", "...", "the the the"]), max_size=25).map(" ".join))


def plain_words(text):
    """Words of ASCII letters and digits and of everything beyond ASCII, A-Z lower-cased."""
    return [w.translate({i: i + 32 for i in range(65, 91)}) for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text)]


def plain_statistics(text):
    """The named statistics of a text by counting characters."""
    data = text.encode("utf-8", "surrogatepass")
    ws = [w for w in re.split(rb"[ \t\n\r\x0b\f]+", data) if w]
    if not ws:
        return dict.fromkeys(quality.STATISTICS, 0.0)
    n, size, count = len(ws), len(data), Counter(data)
    lines = [x for x in data.split(b"\n") if re.search(rb"[^ \t\n\r\x0b\f]", x)]
    triples = Counter(zip(ws, ws[1:], ws[2:]))
    folded = [w.encode("utf-8", "surrogatepass") for w in plain_words(text)]
    among = lambda chars: sum(count[c] for c in chars)
    return {
        "log_chars": math.log(1 + size), "log_words": math.log(1 + n), "word_length": size / n, "longest": math.log(max(len(w) for w in ws)), "upper": among(range(65, 91)) / size, "digits": among(range(48, 58)) / size,
        "symbols": among(b"#*$%&<>") / n, "bars": count[124] / n, "exclaims": count[33] / n, "stops": count[46] / n, "commas": count[44] / n, "non_ascii": among(range(128, 256)) / size,
        "lines": len(lines) / n, "dup_lines": 1 - len(set(lines)) / len(lines), "variety": len(set(ws)) / n, "common": sum(map(len, folded)) / size, "repeats": 1 - len(triples) / (n - 2) if n > 2 else 0.0, "tokens": len(folded) / n,
    }


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_statistics_by_counting(text):
    assert quality.statistics(text) == pytest.approx([plain_statistics(text)[k] for k in quality.STATISTICS])


def test_statistics_of_null_and_long_texts():
    assert quality.statistics(None) == quality.statistics("") == quality.statistics(" \n") == [0.0] * len(quality.STATISTICS)
    long = "word, " * 200_000
    assert quality.statistics(long) == pytest.approx([plain_statistics(long)[k] for k in quality.STATISTICS])


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 6))
    mapping = quality.FourierMap(np.zeros(6), np.ones(6), 20_000, 0.05, 3)
    near = mapping(x)[:, :20_000] @ mapping(x)[:, :20_000].T
    want = np.exp(-0.05 * ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    assert np.abs(near - want).max() < 0.05


@pytest.mark.parametrize("parts", [1, 5])
def test_ridge_against_one_solve(spark, parts):
    rng = np.random.default_rng(2)
    stats, label = rng.normal(size=(70, 4)), rng.integers(0, 2, 70)
    mapping = quality.FourierMap(stats.mean(axis=0), stats.std(axis=0), 12, 0.05, 5)
    rows = spark.createDataFrame([(x.tolist(), int(y)) for x, y in zip(stats, label)], "__stats array<double>, label int").repartition(parts)
    x = mapping(stats)
    want = np.linalg.lstsq(np.vstack([x, math.sqrt(0.1) * np.eye(x.shape[1])]), np.concatenate([label, np.zeros(x.shape[1])]), rcond=None)[0]
    assert np.allclose(quality.fit_ridge(rows, mapping, 0.1), want, atol=1e-8)


def pooled(points):
    """Isotonic fit by pooling neighbours that are out of order: value of each point's score."""
    blocks = []
    for score in sorted({s for s, _ in points}):
        labels = [y for s, y in points if s == score]
        blocks.append([sum(labels) / len(labels), len(labels), [score]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, n, scores = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + v * n) / (blocks[-1][1] + n), blocks[-1][1] + n, blocks[-1][2] + scores]
    return {s: v for v, _, scores in blocks for s in scores}


def test_calibration_pools_and_interpolates(spark):
    r = random.Random(5)
    points = [(round(s, 2), int(r.random() < s)) for s in (r.random() for _ in range(120))]
    x, y = isotonic(spark.createDataFrame(points, "score double, label int").repartition(4))
    for s, want in pooled(points).items():
        assert np.interp(s, x, y) == pytest.approx(want)
    grid = [-1.0, 0.0, 0.131, 0.5, 0.777, 1.0, 2.0]
    got = [v[0] for v in spark.createDataFrame([(g,) for g in grid], "s double").select(toxicity.calibrated(F.col("s"), x, y)).collect()]
    assert got == pytest.approx([float(np.interp(g, x, y)) for g in grid])
    assert isotonic(spark.createDataFrame([], "score double, label int")) == ([0.0, 1.0], [0.0, 1.0])
    assert isotonic(spark.createDataFrame([(0.5, 1)] * 3 + [(0.5, 0)], "score double, label int"))[1][0] == 0.75


def test_quality_scores_are_the_steps_put_together(spark):
    """The operator's score is what its parts give when they are put together on the driver."""
    r = random.Random(7)
    texts = [" ".join(r.choice(["good", "prose", "and", "more."]) if i % 2 else r.choice(["BUY!!", "#$%", "1|2", "now!!!"]) for _ in range(r.randint(5, 60))) for i in range(240)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 240, 2)] + [(i, 1) for i in range(1, 240, 2)], "doc_id long, quality int")
    got = {x.doc_id: x.score for x in quality.quality(docs, labels, train=lambda k: k % 3 != 0).collect()}
    held = {x[0] for x in docs.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(4)) == 0).select("doc_id").collect()}
    train = [i for i in range(240) if i % 3]
    stats = np.array([quality.statistics(t) for t in texts])
    mine = stats[train]
    scale = mine.std(axis=0)
    mapping = quality.FourierMap(mine.mean(axis=0), np.where(scale < 1e-9, 1.0, scale), 96, 0.05, 5)
    fit = [i for i in train if i not in held]
    x = mapping(stats[fit])
    weights = np.linalg.solve(x.T @ x + 0.1 * np.eye(x.shape[1]), x.T @ np.array([i % 2 for i in fit], float))
    raw = mapping(stats) @ weights
    knots = pooled([(raw[i], i % 2) for i in train if i in held])
    want = np.interp(raw, sorted(knots), [knots[s] for s in sorted(knots)])
    assert [got[i] for i in range(len(texts))] == pytest.approx(want.tolist(), abs=1e-6)
    assert np.mean([(got[i] > 0.5) == (i % 2 == 1) for i in range(0, 240, 3)]) > 0.95


def plain_lexicon(rows, least=4, least_odds=2.5):
    """Log odds of words and beginnings by counting the texts they stand in."""
    n = Counter(y for _, y in rows)
    seen = {0: Counter(), 1: Counter()}
    for text, y in rows:
        ws = {w.encode() for w in plain_words(text or "")}
        seen[y].update({b"=" + w for w in ws} | {w[:k] for w in ws for k in toxicity.BEGINNINGS if len(w) > k})
    odds = {k: math.log((t + 0.1) / n[1]) - math.log((seen[0][k] + 0.1) / n[0]) for k, t in seen[1].items() if t >= max(least, toxicity.LEAST_SHARE * n[1])}
    return {k: v for k, v in odds.items() if v >= least_odds}


def toxic_rows(n=300, seed=3):
    r = random.Random(seed)
    plain = ["the", "of", "and", "house", "River", "été", "you", "walks"]
    nasty = ["gruntle", "gruntled", "gruntling", "you", "YOUR", "blarg!"]
    return [(" ".join(r.choice(plain + (nasty if i % 4 == 0 else [])) for _ in range(r.randint(3, 40))), int(i % 4 == 0)) for i in range(n)]


def test_lexicon_against_counting(spark):
    rows = toxic_rows() + [(None, 0), ("", 1)]
    got = toxicity.mine_lexicon(spark.createDataFrame(rows, "text string, label int").repartition(3))
    want = plain_lexicon(rows)
    assert want and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert toxicity.mine_lexicon(spark.createDataFrame([("a", 0)], "text string, label int")) == {}


def plain_features(text, lexicon):
    """The named features of a text, word by word."""
    data, ws = (text or "").encode("utf-8", "surrogatepass"), [w.encode("utf-8", "surrogatepass") for w in plain_words(text or "")]
    if not ws:
        return dict.fromkeys(toxicity.FEATURES, 0.0)
    masked = re.findall(rb"[A-Za-z\x80-\xff]+[*@$#0-9!]+[A-Za-z\x80-\xff]+", data)
    spelt = [bytes(dict(zip(b"0134578@$", b"oieastbas")).get(c, c) for c in m).lower() for m in masked]
    insults, second = {w.encode() for w in toxicity.INSULTS.split()}, {w.encode() for w in toxicity.SECOND_PERSON.split()}

    def weight(w):
        known = [lexicon[k] for k in [b"=" + w, *(w[:n] for n in toxicity.BEGINNINGS if len(w) > n)] if k in lexicon]
        return max(known, default=0.0) or float(w in insults)

    bad = {w: weight(w) for w in {*ws, *spelt} if weight(w)}
    places, you, n = [i for i, w in enumerate(ws) if w in bad], [i for i, w in enumerate(ws) if w in second], len(ws)
    hits = len(places) + sum(w in bad for w in spelt)
    count = Counter(data)
    return {
        "hits": min(hits, 20), "density": hits / n, "best": max(bad.values(), default=0.0), "weight": sum(bad.values()) / math.sqrt(n), "near_you": sum(any(abs(p - y) <= toxicity.NEAR for y in you) for p in places) / n,
        "fixed": sum(w in insults for w in bad), "you": len(you) / n, "capitals": sum(count[c] for c in range(65, 91)) / max(1, len(data)), "exclaims": count[33] / n, "marks": sum(count[c] for c in b"?.,*#$") / n, "obfuscated": len(masked) / n, "log_words": math.log(1 + n),
    }


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_toxicity_features_word_by_word(text):
    lexicon = {b"=fine": 3.0, b"stup": 2.75, b"id": 9.0, b"=the": 2.6, b"idio": 4.0}
    want = plain_features(text, lexicon)
    assert toxicity.features(text, lexicon) == pytest.approx([want[k] for k in toxicity.FEATURES])


def test_toxicity_of_held_out_texts(spark):
    rows = toxic_rows(500, seed=12)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    got = {x.doc_id: x.score for x in toxicity.toxicity(docs, labels, train=lambda k: k % 5 != 0).collect()}
    held = [i for i in range(500) if i % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == bool(rows[i][1]) for i in held]) > 0.9 and 0 <= min(got.values()) and max(got.values()) <= 1
    assert got[900] == got[901] < 0.5
