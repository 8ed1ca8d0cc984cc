"""Personal data by a skip-chain conditional random field over the tokens that could be part of any.

The base patterns give certain spans. Around them stands a graph for each document: its nodes are the tokens that
hold a digit or an ``@``, all other tokens being labelled as outside, so the chain falls into the runs of adjacent
nodes. Besides the chain's edges there are skip edges between tokens of a document that repeat or resemble each
other (equal digits, equal last seven digits, equal letters and digits), from each to the one before, so the edges
grow with the tokens. Tokens of base spans keep their labels; loopy sum-product message passing, a fixed number of
rounds, carries them along both kinds of edges to the others. Runs of tokens that are then of one kind, and are a
possible value of it, become further spans.

The potentials are learned from a bounded sample of the documents: those of tokens and adjacent labels by
pseudo-likelihood, a multinomial logistic regression of a token's base label on its shape and on the labels next to
it; that of a skip edge is the log-odds with which linked tokens are of one kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(1, 5)
LABELS = 1 + len(KINDS)
#: What is taken for seen, besides the sample, of linked tokens that are of one kind and of those that aren't.
PRIOR = (20, 1)
#: Documents that the potentials are learned from.
MAX_SAMPLED = 20_000
#: A token joins a further span from this probability on.
LEAST = 0.9
ROUNDS = 20
#: Texts that a worker gets at once.
BATCH_ROWS = 500

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TAIL = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_RUN = re.compile(r"[0-9]+|@")
#: Characters that end a token, beside white space.
_BREAKS = frozenset(",;:<>\"'=|[]{}!?#$*&")
_REST = re.compile(r"[^\s,;:<>\"'=|\[\]{}!?#$*&]*")
_CUES = tuple(re.compile(rf"(?i)(?:{words})\W{{0,3}}$") for words in (
    "e-?mail|mail|contact|correo|courriel", "ip|host|server|address", "card|visa|mastercard|tarjeta|carte|karte", "phone|tel|call|mobile|fax|telefon|teléfono|téléphone"))

Span = tuple[int, int, int]


# Base spans -----------------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[Span]:
    """(start, end, label) of the base patterns' matches that hold, by start and kind. Linear in the text."""
    out: list[Span] = []
    end = 0
    for m in _TAIL.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            end = m.end()
            out.append((start, end, EMAIL))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isascii() and c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), m.end(), PHONE))
    runs = [m.span() for m in _RUN.finditer(text) if text[m.start()] != "@"]
    chained = lambda i, marks: i + 1 < len(runs) and runs[i][1] + 1 == runs[i + 1][0] and text[runs[i][1]] in marks
    i = 0
    while i + 3 < len(runs):
        if chained(i, ".") and chained(i + 1, ".") and chained(i + 2, "."):
            if all(_small(text[s:e]) for s, e in runs[i:i + 4]):
                out.append((runs[i][0], runs[i + 3][1], IP))
            i += 4
        else:
            i += 1
    i = 0
    while i < len(runs):
        j = i
        while chained(j, " -"):
            j += 1
        if 12 <= sum(e - s for s, e in runs[i:j + 1]) <= 19 and luhn("".join(text[s:e] for s, e in runs[i:j + 1])):
            out.append((runs[i][0], runs[j][1], CARD))
        i = j + 1
    return sorted(out, key=lambda s: (s[0], s[2]))


# The graph ------------------------------------------------------------------------------------------


class Graph(NamedTuple):
    """A document's tokens: places, features, base labels (-1: open), whether the token before is adjacent, skip edges."""

    tokens: list[tuple[int, int]]
    features: list[list[float]]
    labels: list[int]
    chained: list[bool]
    skips: list[tuple[int, int]]


def tokens_of(text: str) -> list[tuple[int, int]]:
    """Places of the tokens that hold a digit or an @; each character is looked at once or twice."""
    out, end = [], 0
    for m in _RUN.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and not (c := text[start - 1]).isspace() and c not in _BREAKS:
            start -= 1
        end = _REST.match(text, m.end()).end()
        out.append((start, end))
    return out


def features(token: str, before: str) -> list[float]:
    """The token's shape, and whether a word that announces a kind stands before it."""
    digits = "".join(c for c in token if "0" <= c <= "9")
    core, n = token.strip(".()-/_"), len(digits)
    letters = sum(c.isalpha() for c in core)
    parts = core.split(".")
    quad = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
    at = core.find("@")
    said = [
        at > 0, at > 0 and "." in core[at:].strip("."), token.startswith("+"), "(" in token or ")" in token, "-" in core and not letters,
        quad and all(map(_small, parts)), quad and not all(map(_small, parts)), core.isascii() and core.isdigit(),
        1 <= n <= 2, 3 <= n <= 4, 5 <= n <= 8, 9 <= n <= 11, 12 <= n <= 19, n > 19, 12 <= n <= 19 and luhn(digits), letters > 0, letters > n, at < 0 and letters > 0 and n > 8,
    ]
    return [float(x) for x in said] + [float(bool(cue.search(before))) for cue in _CUES]


WIDTH = 18 + len(_CUES)


def _keys(token: str) -> list[tuple[str, str]]:
    digits = "".join(c for c in token if "0" <= c <= "9")
    folded = "".join(c for c in token.lower() if c.isalnum())
    out = [("word", folded)] if len(folded) >= 3 and folded != digits else []
    if len(digits) >= 3:
        out.append(("digits", digits))
    if len(digits) >= 7 and "@" not in token:
        out.append(("end", digits[-7:]))
    return out


def graph_of(text: str, spans: list[Span]) -> Graph:
    tokens = tokens_of(text)
    labels, chained, shapes, skips, last, k = [], [], [], [], {}, 0
    for i, (start, end) in enumerate(tokens):
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        over = [s for s in spans[k:k + 4] if s[0] < end and s[1] > start]
        labels.append(over[0][2] if over else -1)
        gap = text[tokens[i - 1][1]:start] if i else "  "
        chained.append(bool(i) and len(gap) <= 2 and all(c.isspace() or c in _BREAKS for c in gap))
        token = text[start:end]
        shapes.append(features(token, text[max(0, start - 24):start]))
        seen = set()
        for key in _keys(token):
            if key in last and last[key] not in seen:
                seen.add(last[key])
                skips.append((last[key], i))
            last[key] = i
    return Graph(tokens, shapes, labels, chained, skips)


# Potentials -----------------------------------------------------------------------------------------


class Potentials(NamedTuple):
    """Log-potentials: of a token's features, of a label without any, of adjacent labels, of an agreeing skip edge."""

    weights: np.ndarray
    bias: np.ndarray
    chain: np.ndarray
    agree: float


def _examples(text: str) -> Iterator[tuple[list[float], float, int, int]]:
    """Each token's features and neighbours' labels, its base label, and, if it is of a kind, how many linked tokens are of that kind and of none."""
    g = graph_of(text, base_spans(text))
    labels = [max(x, 0) for x in g.labels]
    alike, unlike = [0] * len(labels), [0] * len(labels)
    for a, b in g.skips:
        for x, y in ((a, b), (b, a)):
            alike[x] += 0 < labels[x] == labels[y]
            unlike[x] += labels[x] > 0 == labels[y]
    for i, label in enumerate(labels):
        near = np.zeros((2, LABELS))
        near[0, labels[i - 1] if g.chained[i] else 0] = 1
        near[1, labels[i + 1] if i + 1 < len(labels) and g.chained[i + 1] else 0] = 1
        yield [*g.features[i], *near.ravel().tolist()], float(label), alike[i], unlike[i]


def fit(docs: DataFrame, max_sampled: int = MAX_SAMPLED) -> Potentials | None:
    """Potentials learned from at most max_sampled documents, chosen by a hash of doc_id; None without base spans."""
    ids = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_sampled)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [x for text in b["text"] for x in _examples(text)]
            yield pd.DataFrame(found, columns=["x", "label", "alike", "unlike"])

    sample = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(ids), "doc_id").select("text")
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        rows = sample.mapInPandas(each, "x array<double>, label double, alike long, unlike long").select(array_to_vector("x").alias("features"), "label", "alike", "unlike").persist()
        try:
            seen = rows.agg(F.countDistinct("label").alias("labels"), F.sum("alike").alias("alike"), F.sum("unlike").alias("unlike")).first()
            if seen.labels < 2:
                return None
            model = LogisticRegression(family="multinomial", regParam=1e-3, standardization=False, maxIter=60).fit(rows)
        finally:
            rows.unpersist()
    got, bias = np.zeros((LABELS, WIDTH + 2 * LABELS)), np.full(LABELS, -20.0)
    coefficients = model.coefficientMatrix.toArray()
    got[:len(coefficients)] = coefficients
    bias[:len(coefficients)] = np.maximum(np.nan_to_num(model.interceptVector.toArray(), neginf=-20.0), -20.0)
    before, after = got[:, WIDTH:WIDTH + LABELS], got[:, WIDTH + LABELS:]
    agree = float(np.clip(np.log((seen.alike + PRIOR[0]) / (seen.unlike + PRIOR[1])), 0.0, 4.0))
    return Potentials(got[:, :WIDTH], bias, (before.T + after) / 2, agree)


def beliefs(unary: np.ndarray, ends: np.ndarray, kind: np.ndarray, tables: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Marginals by damped loopy sum-product. ends: (edge, 2); kind: which of the tables an edge has."""
    a, b = ends[:, 0], ends[:, 1]
    pot = tables[kind]
    to_b, to_a = np.zeros((len(a), unary.shape[1])), np.zeros((len(a), unary.shape[1]))

    def sent(state: np.ndarray, table: np.ndarray) -> np.ndarray:
        x = state[:, :, None] + table
        top = x.max(axis=1)
        out = top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))
        return out - out.max(axis=1, keepdims=True)

    def total() -> np.ndarray:
        out = unary.copy()
        np.add.at(out, b, to_b)
        np.add.at(out, a, to_a)
        return out

    for _ in range(rounds if len(a) else 0):
        state = total()
        new_b, new_a = sent(state[a] - to_a, pot), sent(state[b] - to_b, pot.transpose(0, 2, 1))
        to_b, to_a = (to_b + new_b) / 2, (to_a + new_a) / 2
    state = total()
    p = np.exp(state - state.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def marginals(graphs: list[Graph], model: Potentials) -> list[np.ndarray]:
    """Each graph's token probabilities by label; all graphs go through the message passing together."""
    sizes = [len(g.tokens) for g in graphs]
    if not sum(sizes):
        return [np.zeros((0, LABELS)) for _ in graphs]
    unary = np.array([f for g in graphs for f in g.features]) @ model.weights.T + model.bias
    labels = np.array([x for g in graphs for x in g.labels])
    chained = np.array([c for g in graphs for c in g.chained])
    follows = np.append(chained[1:], False)
    unary += np.where(chained[:, None], 0.0, model.chain[0]) + np.where(follows[:, None], 0.0, model.chain[:, 0])
    fixed = np.flatnonzero(labels >= 0)
    unary[fixed] = -50.0
    unary[fixed, labels[fixed]] = 0.0
    links = np.flatnonzero(chained)
    first = np.concatenate(([0], np.cumsum(sizes)))
    skips = np.array([(first[k] + a, first[k] + b) for k, g in enumerate(graphs) for a, b in g.skips], dtype=np.int64).reshape(-1, 2)
    ends = np.concatenate((np.stack((links - 1, links), axis=1), skips))
    kind = np.repeat([0, 1], [len(links), len(skips)])
    p = beliefs(unary, ends, kind, np.stack((model.chain, np.eye(LABELS) * model.agree)))
    return np.split(p, first[1:-1])


# Spans ----------------------------------------------------------------------------------------------


def possible(value: str, label: int, endings: set[str] = frozenset()) -> bool:
    """Whether the text could be a value of the kind at all; endings: last seven digits of the text's base phones."""
    digits = "".join(c for c in value if "0" <= c <= "9")
    if label == EMAIL:
        name, _, host = value.partition("@")
        return bool(re.search(r"\w", name) and re.search(r"\w", host))
    if label == IP:
        parts = re.findall("[0-9]+", value)
        return len(parts) == 4 and all(map(_small, parts))
    if label == CARD:
        return 12 <= len(digits) <= 19 and luhn(digits)
    if re.search(r"[^\W\d_]|@", value) or not 7 <= len(digits) <= 15:
        return False
    return digits[-7:] in endings or len(digits) >= 9 and ("+" in value or "(" in value or len(re.findall(r"[0-9]+", value)) > 2)


def further_spans(text: str, g: Graph, p: np.ndarray, least: float = LEAST) -> list[Span]:
    """Runs of adjacent open tokens of one kind, without the marks around them, that are a possible value of it."""
    out, i, n = [], 0, len(g.tokens)
    phones = ("".join(c for c in text[s:e] if "0" <= c <= "9") for (s, e), label in zip(g.tokens, g.labels) if label == PHONE)
    endings = {d[-7:] for d in phones if len(d) >= 7}
    best = p.argmax(axis=1) if n else []
    open_ = [g.labels[k] < 0 and best[k] > 0 and p[k, best[k]] >= least for k in range(n)]
    while i < n:
        j = i + 1
        if open_[i]:
            while j < n and open_[j] and g.chained[j] and best[j] == best[i]:
                j += 1
            start, end = g.tokens[i][0], g.tokens[j - 1][1]
            while start < end and not (text[start].isalnum() or text[start] == "+" or text[start] == "(" and best[i] == PHONE):
                start += 1
            while end > start and not text[end - 1].isalnum():
                end -= 1
            if possible(text[start:end], int(best[i]), endings):
                out.append((start, end, int(best[i])))
        i = j
    return out


def personal_spans(docs: DataFrame, model: Potentials | None, least: float = LEAST) -> DataFrame:
    """docs with personal_spans, an array of (kind, start, end, base) by start and kind; ends are exclusive code points.

    base tells matches of the base patterns from spans that the model adds. Null and empty texts have none; texts
    are read whole, however long; rows are judged each on its own, so repeated rows agree. Of kinds that match at
    one place all are given; a token under several base spans takes the first one's label. Other columns come
    through, but one named personal_spans is replaced. Without a model only base spans are given. No rows in, none out.
    """

    def found(batch: list[str | None]) -> list[list[dict]]:
        texts = [t or "" for t in batch]
        base = [base_spans(t) for t in texts]
        more: list[list[Span]] = [[] for _ in texts]
        if model is not None:
            graphs = [graph_of(t, s) for t, s in zip(texts, base)]
            more = [further_spans(t, g, p, least) for t, g, p in zip(texts, graphs, marginals(graphs, model))]
        each = [sorted([(*s, True) for s in b] + [(*s, False) for s in m], key=lambda s: (s[0], s[2])) for b, m in zip(base, more)]
        return [[{"kind": KINDS[k - 1], "start": s, "end": e, "base": own} for s, e, k, own in spans] for spans in each]

    @F.pandas_udf("array<struct<kind string, start int, end int, base boolean>>")
    def spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(found(batch.tolist()), index=batch.index, dtype=object)

    return docs.withColumn("personal_spans", spans(F.col("text")))
