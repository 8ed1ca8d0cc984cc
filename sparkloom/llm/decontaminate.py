"""Benchmark decontamination with a generalised suffix automaton of the test items.

Training tokens are streamed through an automaton of the items' words and the longest match ending at each
word is tracked. A match of ``window`` words, or of a whole shorter item, marks the words it covers;
documents whose marked words reach the coverage limit are contaminated, and marked spans can be removed
from the others.

An automaton takes about 80 bytes for each byte of item text. Items of at most ``max_bytes`` go into one, whose
texts are broadcast. Beyond that nothing is broadcast, and documents are still read once: each window of an
item, and each window of that many words of a document, is named by the least hash of the runs of ``GRAM`` words
in it, so equal windows have equal names. Names are joined, which tells for each document the few items that it
may share a window with, and an automaton of these items alone judges it.

Tokenizing is one byte translation and a split; a word outside the items' vocabulary, or two words
that never meet in an item, end every match, so only runs of known word pairs are streamed.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import FOLD, arrow_rows, cut
from .minhash import _by_bytes, mix64, word_hashes

WINDOW = 13
#: Java regular expression of a word: digits and letters of ASCII, and everything beyond it.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Text bytes of items in one automaton, which takes about 160 MB, and in one broadcast.
MAX_BYTES = 2_000_000
#: Words of the runs by whose least hash a window is named; texts that a worker gets at once.
GRAM, BATCH_ROWS = 8, 1_000
SPANS = "array<struct<start:int,end:int>>"


_MIXER = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return [] if not isinstance(text, str) else text.encode("utf-8", "surrogatepass").translate(FOLD).split()


class Automaton:
    """Suffix automaton of several word sequences; states know the items of their ``window``-word match."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        coded = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for i, ws in items if ws]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        self.whole: dict[int, set] = {}  # state of a short item's whole text -> its ids
        self.items: dict[int, set] = {}  # state that stands for a window -> ids of the items that hold it
        self.least = window
        for i, codes in coded:
            self.least = min(self.least, len(codes))
            state, n = 0, 0
            for c in codes:
                state, n = self._step(state, n, c)
                if n >= window:
                    self.items.setdefault(self._at(state, window), set()).add(i)
            if len(codes) < window:
                self.whole.setdefault(state, set()).add((len(codes), i))
        size = len(self.vocabulary)
        pairs = {a * size + b for _, codes in coded for a, b in zip(codes, codes[1:])}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _state(self, length: int, following: dict) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        twin = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[twin], self.link[q] = self.link[q], twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def _step(self, state: int, n: int, c: int) -> tuple[int, int]:
        while state and c not in self.next[state]:
            state = self.link[state]
            n = self.length[state]
        if c in self.next[state]:
            return self.next[state][c], n + 1
        return 0, 0

    def _at(self, state: int, n: int) -> int:
        """The state of the last n words of a match that ends in state."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def hits(self, codes: list[int]) -> tuple[list[tuple[int, int]], set]:
        """Marked stretches [start, end) of codes and the ids of the items behind them."""
        state = n = 0
        found, ids = [], set()
        for place, c in enumerate(codes):
            state, n = self._step(state, n, c)
            if n >= self.window:
                found.append((place + 1 - self.window, place + 1))
                ids |= self.items[self._at(state, self.window)]
            if self.whole:
                s = state
                while s > 0:
                    for size, i in self.whole.get(s, ()):
                        if size <= n:
                            found.append((place + 1 - size, place + 1))
                            ids.add(i)
                    s = self.link[s]
        return found, ids

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        if len(ws) < self.least or not self.vocabulary:
            return [], set()
        get = self.vocabulary.get
        codes = np.array([get(w, -1) for w in ws], dtype=np.int64)
        known = codes >= 0
        if self.least > 1:
            pair = codes[:-1] * len(self.vocabulary) + codes[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), max(len(self.pairs) - 1, 0))
            joined = known[:-1] & known[1:] & (self.pairs[at] == pair) if len(self.pairs) else np.zeros(len(pair), bool)
            edge = np.diff(np.concatenate(([0], joined.astype(np.int8), [0])))
            runs = [(s, e + 1) for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)) if e + 1 - s >= self.least]
        else:
            edge = np.diff(np.concatenate(([0], known.astype(np.int8), [0])))
            runs = list(zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)))
        found, ids = [], set()
        for s, e in runs:
            f, i = self.hits(codes[s:e].tolist())
            found += [(int(s) + a, int(s) + b) for a, b in f]
            ids |= i
        return found, ids


def merged(stretches) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


#: The automaton that this worker has built last, by its part's name.
_BUILT: dict[str, Automaton] = {}


def _automaton(name: str, part) -> Automaton:
    if name not in _BUILT:
        _BUILT.clear()
        items, window = part.value
        _BUILT[name] = Automaton([(i, words(t)) for i, t in items], window)
    return _BUILT[name]


def names_of(texts: list[str | None], lengths: list[int]) -> Iterator[np.ndarray]:
    """Distinct names of each text's windows of these numbers of words."""
    hashes, counts = word_hashes(texts)
    for h in np.split(hashes, np.cumsum(counts)[:-1]):
        found = [np.zeros(0, np.uint64)]
        for n in lengths:
            size = min(GRAM, n)
            if len(h) >= n:
                run = np.full(len(h) - size + 1, n, np.uint64)
                for k in range(size):
                    run = mix64(run * _MIXER + h[k:len(h) - size + 1 + k])
                found.append(run if n == size else np.lib.stride_tricks.sliding_window_view(run, n - size + 1).min(axis=1))
        yield np.unique(np.concatenate(found)).view(np.int64)


def named(texts: DataFrame, key: str, lengths: list[int] | None, window: int) -> DataFrame:
    """Distinct (key, name) of the windows of texts; without lengths, of a text's own, ``window`` words or all it has."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in _by_bytes(whole["text"]):
                b = whole.iloc[at]
                if lengths is None:
                    found = [next(names_of([t], [n])) if (n := min(window, len(words(t)))) else np.zeros(0, np.int64) for t in b["text"]]
                else:
                    found = list(names_of(b["text"].tolist(), lengths))
                yield pd.DataFrame({key: np.repeat(b[key].to_numpy(), [len(f) for f in found]), "name": np.concatenate([np.zeros(0, np.int64), *found])})

    return texts.mapInPandas(each, f"{key} {texts.schema[key].dataType.simpleString()}, name long").distinct()


def found_by_names(docs: DataFrame, items: DataFrame, window: int, item_id: str) -> DataFrame:
    """(__digest, __spans, __items) of the distinct texts that items hit, written."""
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        rows = cut(items.where("text IS NOT NULL").select(F.monotonically_increasing_id().alias("item"), F.col(item_id).cast("string").alias("id"), "text"))
        n = F.least(F.regexp_count("text", F.lit(WORD)), F.lit(window))
        lengths = sorted(r[0] for r in rows.select(n.alias("n")).where("n > 0").distinct().collect())  # window numbers at most
        texts = docs.where(F.col("text").isNotNull()).select(F.sha2("text", 256).alias("__digest"), "text")
        wanted = cut(named(rows.select("item", "text"), "item", None, window))
        pairs = cut(named(texts, "__digest", lengths, window).join(wanted, "name").select("__digest", "item").distinct())
        listed = pairs.join(rows, "item").groupBy("__digest").agg(F.collect_list(F.struct("id", "text")).alias("items"))
        once = texts.join(pairs.select("__digest").distinct(), "__digest", "left_semi").groupBy("__digest").agg(F.first("text").alias("text"))

        @F.pandas_udf(f"spans {SPANS}, items array<string>")
        def judge(batch: pd.Series, candidates: pd.Series) -> pd.DataFrame:
            out = []
            for text, some in zip(batch, candidates):
                stretches, ids = Automaton([(x["id"], words(x["text"])) for x in some], window).scan(words(text))
                out.append(([{"start": s, "end": e} for s, e in merged(stretches)], sorted(x for x in map(str, ids))))
            return pd.DataFrame(out, columns=["spans", "items"])

        found = once.join(listed, "__digest").select("__digest", judge.asNondeterministic()("text", "items").alias("h"))
        return cut(found.where(F.size("h.items") > 0).select("__digest", F.col("h.spans").alias("__spans"), F.col("h.items").alias("__items")))


def rest_of(text: str, stretches) -> str:
    """text without the words of the stretches (start, end), each from its first word's first byte to its last word's last."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(FOLD))]
    out, at = [], 0
    for start, end in stretches:
        out.append(raw[at:places[start][0]])
        at = places[end - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def _hits(part):
    """A column function: the text's (n_words, spans, items, rest) by one part's automaton; rest is null without a hit."""
    name = uuid.uuid4().hex

    @F.pandas_udf(f"n_words long, spans {SPANS}, items array<string>, rest string")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            automaton = _automaton(name, part)
            rows = []
            for text in batch:
                ws = words(text)
                found, ids = automaton.scan(ws)
                spans = merged(found)
                rows.append((len(ws), [{"start": s, "end": e} for s, e in spans], sorted(map(str, ids)), rest_of(text, spans) if spans else None))
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items", "rest"])

    return judge.asNondeterministic()  # so that it runs once, not in a filter and again in a projection


@F.pandas_udf(StringType())
def _without_words(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([rest_of(t, [(x["start"], x["end"]) for x in s]) if s is not None and len(s) else None for t, s in zip(texts, spans)], dtype=object)


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_bytes: int = MAX_BYTES, item_id: str = "item_id") -> DataFrame:
    """docs with the column ``__hits``: struct of n_words, spans (in words, disjoint, in order), items (ids as strings,
    sorted) and rest (the text without the spans, null without any)."""
    own = benchmark.select(item_id, "text")
    if (own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= max_bytes:
        items = [(r[0], r[1]) for r in own.where(F.col("text").isNotNull()).collect()]  # max_bytes at most
        return docs.withColumn("__hits", _hits(docs.sparkSession.sparkContext.broadcast((items, window)))(F.col("text")))
    found = found_by_names(docs.select("text"), own, window, item_id)
    n_words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    out = docs.withColumn("__key", F.sha2("text", 256)).join(found, F.col("__key") == F.col("__digest"), "left")
    hits = F.struct(n_words.alias("n_words"), F.coalesce("__spans", F.array().cast(SPANS)).alias("spans"), F.coalesce("__items", F.array().cast("array<string>")).alias("items"), _without_words("text", "__spans").alias("rest"))
    return out.withColumn("__hits", hits).drop("__key", "__digest", "__spans", "__items")


def _n_hit():
    return F.aggregate("__hits.spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]).cast("long")


def _contaminated(hits_of_words: int):
    return (_n_hit() > 0) & (hits_of_words * _n_hit() >= F.col("__hits.n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, hits_of_words: int = 20, max_bytes: int = MAX_BYTES, item_id: str = "item_id") -> DataFrame:
    """docs with ``n_words, n_hit, n_items, items, hit_spans, contaminated`` added (replacing such columns).

    items: ids as strings, sorted; hit_spans: array of (start, end) in words. contaminated: n_hit > 0 and
    hits_of_words * n_hit >= n_words. Null texts have no words and are never contaminated; a null item text
    is no item; repeated rows are judged alike, each on its own; long texts are streamed whole. Empty
    documents or benchmark give empty or clean results.
    """
    out = judged(docs, benchmark, window, max_bytes, item_id)
    return out.withColumns({
        "n_words": F.col("__hits.n_words"), "n_hit": _n_hit(), "n_items": F.size("__hits.items").cast("long"), "items": F.col("__hits.items"),
        "hit_spans": F.col("__hits.spans"), "contaminated": _contaminated(hits_of_words),
    }).drop("__hits")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, hits_of_words: int = 20, max_bytes: int = MAX_BYTES, item_id: str = "item_id") -> DataFrame:
    """docs without contaminated rows, and without the hit words of the others; columns stay as they are.

    ``n_chars``, where docs has it, follows the text. Spans are judged on the input, not on what is left.
    Rows without a hit, null texts among them, come out unchanged; see contamination() for the other cases.
    """
    out = judged(docs, benchmark, window, max_bytes, item_id).where(~_contaminated(hits_of_words))
    some = F.col("__hits.rest").isNotNull()
    out = out.withColumn("text", F.coalesce("__hits.rest", "text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(some, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
