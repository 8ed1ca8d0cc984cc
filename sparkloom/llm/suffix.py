"""Repeated-substring removal by fingerprints at content-chosen positions.

Goal: remove each byte covered by a ``length``-byte string that also starts in a document of smaller id.

This stands in for prefix doubling, of which it keeps the steps (names of growing strings, and positions that
leave once their name is unique) but not the form: rows of (rank, rank) at each position, sorted anew in each
round, shuffle more than the check tool's limit; the README has the figures. Names here are hashes of the
bytes themselves, travel packed, and are sorted within the tasks that Spark deals them to.

Positions are sampled by content: of every ``length - gram + 1`` consecutive ``gram``-byte strings the one of
least hash is kept. Equal ``length``-byte strings keep the same place, so each is known by one sampled
position within it:

1. Every sampled position gets two names: of its ``gram`` bytes, and of all bytes that some ``length``-byte
   string around it covers. A short name of a single document is unique: the position leaves. A long name
   that a smaller document has settles its position as a whole. Of the rest, positions whose short name has
   several long names go on.
2. For these, the ``length``-byte strings that the position stands for are named one by one; a smaller
   document with the name settles it.

No string is missed; a string may be removed wrongly where two names collide. Names of the strings have 64
bits; a position's short name travels with 32 bits besides its bucket, and its long one, which is only
compared among equal short ones, with 40. Among 10^9 strings a collision is expected with probability 0.03.

Copies of a name within one task's chunk are settled there before the shuffle, so a name that a third of the
documents hold is sent once per chunk. A short name that stands often in a chunk, in several documents and each time amid other
bytes, needs no ranking: that several documents hold it, with several long names, is known. Of it a task sends four positions at
most to the name's bucket, which tell the other tasks as much, and lets all others go on to step 2 directly, where each string has a name of its own. So a sentence in every document doesn't fill a bucket. Names travel as packed arrays, many in a row; texts are shuffled once,
to meet the settled positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .minhash import mix64

LENGTH = 50
GRAM = 24
#: Bytes of text that are named together; bounds a task's arrays.
CHUNK_BYTES = 1_000_000
#: Positions of a short name in a chunk from which on a task doesn't send it for ranking.
OFTEN = 32
#: Bytes of packed names that are ranked together; a larger bucket is ranked part by part of its names.
PART_BYTES = 4_000_000
#: Bytes of text to each bucket of names, at most about.
BUCKET_BYTES = 32_000_000

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


class Texts:
    """The bytes of several documents one after another, with the hash of any stretch in constant time."""

    def __init__(self, texts: list[bytes]):
        self.size = np.array([len(t) for t in texts], dtype=np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        n = len(self.data)
        table = mix64(np.arange(1, 257, dtype=np.uint64) * _Q)
        power = np.empty(n + 1, dtype=np.uint64)
        power[0] = 1
        power[1:] = _P
        np.cumprod(power, out=power)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(table[self.data] * power[:n])))
        self.n = n

    def names(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit names of the stretches [start, end)."""
        return mix64((self.sums[end] - self.sums[start]) * _inverse_powers(start) + (end - start).astype(np.uint64) * _Q)


_CACHE = np.ones(1, dtype=np.uint64)


def _inverse_powers(at: np.ndarray) -> np.ndarray:
    """_P to the power -at, from a table that grows as needed."""
    global _CACHE
    top = int(at.max(initial=0)) + 1
    if len(_CACHE) < top:
        table = np.full(top, _P_INVERSE, dtype=np.uint64)
        table[0] = 1
        _CACHE = np.cumprod(table)
    return _CACHE[at]


def _sliding(values: np.ndarray, width: int, of) -> np.ndarray:
    """of (np.minimum or np.maximum) over each run of width values, by doubling."""
    out, span = values, 1
    while span * 2 <= width:
        out = of(out[:-span], out[span:])
        span *= 2
    n = len(values) - width + 1
    return of(out[:n], out[width - span: width - span + n])


class Sampled:
    """The sampled positions of some texts: ``at`` (over all bytes), ``owner`` (text) and ``name``."""

    def __init__(self, texts: Texts, length: int, gram: int):
        wide, n = length - gram + 1, texts.n
        self.texts, self.length, self.gram, self.wide = texts, length, gram, wide
        self.at = self.owner = np.zeros(0, np.int64)
        self.least, self.rank = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if n < length:
            return
        starts = np.arange(n - gram + 1)
        owner = np.repeat(np.arange(len(texts.size)), texts.size)
        self.rank = texts.names(starts, starts + gram) | np.uint64(1)
        least = _sliding(self.rank, wide, np.minimum)
        least[owner[: len(least)] != owner[length - 1:]] = 0  # strings across texts
        self.least = least
        pad = np.zeros(wide - 1, np.uint64)
        most = _sliding(np.concatenate((pad, least, pad)), wide, np.maximum)
        self.at = np.flatnonzero(self.rank == most)
        self.owner = owner[self.at]

    def reach(self) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the bytes that strings around each sampled position cover."""
        start, end = self.texts.start[self.owner], self.texts.start[self.owner + 1]
        far = self.length - self.gram
        return np.maximum(start, self.at - far), np.minimum(end, self.at + self.gram + far)


# Packed rows ---------------------------------------------------------------------------------------


def _pack(ids: np.ndarray, places: np.ndarray, *names: tuple[np.ndarray, int]) -> bytes:
    """Documents with their places, in runs of one document, and names of the given numbers of bytes."""
    new = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    runs = np.diff(np.concatenate((new, [len(ids)])))
    parts = [np.array([len(ids), len(new)], np.int64), ids[new].astype(np.int64), runs.astype(np.int32), (places & 0xFFFF).astype(np.uint16), (places >> 16).astype(np.uint16)]
    for values, width in names:
        parts.append(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]))
    return b"".join(p.tobytes() for p in parts)


def _unpack(payloads, *widths: int, part: int = 0, parts: int = 1) -> list[np.ndarray]:
    """ids, places and names of several packed rows together; only names that are part, modulo parts."""
    cols: list[list[np.ndarray]] = [[] for _ in range(2 + len(widths))]
    for raw in payloads:
        n, docs = (int(x) for x in np.frombuffer(raw, np.int64, 2))
        at = 16
        ids = np.frombuffer(raw, np.int64, docs, at)
        runs = np.frombuffer(raw, np.int32, docs, at + 8 * docs)
        at += 12 * docs
        low, high = np.frombuffer(raw, np.uint16, n, at), np.frombuffer(raw, np.uint16, n, at + 2 * n)
        at += 4 * n
        keep = slice(None)
        if parts > 1:
            keep = np.flatnonzero(np.frombuffer(raw, np.uint8, n * widths[0], at).reshape(n, widths[0])[:, 0] % parts == part)
        cols[0].append(np.repeat(ids, runs)[keep])
        cols[1].append(low[keep].astype(np.int64) | (high[keep].astype(np.int64) << 16))
        for k, width in enumerate(widths):
            some = np.frombuffer(raw, np.uint8, n * width, at).reshape(n, width)[keep]
            wide = np.zeros((len(some), 8), np.uint8)
            wide[:, :width] = some
            cols[2 + k].append(wide.view("<u8").ravel())
            at += n * width
    kinds = (np.int64, np.int64, *[np.uint64] * len(widths))
    return [np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(cols, kinds)]


def _parts(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, places) of each value of key."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(key) else []
    for a, b in zip(new, [*new[1:], len(key)]):
        yield int(ordered[a]), order[a:b]


def _home(ids: np.ndarray, buckets: int) -> np.ndarray:
    return np.mod(ids ^ (ids >> 16), buckets)


def _home_column(buckets: int):
    return F.pmod(F.col("doc_id").bitwiseXOR(F.shiftright("doc_id", 16)), F.lit(buckets)).cast("int")


def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    return ((names >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _settle(ids: np.ndarray, *names: np.ndarray) -> np.ndarray:
    """Whether a smaller document has the same names."""
    if not len(ids):
        return np.zeros(0, bool)
    order = np.lexsort((ids, *names))
    new = np.zeros(len(ids), bool)
    new[0] = True
    for n in names:
        new[1:] |= n[order][1:] != n[order][:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
    out = np.zeros(len(ids), bool)
    out[order] = ids[order] > ids[order][first]
    return out


def _homeward(ids: np.ndarray, places: np.ndarray, kind: int, buckets: int) -> Iterator[dict]:
    for home, part in _parts(_home(ids, buckets)):
        part = part[np.lexsort((places[part], ids[part]))]
        yield {"home": home, "kind": kind, "payload": _pack(ids[part], places[part])}


WHOLE, FINE, WINDOW = 0, 1, 2
NAMED = "bucket int, home int, kind int, payload binary"
HOMED = "home int, kind int, payload binary"


def _frame(rows: list[dict], columns: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in columns.split(", ")])


def _pieces(ids, texts, margin: int) -> Iterator[tuple[list, list, list, list]]:
    """Chunks of (id, bytes, place of the piece, first and last place that it answers for).

    A long text is cut into pieces with margins, so that a chunk stays bounded."""
    chunk, size = [], 0
    for i, t in zip(ids, texts):
        t = t or b""
        for a in range(0, max(len(t), 1), CHUNK_BYTES):
            low, high = max(0, a - margin), min(len(t), a + CHUNK_BYTES + margin)
            chunk.append((i, t[low:high], low, a, a + CHUNK_BYTES))
            size += high - low
            if size >= CHUNK_BYTES:
                yield tuple(map(list, zip(*chunk)))
                chunk, size = [], 0
    if chunk:
        yield tuple(map(list, zip(*chunk)))


def _often(doc: np.ndarray, short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(short names of OFTEN positions or more, several documents and several long names, sorted; positions of each
    that show as much: those of its least and greatest long name, and of its first and last document)."""
    if not len(short):
        return short, np.zeros(0, np.int64)
    by_long, by_doc = np.lexsort((doc, long, short)), np.lexsort((long, doc, short))
    ordered = short[by_long]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    last = np.append(first[1:], len(ordered)) - 1
    many = (last - first + 1 >= OFTEN) & (long[by_long[first]] != long[by_long[last]]) & (doc[by_doc[first]] != doc[by_doc[last]])
    first, last = first[many], last[many]
    return ordered[first], np.unique(np.concatenate((by_long[first], by_long[last], by_doc[first], by_doc[last])))


def _named(length: int, gram: int, buckets: int):
    """Step 1 on texts: names of the sampled positions, less those settled within the chunk."""

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = np.zeros(0, np.uint64)  # of this task so far; an OFTENth of its positions at most
        for b in batches:
            for ids, texts, low, first, last in _pieces(b["doc_id"], b["text"], 2 * length):
                s = Sampled(Texts(texts), length, gram)
                place = s.at - s.texts.start[s.owner] + np.array(low, np.int64)[s.owner]
                own = (place >= np.array(first)[s.owner]) & (place < np.array(last)[s.owner])
                start, end = s.reach()
                doc, place, short, long = np.array(ids, np.int64)[s.owner][own], place[own], s.rank[s.at][own], s.texts.names(start[own], end[own])
                known = _settle(doc, long)
                rows = [{"bucket": r["home"], **r} for r in _homeward(doc[known], place[known], WHOLE, buckets)]
                lone = ~np.isin(long, long[known])[~known]  # a long name that has copies here is worth ranking
                doc, place, short, long = doc[~known], place[~known], short[~known], long[~known]
                on = lone & np.isin(short, often)
                rest = np.flatnonzero(lone & ~on)
                more, shown = _often(doc[rest], short[rest], long[rest])
                often = np.union1d(often, more)
                on[rest] = np.isin(short[rest], more)
                on[rest[shown]] = False
                rows += [{"bucket": r["home"], **r} for r in _homeward(doc[on], place[on], FINE, buckets)]
                doc, place, short, long = doc[~on], place[~on], short[~on], long[~on]
                for bucket, part in _parts(_bucket(short, buckets)):
                    rows.append({"bucket": bucket, "home": -1, "kind": FINE, "payload": _pack(doc[part], place[part], (short[part], 4), (long[part], 5))})
                yield _frame(rows, NAMED)

    return compute


def _shared(name: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether more than one document has the name."""
    if not len(name):
        return np.zeros(0, bool)
    order = np.argsort(name)
    ordered = name[order]
    new = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    out = np.zeros(len(name), bool)
    out[order] = np.repeat(np.minimum.reduceat(ids[order], new) != np.maximum.reduceat(ids[order], new), np.diff(np.concatenate((new, [len(name)]))))
    return out


def _through(rows: pd.DataFrame) -> tuple[list[dict], list[bytes], int]:
    """Rows that only pass, the others' payloads, and the parts to work on one after another."""
    names = rows.loc[rows["home"] < 0, "payload"].tolist()
    passing = rows.loc[rows["home"] >= 0, ["home", "kind", "payload"]].to_dict("records")
    return passing, names, sum(map(len, names)) // PART_BYTES + 1


def _ranked(buckets: int):
    """Step 1 on a bucket of names: settled positions, and those that go on."""

    def compute(rows: pd.DataFrame) -> pd.DataFrame:
        out, names, parts = _through(rows)
        for part in range(parts):
            doc, place, short, long = _unpack(names, 4, 5, part=part, parts=parts)
            left = np.flatnonzero(_shared(short, doc))
            doc, place, short, long = doc[left], place[left], short[left], long[left]
            known = _settle(doc, long, short)
            out += _homeward(doc[known], place[known], WHOLE, buckets)
            on = _shared(short, long.astype(np.int64)) & ~known  # one short name, several long ones
            out += _homeward(doc[on], place[on], FINE, buckets)
        return _frame(out, HOMED)

    return compute


def _windows(length: int, gram: int, buckets: int):
    """Step 2 on texts: names of the strings that the remaining positions stand for."""
    far = length - gram

    def compute(key, docs: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        ids, places = _unpack(hits["payload"])
        texts = dict(zip(docs["doc_id"], docs["text"]))
        out = []
        step = max(1, CHUNK_BYTES // (length + far))
        for a in range(0, len(ids), step):
            doc, place = ids[a: a + step], places[a: a + step]
            low = np.maximum(0, place - far)
            s = Sampled(Texts([(texts.get(d) or b"")[x: p + length] for d, x, p in zip(doc.tolist(), low.tolist(), place.tolist())]), length, gram)
            if not len(s.least):
                continue
            at = s.texts.start[:-1] + place - low  # the position itself, over all bytes
            found = []
            for k in range(s.wide):
                begin = at - k
                ok = (k <= place - low) & (begin < len(s.least))
                ok[ok] = s.least[begin[ok]] == s.rank[at[ok]]
                found.append((np.flatnonzero(ok), begin[ok]))
            which, begin = (np.concatenate(x) for x in zip(*found))
            name = s.texts.names(begin, begin + length)
            owner, start = doc[which], place[which] - (at[which] - begin)
            known = _settle(owner, name)
            out += [{"bucket": r["home"], **r} for r in _homeward(owner[known], start[known], WINDOW, buckets)]
            owner, start, name = owner[~known], start[~known], name[~known]
            order = np.lexsort((start, owner))
            owner, start, name = owner[order], start[order], name[order]
            for bucket, part in _parts(_bucket(name, buckets)):
                out.append({"bucket": bucket, "home": -1, "kind": WINDOW, "payload": _pack(owner[part], start[part], (name[part], 8))})
        return _frame(out, NAMED)

    return compute


def _windows_ranked(buckets: int):
    """Step 2 on a bucket of names: the strings that a smaller document has."""

    def compute(rows: pd.DataFrame) -> pd.DataFrame:
        out, names, parts = _through(rows)
        for part in range(parts):
            doc, start, name = _unpack(names, 8, part=part, parts=parts)
            known = _settle(doc, name)
            out += _homeward(doc[known], start[known], WINDOW, buckets)
        return _frame(out, HOMED)

    return compute


def _removed(length: int, gram: int):
    """The last step: each document's removed stretches and kept bytes."""
    far = length - gram

    def compute(key, docs: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        whole, window = (_unpack(hits.loc[hits["kind"] == k, "payload"]) for k in (WHOLE, WINDOW))
        ids = np.concatenate((whole[0], window[0]))
        start = np.concatenate((whole[1] - far, window[1]))
        end = np.concatenate((whole[1] + gram + far, window[1] + length))
        order = np.argsort(ids, kind="stable")
        ids, start, end = ids[order], start[order], end[order]
        out = []
        for d, text in zip(docs["doc_id"], docs["text"]):
            text = text or b""
            a, b = np.searchsorted(ids, d), np.searchsorted(ids, d, "right")
            spans, kept = [], text
            if b > a and text:
                edges = np.bincount(np.clip(start[a:b], 0, len(text)), minlength=len(text) + 1) - np.bincount(np.clip(end[a:b], 0, len(text)), minlength=len(text) + 1)
                covered = np.cumsum(edges)[:-1] > 0
                turn = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
                spans = [{"start": int(x), "end": int(y)} for x, y in zip(turn[::2], turn[1::2])]
                kept = np.frombuffer(text, np.uint8)[~covered].tobytes()
            out.append((d, len(text), spans, kept))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "spans", "kept"])

    return compute


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): stretches [start, end) of the text's UTF-8 bytes that repeat, and the rest.

    A byte repeats if a length-byte string over it also starts in a document of smaller id; strings are
    judged on the input. Null text counts as empty. Rows that repeat an id are one document and get the
    same stretches, so none of them removes the other; an id should name one text. Rows with a null id
    are compared with nothing and kept whole. Of equal texts the smallest id keeps all. Long texts are read
    whole, in pieces; other columns are not looked at. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    apart = rows.where("doc_id IS NULL").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.col("text").alias("kept"))
    rows = rows.where("doc_id IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_BYTES + 1))
    hits = cut(rows.mapInPandas(_named(length, gram, buckets), NAMED).groupBy("bucket").applyInPandas(_ranked(buckets), HOMED))
    homed = rows.withColumn("home", _home_column(buckets)).groupBy("home")
    named = homed.cogroup(hits.where(f"kind = {FINE}").groupBy("home")).applyInPandas(_windows(length, gram, buckets), NAMED)
    windows = named.groupBy("bucket").applyInPandas(_windows_ranked(buckets), HOMED)
    settled = hits.where(f"kind = {WHOLE}").unionByName(windows)
    out = homed.cogroup(settled.groupBy("home")).applyInPandas(_removed(length, gram), "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
    return out.unionByName(apart)
