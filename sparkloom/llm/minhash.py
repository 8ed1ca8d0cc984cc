"""Near-duplicate groups: ProbMinHash signatures, banding, exact verification, connected components.

A document's elements are its distinct shingles of ``SHINGLE`` words, each of weight 1, as the similarity
that decides is that of plain sets. Each element is a Poisson process whose rate is its weight: arrivals
carry a random slot, and a slot keeps the element that arrives first. An element is left as soon as its
next arrival comes later than every slot's first, so long documents end after about one arrival an
element. Slots agree, each on its own, with the Jaccard similarity of the sets; agreement in one of
``BANDS`` bands makes documents candidates, and the exact Jaccard similarity of their shingle sets decides.

Texts with the same words are joined before signing, so large groups of copies cost one signature.
Buckets of every size are compared in two passes. In the first each member meets its bucket's hub, the
member whose bands are shared most widely, which in a group of variants is the text they stem from. The
second compares every other pair of a bucket whose ends have not been joined, so no pair that shares a band
goes uncompared for its bucket's size; a bucket that the hubs have joined costs nothing more. Members are
dealt to parts by the bytes of their texts, and parts meet part by part: a bucket of up to ``PART_BYTES``
sends each of its texts once. Within a task the shared shingles of all pairs are counted together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, arrow_rows, cut

SHINGLE = 5
BANDS, ROWS = 20, 4
THRESHOLD = 0.8
SLOTS = BANDS * ROWS
#: Bytes of text of one side of a block in which the pairs that are left are compared.
PART_BYTES = 8_000_000
#: A shingle of more members of a block is counted by a product of matrices, one of fewer pair by pair.
COMMON = 48
#: Members that are compared with a whole block at once, and shingles of one product.
TILE, COLUMNS = 512, 2_048
#: Pairs that are added up at once, and the bytes that a member counts for at least, which bounds a block's members.
PAIRS, LEAST_BYTES = 2_000_000, 1_000
#: Words of the texts that are hashed together; bounds a task's arrays.
CHUNK_BYTES = 1_000_000
#: Rows with texts that a worker gets at once.
BATCH_ROWS = 1_000

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix64(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of each element."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, 0x100000001B3, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, one after another, and the number of words of each text."""
    folded = [t.encode("utf-8", "surrogatepass").translate(FOLD) if isinstance(t, str) else b"" for t in texts]
    data = np.frombuffer(b" ".join(folded) + b" ", dtype=np.uint8)
    ends = np.cumsum([len(f) + 1 for f in folded])
    space = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    place = np.arange(len(data))
    origin = np.zeros(len(data), np.int64)
    origin[starts] = starts
    offset = place - np.maximum.accumulate(origin)
    longest = int(offset[~space].max()) + 1
    values = (data.astype(np.uint64) + np.uint64(1)) * _powers(longest)[np.minimum(offset, longest - 1)]
    values[space] = 0
    hashes = mix64(np.add.reduceat(values, starts) + _A)
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, ends))))
    return hashes, counts


def shingles(texts: list[str | None], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit shingle), sorted, repeats kept. A text of fewer words, but some, is one shingle."""
    hashes, counts = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    total = len(hashes)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    room = counts[owner] - (np.arange(total) - first[owner]) if total else np.zeros(0, np.int64)
    value = np.zeros(total, np.uint64)
    for k in range(width):
        part = np.zeros(total, np.uint64)
        part[: max(total - k, 0)] = hashes[k:]
        part[room <= k] = 0  # beyond the text, for texts of fewer words
        value = mix64(value * _A + part + np.uint64(k + 1))
    keep = (room >= width) | ((counts[owner] < width) & (room == counts[owner])) if total else np.zeros(0, bool)
    owner, value = owner[keep], value[keep]
    order = np.lexsort((value, owner))
    return owner[order], value[order]


def weighted(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements (text number, shingle, count)."""
    if not len(owner):
        return owner, value, np.zeros(0, np.int64)
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])))
    at = np.flatnonzero(new)
    return owner[at], value[at], np.diff(np.concatenate((at, [len(owner)])))


def signatures(texts: list[str | None], slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """(signature matrix of 32-bit components, whether the text has words)."""
    owner, value, _ = weighted(*shingles(texts))
    # A slot holds (arrival time as ordered bits) << 32 | element, so one minimum keeps both.
    best = np.full(len(texts) * slots, np.iinfo(np.uint64).max, dtype=np.uint64)
    time = np.zeros(len(owner))
    state = value.copy()
    while len(owner):
        state = mix64(state + _A)
        time = time - np.log1p(-((state >> np.uint64(11)).astype(np.float64) / 2.0**53))
        slot = ((state & np.uint64(0xFFFFFFFF)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
        key = (time.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (value >> np.uint64(32))
        np.minimum.at(best, owner * slots + slot, key)
        latest = best.reshape(len(texts), slots).max(axis=1) >> np.uint64(32)
        going = (time.astype(np.float32).view(np.uint32) < latest[owner])
        owner, value, time, state = owner[going], value[going], time[going], state[going]
    filled = best.reshape(len(texts), slots)
    return (filled & np.uint64(0xFFFFFFFF)), filled[:, 0] != np.iinfo(np.uint64).max


def band_keys(parts: np.ndarray) -> np.ndarray:
    """One 64-bit key for each signature and band."""
    parts = parts.reshape(len(parts), BANDS, ROWS)
    key = np.zeros((len(parts), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = mix64(key * _A + parts[:, :, r])
    return key.view(np.int64)


def jaccard(left: list[str | None], right: list[str | None]) -> np.ndarray:
    """Exact Jaccard similarity of the shingle sets, pair by pair."""
    n = len(left)
    a_owner, a, _ = weighted(*shingles(left))
    b_owner, b, _ = weighted(*shingles(right))
    owner, value = np.concatenate((a_owner, b_owner)), np.concatenate((a, b))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    both = (owner[1:] == owner[:-1]) & (value[1:] == value[:-1])
    shared = np.bincount(owner[1:][both], minlength=n) if n else np.zeros(0)
    total = np.bincount(owner, minlength=n) if n else np.zeros(0)
    return shared / np.maximum(total - shared, 1)


def _chunks(pdf: pd.DataFrame, columns: list[str]) -> Iterator[pd.DataFrame]:
    size = sum(pdf[c].str.len().fillna(0) for c in columns).to_numpy()
    at = (np.cumsum(size) // CHUNK_BYTES).astype(int)
    for _, part in pdf.groupby(at, sort=False):
        yield part


def _by_bytes(texts: pd.Series) -> Iterator[np.ndarray]:
    """Places of the texts, in runs of about CHUNK_BYTES."""
    if len(texts):
        at = (np.cumsum(texts.str.len().fillna(0).to_numpy()) // CHUNK_BYTES).astype(int)
        yield from np.split(np.arange(len(texts)), np.flatnonzero(np.diff(at)) + 1)


def _pick():
    """Of rows that repeat an id the one with the greatest of these counts, in its signature and its text."""
    return F.xxhash64("text")


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, pick, words, size, bands): one pass over the texts.

    pick: which of several rows of an id counts. words: a 128-bit key of the text's words in order, null
    for a text without words; size: the words' bytes.
    """

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for b in _chunks(whole, ["text"]):
                texts = b["text"].tolist()
                folded = [b" ".join(t.encode("utf-8", "surrogatepass").translate(FOLD).split()) if isinstance(t, str) else b"" for t in texts]
                parts, _ = signatures(texts)
                words = [hashlib.blake2b(f, digest_size=16).digest() if f else None for f in folded]
                yield pd.DataFrame({"doc_id": b["doc_id"], "pick": b["pick"], "words": words, "size": [len(f) for f in folded], "bands": list(band_keys(parts))})

    return docs.select("doc_id", "text", _pick().alias("pick")).mapInPandas(compute, "doc_id long, pick long, words binary, size long, bands array<long>")


def _whole(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """The rows, sorted by the columns, in frames that hold whole groups; a group may go on in the next batch."""
    kept = None
    for b in batches:
        rows = b if kept is None else pd.concat([kept, b], ignore_index=True)
        if not len(rows):
            continue
        same = (rows[by] == rows[by].iloc[-1]).all(axis=1)
        kept = rows[same]
        yield rows[~same]
    if kept is not None:
        yield kept


def shared_counts(owner: np.ndarray, code: np.ndarray, first: int, last: int, n: int) -> np.ndarray:
    """How many codes each of the members first to last shares with each of n. Rows (owner, code) are sorted by code, without repeats.

    Rows of codes that stand once may be left out. Codes of many members are counted by a product of matrices, COLUMNS
    at a time, those of few by adding up their pairs.
    """
    out = np.zeros((last - first, n), np.float32)
    starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
    counts = np.diff(np.append(starts, len(code)))
    for k in range(0, int((counts > COMMON).sum()), COLUMNS):
        at = np.flatnonzero(counts > COMMON)[k:k + COLUMNS]
        has = np.zeros((n, len(at)), np.float32)
        rows = np.concatenate([owner[s:s + c] for s, c in zip(starts[at], counts[at])])
        has[rows, np.repeat(np.arange(len(at)), counts[at])] = 1
        out += has[first:last] @ has.T
    flat = out.reshape(-1)
    for c in np.unique(counts[(counts > 1) & (counts <= COMMON)]).tolist():
        members = owner[starts[counts == c][:, None] + np.arange(c)]  # a row for each code
        members = members[((members >= first) & (members < last)).any(axis=1)]
        step = max(1, PAIRS // (c * c))
        for k in range(0, len(members), step):
            m = members[k:k + step]
            mine = np.broadcast_to(((m >= first) & (m < last))[:, :, None], (len(m), c, c))
            np.add.at(flat, ((m - first)[:, :, None] * n + m[:, None, :])[mine], 1)
    return out


def _linked_in_blocks(threshold: float):
    """(a, b), links between roots, from rows sorted by block.

    Every pair of a block's two sides, or of its one, is compared exactly by its shingles, but those whose roots are
    one already or have been joined by a link found before. Pairs stay within the task, so what it returns is fewer
    rows than it was given.
    """

    def links_of(g: pd.DataFrame) -> list[tuple[int, int]]:
        root, part, left = (g[c].to_numpy() for c in ("root", "part", "left"))
        one, n = bool((g["left"] == g["right"]).iloc[0]), len(g)
        if len(set(root.tolist())) < 2 or not one and len(set(part.tolist())) < 2:
            return []
        owners, values = [], []
        for at in _by_bytes(g["text"]):
            owner, value, _ = weighted(*shingles(g["text"].iloc[at].tolist()))
            owners.append(at[owner])
            values.append(value)
        owner, value = np.concatenate(owners), np.concatenate(values)
        sizes = np.bincount(owner, minlength=n)
        order = np.lexsort((owner, value))
        owner, value = owner[order], value[order]
        twice = np.zeros(len(value), bool)
        twice[1:] = value[1:] == value[:-1]
        twice[:-1] |= twice[1:]
        owner, value = owner[twice], value[twice]
        names, top = np.unique(root, return_inverse=True)
        out = []
        for first in range(0, n, TILE):
            last = min(first + TILE, n)
            if not one and not (part[first:last] == left[0]).any():
                continue
            shared = shared_counts(owner, value, first, last, n)
            like = shared / np.maximum(sizes[first:last, None] + sizes[None, :] - shared, 1) >= threshold
            for i in range(first, last):
                while one or part[i] == left[0]:
                    other = np.flatnonzero(like[i - first] & (top != top[i]) & (True if one else part != part[i]))
                    if not len(other):
                        break
                    x, y = sorted((int(top[i]), int(top[other[0]])))
                    out.append((int(names[x]), int(names[y])))
                    top[top == y] = x
        return out

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole(batches, ["block"]):
            out = [link for _, g in rows.groupby("block", sort=False) for link in links_of(g)]
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return compute


def remaining_links(reps: DataFrame, sizes: DataFrame, roots: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: links between roots that pairs of one bucket make.

    reps: written (doc, size, bands), size in bytes; sizes: (band, key, n) of the buckets; roots: (doc, root). A
    bucket's members are dealt to parts of about PART_BYTES, and each pair of parts is a block, which gets its
    members' texts. Members of its largest component meet only the others, so a bucket that is joined but for
    a few costs little.
    """
    members = reps.select("doc", "size", F.posexplode("bands").alias("band", "key")).join(sizes.where("n > 2").select("band", "key"), ["band", "key"])
    rooted = cut(members.join(roots, "doc", "left").select("doc", "size", "band", "key", F.coalesce("root", "doc").alias("root")))
    each = rooted.groupBy("band", "key", "root").agg(F.sum(F.greatest("size", F.lit(LEAST_BYTES))).alias("n"))
    tops = each.groupBy("band", "key").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.max("n").alias("n_top"), F.sum("n").alias("n_all"), F.count(F.lit(1)).alias("n_roots"))
    parts = lambda n: F.greatest(F.ceil(n / PART_BYTES), F.lit(1)).cast("int")
    tops = cut(tops.where("n_roots > 1").select("band", "key", "top", parts(F.col("n_all") - F.col("n_top")).alias("others"), parts(F.col("n_top")).alias("of_top")))
    hashed, is_top = F.xxhash64("doc", "band"), F.col("root") == F.col("top")
    part = F.when(is_top, F.col("others") + F.pmod(hashed, F.col("of_top"))).otherwise(F.pmod(hashed, F.col("others"))).cast("int")
    dealt = cut(rooted.join(tops, ["band", "key"]).select("doc", "root", "band", "key", part.alias("part"), (F.when(is_top, F.col("others")).otherwise(F.col("others") + F.col("of_top")) - 1).alias("last")))
    texts = docs.join(dealt.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.max_by("text", _pick()).alias("text"))
    dealt = dealt.join(texts.withColumnRenamed("doc_id", "doc"), "doc").withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
    dealt = dealt.withColumns({"left": F.least("part", "other"), "right": F.greatest("part", "other")})
    dealt = dealt.select(F.xxhash64("band", "key", "left", "right").alias("block"), "doc", "root", "part", "left", "right", "text")
    return dealt.repartition("block").sortWithinPartitions("block", "doc").mapInPandas(_linked_in_blocks(threshold), "a long, b long").distinct()


def bucket_sizes(reps: DataFrame) -> DataFrame:
    """(band, key, n) of the buckets of more than one member, written."""
    return cut(reps.select(F.posexplode("bands").alias("band", "key")).groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))


def hub_pairs(reps: DataFrame, sizes: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b: each member of a bucket with the bucket's hub.

    reps: written (doc, size, bands); sizes: of bucket_sizes(). The hub is the member with the most
    bucket mates over all its bands, the smaller id among equals; both sums combine on the map side.
    """
    members = cut(reps.select("doc", F.posexplode("bands").alias("band", "key")).join(sizes, ["band", "key"]))
    known = members.groupBy("doc").agg(F.sum("n").alias("mates"))
    ranked = cut(members.join(known, "doc").select("doc", "band", "key", "mates"))
    hubs = ranked.groupBy("band", "key").agg(F.max_by("doc", F.struct("mates", -F.col("doc"))).alias("hub"))
    pairs = ranked.join(cut(hubs), ["band", "key"]).where("doc <> hub")
    return pairs.select(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b")).distinct()


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, linked) for distinct pairs a < b, by the exact Jaccard similarity.

    pairs and texts are written tables: a document in very many pairs makes a hot key, which AQE splits.
    """

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for b in _chunks(whole, ["text_a", "text_b"]):
                yield pd.DataFrame({"a": b["a"], "b": b["b"], "linked": jaccard(b["text_a"].tolist(), b["text_b"].tolist()) >= threshold})

    text = lambda end: texts.select(F.col("doc_id").alias(end), F.col("text").alias(f"text_{end}"))
    return pairs.join(text("a"), "a").join(text("b"), "b").mapInPandas(compute, "a long, b long, linked boolean")


def _texts_of(ends: DataFrame, docs: DataFrame) -> DataFrame:
    return cut(docs.join(ends.distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.max_by("text", _pick()).alias("text")))


def joined(reps: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc, root) of the components of all links. reps: written (doc, size, bands); docs: (doc_id, text) of at least these."""
    sizes = bucket_sizes(reps)
    pairs = cut(hub_pairs(reps, sizes))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    roots = components(verified(pairs, _texts_of(ends, docs), threshold).where("linked").select("a", "b"))
    more = cut(remaining_links(reps, sizes, roots, docs, threshold))
    if more.isEmpty():
        return roots
    above = components(more)  # of roots, so far fewer than documents
    over = above.select(F.col("doc").alias("root"), F.col("root").alias("__top"))
    return roots.join(over, "root", "left").select("doc", F.coalesce("__top", "root").alias("root")).unionByName(above)


def components(edges: DataFrame) -> DataFrame:
    """(doc, root): for each document with a smaller one in its component, the smallest.

    Rounds of large-star and small-star: every document hangs its larger (then its smaller) neighbours
    on its least neighbour, until nothing changes. Least neighbours are aggregated with map-side combine
    and written, so that AQE can split the join at a document with very many neighbours.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("doc"), F.least("a", "b").alias("root")).where("doc <> root").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("root").alias("doc"), F.col("doc").alias("root")))
        least = cut(both.groupBy("doc").agg(F.least(F.min("root"), F.col("doc")).alias("low")))
        large = cut(both.join(least, "doc").where("root > doc").select(F.col("root").alias("doc"), F.col("low").alias("root")).distinct())
        low = cut(large.groupBy("doc").agg(F.min("root").alias("low")))
        ends = F.array(F.struct(F.col("doc"), F.col("low").alias("root")), F.struct(F.col("root").alias("doc"), F.col("low").alias("root")))
        edges = cut(large.join(low, "doc").select(F.explode(ends).alias("e")).select("e.doc", "e.root").where("doc <> root").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("doc", "root").cast("decimal(38,0)"))).first()
        if state == before:
            return edges
        before = state


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id): the smallest id of the document's group, one row per distinct doc_id.

    Documents are grouped when a chain of links joins them: equal words, or Jaccard similarity of at
    least threshold between sets of five-word shingles (a shorter text is one shingle). Null, empty and
    wordless texts stand alone. Rows that repeat an id count as one document, judged by one of
    them, the same in every run; rows with a null id are left out. Other columns are not looked at. Long
    texts are read whole. An empty table gives an empty result.
    """
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        keyed = cut(signed(rows).groupBy("doc_id").agg(F.max(F.struct("pick", "words", "size", "bands")).alias("k")).select("doc_id", "k.words", "k.size", "k.bands"))
    first = cut(keyed.where("words IS NOT NULL").groupBy("words").agg(F.min(F.struct("doc_id", "size", "bands")).alias("k")).select("words", F.col("k.doc_id").alias("rep"), "k.size", "k.bands"))
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        roots = joined(first.select(F.col("rep").alias("doc"), "size", "bands"), rows, threshold)
    of_rep = first.select("words", "rep").join(roots.withColumnRenamed("doc", "rep"), "rep", "left")
    of_rep = cut(of_rep.select("words", F.coalesce("root", "rep").alias("class_id")))
    worded = keyed.where("words IS NOT NULL").join(of_rep, "words").select("doc_id", "class_id")
    return worded.unionByName(keyed.where("words IS NULL").select("doc_id", F.col("doc_id").alias("class_id")))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that have a smaller id in their group. Rows with a null id stay."""
    gone = near_duplicates(docs, threshold).where("doc_id <> class_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
