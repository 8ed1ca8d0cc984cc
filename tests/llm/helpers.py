"""Small tables and plain re-computations for the operators' tests."""

import hashlib
import re

from sparkloom.llm import minhash

AWKWARD = "doc_id long, text string, lang string, source string, score double, size long, label int, spans string, copies int"


def docs(spark, texts, first=0, **columns):
    """Documents with ids in order, and extra columns whose names clash with the operators' own."""
    rows = [(first + i, t, "en", f"src{i % 3}" if i % 7 else None, 9.0, 9, 9, "x", 9) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, AWKWARD)


def windows(text, item_texts, width=13):
    """(n_words, n_hit, hit item places) of a text by comparing every window."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda x: (x or "").translate({i: i + 32 for i in range(65, 91)})
    w, hit, items = word.findall(low(text)), set(), set()
    for k, item in enumerate(item_texts):
        v = word.findall(low(item))
        n = min(width, len(v))
        shingles = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i:i + n]) in shingles:
                hit |= set(range(i, i + n))
                items.add(k)
    return len(w), len(hit), items


def removed(texts, length=50):
    """Kept bytes of each text, in order of id."""
    seen, out = {}, []
    for i, t in enumerate(texts):
        b = (t or "").encode()
        covered = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen.setdefault(b[k:k + length], i) < i:
                covered[k:k + length] = b"\1" * length
        out.append(bytes(c for c, x in zip(b, covered) if not x))
    return out


def shingle_set(text):
    w = (text or "").encode().translate(minhash.FOLD).split()
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups(texts, threshold=0.8):
    """Smallest place of each text's group by all pairs."""
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def sha(data):
    return hashlib.sha256(data).hexdigest()
