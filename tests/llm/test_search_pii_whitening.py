"""Ranked search, personal data and whitening against plain re-computations."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import lexical, personal, whitening

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


# Ranked search --------------------------------------------------------------------------------------


def ranked(docs, items, k=10):
    """(item place, rank, doc_id, score) by scoring every document for every item."""
    terms = lambda x: [w.translate(LOWER) for w in WORD.findall(x or "")]
    all_ = [(i, terms(t)) for i, t in docs]
    all_ = [(i, w) for i, w in all_ if w]
    n, total = len(all_), sum(len(w) for _, w in all_)
    df = Counter(t for _, w in all_ for t in set(w))
    out = []
    for place, text in enumerate(items):
        scores = []
        for at, (i, w) in enumerate(all_):
            m, tf = 25 + 75 * len(w) * n // total, Counter(w)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms(text) if tf[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, at))
        out += [(place, r + 1, None if none else i, -s) for r, (s, none, i, _) in enumerate(sorted(scores)[:k])]
    return out


def search(spark, docs, items, k=10):
    d = spark.createDataFrame([(i, t, 9.0, "x") for i, t in docs], "doc_id long, text string, score double, term string")
    q = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, rank int")
    return sorted(tuple(r) for r in lexical.search(d, q, k).collect())


def made_texts(seed, n, vocabulary=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    return [" ".join(rng.choices(words, weights, k=rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_search_finds_what_scoring_all_documents_finds(spark, seed):
    docs = list(enumerate(made_texts(seed, 150)))
    items = made_texts(seed + 10, 12)
    assert search(spark, docs, items) == sorted(ranked(docs, items))


def test_search_on_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "..,"), (4, "Äpfel ÄPFEL b"), (5, "B c"), (5, "b C"), (None, "b c"), (6, "é" * 3000 + " b"), (7, "zz")]
    items = ["b b c", None, "", "äpfel", "ÄPFEL pfel", "nowhere"]
    got = search(spark, docs, items)
    assert got == sorted(ranked(docs, items))
    assert [r[2] for r in got if r[0] == 0][:3] == [5, 5, None]


def test_search_with_ties_cut_at_k(spark):
    docs = [(i, "same words here") for i in range(30, 0, -1)] + [(100 + i, f"other{i}") for i in range(40)]
    assert [(r[1], r[2]) for r in search(spark, docs, ["same here"])] == [(i, i) for i in range(1, 11)]


def test_search_without_documents_or_items(spark):
    assert search(spark, [], ["a"]) == [] and search(spark, [(1, "a b")], []) == []


def test_pruned_terms_cannot_change_the_result(spark):
    """An item of one rare and many common terms prunes the common ones and still ranks by all of them."""
    common = [f"c{i}" for i in range(4)]
    docs = [(i, " ".join(common[: 1 + i % 4] * 2)) for i in range(300)] + [(1000 + i, "rare rare " + " ".join(common[:i % 5])) for i in range(15)]
    items = ["rare " + " ".join(common)]
    found = lexical.planned(
        spark.createDataFrame([(0, t, 1) for t in range(5)], "item long, tid long, q long"),
        spark.createDataFrame([(0, 900, 800), (1, 20, 20), (2, 20, 20), (3, 20, 20), (4, 20, 20)], "tid long, most long, kth long"),
    )
    assert {(r.tid, r.needed, r.rest) for r in found.collect()} == {(0, True, 80), *[(t, False, 80) for t in range(1, 5)]}
    assert search(spark, docs, items) == sorted(ranked(docs, items))


# Whitening ------------------------------------------------------------------------------------------


def embeddings(spark, vectors, parts=3):
    rows = [(i, v, 7, 0.5) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, whitened double").repartition(parts)


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 12), st.integers(0, 10**6), st.booleans())
def test_qr_gives_the_eigenvectors(n, seed, low_rank):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, max(1, n // 2 if low_rank else n)))
    a = a @ a.T
    values, vectors = whitening.symmetric_qr(a)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-11 * max(1, np.abs(a).max()))
    assert np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-12)
    assert np.allclose(a @ vectors, vectors * values, atol=1e-11 * max(1, np.abs(a).max()))


def test_merged_moments_are_those_of_one_pass():
    rng = np.random.default_rng(5)
    x = rng.integers(-100, 100, size=(57, 6)) + 1_000_000
    whole = whitening.welford(iter([x]), 6)
    state = whitening.welford(iter(()), 6)
    for part in np.split(x, [3, 4, 30]):
        state = whitening.merged(state, whitening.welford(iter([part]), 6))
    centred = x - x.mean(axis=0)
    assert state.n == 57 and state.sums == x.sum(axis=0).tolist() == whole.sums
    assert np.allclose(state.products, centred.T @ centred, rtol=1e-12) and np.allclose(whole.products, centred.T @ centred, rtol=1e-12)


@pytest.mark.parametrize("parts", [1, 7])
def test_whitening_against_numpy(spark, parts):
    rng = np.random.default_rng(3)
    raw = (rng.normal(size=(90, 5)) @ rng.normal(size=(5, 5))).astype(np.float32)
    got = whitening.whitened(embeddings(spark, raw.tolist(), parts)).collect()
    x = np.floor(raw.astype(np.float64) * 64).astype(np.int64) + 1_000_000
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / 90)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 90 * 5 and {r.n for r in got} == {90}
    table = np.zeros((90, 5))
    for r in got:
        table[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == int(((90 * x[r.vec_id] - x.sum(axis=0)) ** 2).sum())
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
    want = centred @ vectors / np.sqrt(values)
    want *= np.sign((want * table).sum(axis=0))
    assert np.allclose(table, want, atol=1e-7)
    error = {r.identity_error for r in got}
    assert len(error) == 1 and error.pop() < 1e-9
    assert np.allclose(table.T @ table / 90, np.eye(5), atol=1e-9)


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0], [2.0, 2.0], [2.0, 2.0], [4.0, 2.0]]
    odd = [None, [], [1.0, None], [nan, 1.0], [inf, 1.0], [1.0, 2.0, 3.0]]
    got = whitening.whitened(embeddings(spark, good + odd)).collect()
    assert sorted({r.vec_id for r in got}) == [0, 1, 2, 3] and {r.component for r in got} == {1, 2}
    assert all(r.whitened is None for r in got if r.component == 2)  # no variance there
    assert {r.identity_error is not None and r.identity_error < 1e-12 for r in got} == {True}
    same = whitening.whitened(embeddings(spark, [[1.0, 1.0]] * 3)).collect()
    assert len(same) == 6 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in same)
    assert whitening.whitened(embeddings(spark, [])).collect() == [] and whitening.whitened(embeddings(spark, [None])).collect() == []


def test_huge_entries_give_no_false_deviation(spark):
    got = whitening.whitened(embeddings(spark, [[3e38, 1.0], [-3e38, 2.0], [0.0, 5.0]])).collect()
    assert len(got) == 6 and {r.deviation for r in got if r.vec_id == 0} == {None}


# Personal data --------------------------------------------------------------------------------------


def plain_base(text):
    """The base spans by the contract's patterns."""
    out, digits = [], lambda s: re.sub("[^0-9]", "", s)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), m.end(), personal.EMAIL))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), m.end(), personal.IP))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = digits(m.group())
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), m.end(), personal.CARD))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(digits(m.group())) <= 15:
            out.append((m.start(), m.end(), personal.PHONE))
    return sorted(out, key=lambda s: (s[0], s[2]))


@settings(max_examples=400, deadline=None)
@given(st.one_of(
    st.text(alphabet="a.@-_%+b1 ", max_size=40),
    st.text(alphabet="0123456789.", max_size=40),
    st.text(alphabet="0123456789 -", max_size=60),
    st.lists(st.sampled_from(["+1 (017) 555-7713", "4845168114407329", "4111 1111 1111 1111", "a.b@c.d", "10.0.0.1", "256.1.1.1", " ", "٣", "x", "+", "."]), max_size=8).map(" ".join),
))
def test_base_spans_are_the_patterns(text):
    assert personal.base_spans(text) == plain_base(text)


def test_base_spans_in_linear_time():
    import time

    began = time.time()
    for text in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "+1" * 100_000, "+1" + " " * 200_000, "a@" * 100_000, "(1-" * 60_000):
        spans = personal.base_spans(text)
        personal.graph_of(text, spans)
    assert time.time() - began < 20


def brute_marginals(unary, ends, kind, tables):
    """Marginals by adding up all labellings."""
    n, k = unary.shape
    total = np.zeros((n, k))
    for code in range(k**n):
        y = [code // k**i % k for i in range(n)]
        score = sum(unary[i, y[i]] for i in range(n)) + sum(tables[t][y[a], y[b]] for (a, b), t in zip(ends, kind))
        total[range(n), y] += math.exp(score)
    return total / total.sum(axis=1, keepdims=True)


def test_message_passing_is_exact_on_trees_and_near_on_loops():
    rng = np.random.default_rng(2)
    tables = np.stack((rng.normal(size=(3, 3)), np.eye(3) * 1.5))
    unary = rng.normal(size=(5, 3))
    tree = np.array([[0, 1], [1, 2], [1, 3], [3, 4]])
    assert np.allclose(personal.beliefs(unary, tree, np.array([0, 0, 1, 0]), tables, 60), brute_marginals(unary, tree, [0, 0, 1, 0], tables), atol=1e-6)
    loop = np.array([[0, 1], [1, 2], [2, 3], [3, 4], [0, 4]])
    kinds = np.array([0, 0, 0, 0, 1])
    assert np.abs(personal.beliefs(unary, loop, kinds, tables, 60) - brute_marginals(unary, loop, kinds, tables)).max() < 0.1


def spans_of(spark, texts, model, least=personal.LEAST):
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    return {r.doc_id: [(s.kind, s.start, s.end, s.base) for s in r.personal_spans] for r in personal.personal_spans(df, model, least).collect()}


def corpus(n=400, seed=4):
    """Texts with personal data among numbers that are none."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card():
        body = digits(15)
        return next(body + c for c in "0123456789" if personal.luhn(body + c))

    makers = [lambda: f"+1 ({digits(3)}) 555-{digits(4)} or", lambda: f"{card()} by", lambda: f"al.{digits(2)}@mail{digits(1)}.example.com", lambda: ".".join(str(rng.randint(1, 250)) for _ in range(4)), lambda: digits(16), lambda: digits(4), lambda: f"{digits(1)}.", lambda: f"2024-{digits(2)}-{digits(2)}", lambda: "word"]
    return [" ".join(rng.choice(makers)() if rng.random() < 0.2 else rng.choice(["the", "of", "and", "to,"]) for _ in range(40)) for _ in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    return personal.fit(spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string"))


def test_repeated_forms_become_spans_and_clean_texts_stay(spark, model):
    card = "4111111111111111"
    texts = [
        f"pay {card} now, or 4111.1111.1111.1111 later",  # the same number in another form
        "call +1 (017) 555-7713 today; again (017) 555-7713 or so",
        "on 2024-01-15 we paid 1234 for item 12345, see 3.1 and 1999",
        "+9 (999) 555-9999 99.99.99.99 tail",  # the phone pattern runs into the address and fails
        None, "", "no digits at all",
    ]
    got = spans_of(spark, texts, model, 0.8)
    assert ("card", texts[0].index("4111."), texts[0].index(" later"), False) in got[0] and ("card", 4, 20, True) in got[0]
    assert ("phone", 5, 22, True) in got[1]
    assert ("phone", texts[1].index("(017) 555-7713 or"), texts[1].index(" or so"), False) in got[1]
    assert got[2] == got[4] == got[5] == got[6] == []
    assert ("phone", 0, 17, False) in got[3] and any(s[0] == "ip" and s[3] for s in got[3])


def test_links_between_equal_tokens_matter(spark, model):
    """Without the skip edge the unusual form is less likely to be a card."""
    text = "pay 4111111111111111 now, or 4111.1111.1111.1111 later"
    g = personal.graph_of(text, personal.base_spans(text))
    assert g.skips == [(0, 1)]
    p = personal.marginals([g, g._replace(skips=[])], model)
    assert p[0][1, personal.CARD] > p[1][1, personal.CARD]


def test_base_spans_stay_whatever_the_model(spark, model):
    texts = corpus(60, seed=9)
    with_model, without = spans_of(spark, texts, model), spans_of(spark, texts, None)
    assert all([s for s in with_model[i] if s[3]] == without[i] for i in with_model)
    for i, t in enumerate(texts):
        assert [(s, e, personal.KINDS.index(k) + 1) for k, s, e, _ in without[i]] == plain_base(t)


def test_no_rows_and_no_personal_data(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert personal.fit(none) is None and personal.personal_spans(none, None).count() == 0
    assert personal.fit(spark.createDataFrame([(1, "a 1 b"), (None, "x"), (2, None)], "doc_id long, text string")) is None
