"""The pipeline's stages on the smallest tables, each against a plain re-computation of its own input."""

import hashlib
import math
import os
import re
from collections import Counter

import pytest

import corpus_pipeline
from sparkloom.llm import queries

from . import helpers

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """name -> (rows before, rows after)"""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out[name] = (docs, after)
        docs = after
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    first = stages["toxicity"][0]
    assert all(after.columns == first.columns for name, (_, after) in stages.items() if name != "mix_sources")


def test_toxicity_keeps_clean_documents(spark, stages):
    before, after = stages["toxicity"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = set(texts(after))
    clean = [i for i in texts(before) if labels.get(i) == 0]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)


def test_one_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    rows = sorted(texts(before).items())
    root = helpers.groups([t for _, t in rows])
    assert sorted(texts(after)) == sorted({rows[r][0] for r in root})


def test_contaminated_documents_go(spark, stages):
    before, after = stages["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    got, want = texts(after), {}
    for i, t in texts(before).items():
        n, hit, _ = helpers.windows(t, items)
        if not (hit and 20 * hit >= n):
            want[i] = n - hit
            assert hit or got[i] == t
    assert {i: helpers.windows(t, [])[0] for i, t in got.items()} == want


def test_secrets_go_and_documents_stay(stages):
    from sparkloom.llm import secrets

    from .test_operators import plain_spans

    before, after = stages["secret_scan"]
    got = texts(after)
    assert set(texts(before)) == set(got)
    for i, t in texts(before).items():
        out, at = [], 0
        for kind, start, end in (x.split(":") for x in plain_spans(t).split(",") if x):
            if int(start) >= at:
                out += [t[at:int(start)], f"[{kind}]"]
            at = max(at, int(end))
        assert got[i] == ("".join(out) + (t or "")[at:] if out else t), i
    assert secrets.RULES


def plain_mix(rows):
    """doc_id -> copies, from (doc_id, source, text): targets by sharing again what is above a cap, copies by walking each source's order."""
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, _, t in rows}
    key = {i: "t" if s is None else f"s{s}" for i, s, _ in rows}
    sources = sorted(set(key.values()))
    whole = {s: float(sum(n for i, n in sizes.items() if key[i] == s)) for s in sources}
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(sources)}
    target, left = {}, set(sources)
    while left:
        level = (1.5 * sum(whole.values()) - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * level > 2 * whole[s]}
        target |= {s: 2 * whole[s] for s in over} if over else {s: weight[s] * level for s in left}
        left -= over or left
    digest = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:8], 16)
    out = {}
    for s in sources:
        u, rate = digest(f"7:{s}") / 2**32, target[s] / whole[s] if whole[s] else 0.0
        order = sorted((i for i in sizes if key[i] == s), key=lambda i: (math.floor(math.log2(sizes[i] + 1.0) * 4), digest(str(i)), sizes[i], i))
        out |= {i: math.floor((k + 1) * rate + u) - math.floor(k * rate + u) for k, i in enumerate(order)}
    return out


def test_mix_against_a_plain_walk(stages):
    before, after = stages["mix_sources"]
    want = plain_mix([(r.doc_id, r.source, r.text) for r in before.collect()])
    assert Counter(r.doc_id for r in after.collect()) == Counter({i: n for i, n in want.items() if n})


def test_toxic_documents_go(spark, stages):
    """The stage drops what the operator scores 0.5 or more, on the very rows that it is given."""
    before, after = stages["toxicity"]
    scored = queries.QUERIES["op4_toxicity"](spark, DATA).collect()
    assert set(texts(after)) == {r.doc_id for r in scored if not r.predicted} and set(texts(before)) == {r.doc_id for r in scored}


def test_mix_copies(stages):
    before, after = stages["mix_sources"]
    assert set(texts(after)) <= set(texts(before)) and after.groupBy("doc_id").count().where("count > 2").count() == 0


def test_run_gives_the_same(spark, stages):
    got = sorted((r.doc_id, r.copy) for r in corpus_pipeline.run(spark, DATA).select("doc_id", "copy").collect())
    assert got == sorted((r.doc_id, r.copy) for r in stages["mix_sources"][1].select("doc_id", "copy").collect())


CLASHES = ("n_words", "items", "contaminated", "spans", "secret_spans", "size", "copies", "copy", "target", "score", "label", "rep", "root")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_rows(spark, name):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    text = docs.orderBy("doc_id").first().text
    odd = [(-1, None, None, None, None), (-2, "", "en", None, 0), (-3, "word " * 60_000, "en", "s", 300_000), (None, text, "en", "s", 7), (-4, text, None, "s", 7), (-4, text, None, "s", 7), (-5, "token = abcdefghijklmnop", "en", "s", 23)]
    some = docs.limit(40).unionByName(spark.createDataFrame(odd, docs.schema))
    some = some.withColumns({c: F.lit(f"my {c}") for c in CLASHES})
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, some, DATA)
    rows = out.collect()
    assert len(rows) and all(r[c] == f"my {c}" for r in rows for c in CLASHES) and (name == "mix_sources" or out.columns == some.columns)
    assert any(r.text is None for r in rows) == (name != "mix_sources") and stage(spark, some.limit(0), DATA).count() == 0
    kept = {r.doc_id for r in rows}
    if name == "near_duplicates":
        assert -4 not in kept or sum(r.doc_id == -4 for r in rows) == 2
    if name == "secret_scan":
        assert {r.text for r in rows if r.doc_id == -5} == {"[assign]"}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    answer = con.execute(queries.SQL[name])
    order = [d[0] for d in answer.description]
    assert sorted(order) == sorted(df.columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, df.select(*order).collect())) == sorted(map(key, answer.fetchall()))
