"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from sparkloom import plans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def shown(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "-"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def rows(columns, values):
    order = sorted(columns)
    return order, sorted(tuple(shown(v[columns.index(c)]) for c in order) for v in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = plans.queries()[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    answer = duck.execute(plans.oracle_sql()[name])
    assert got == rows([d[0] for d in answer.description], answer.fetchall())


def test_native_plans_hold_no_python(spark):
    for name in ("message_tiers", "notes_summary", "quality_checks", "subtitle_clean", "section_patch_merge"):
        plan = plans.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_scans_prune_columns(spark):
    plan = plans.queries()["url_grounding"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan
