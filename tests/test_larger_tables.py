"""What showed on larger tables only."""

import duckdb
import pytest

from sparkloom import plans

from .test_queries import rows


@pytest.fixture
def agrees(spark, tmp_path):
    """Whether a query over one small table of its own gives what its SQL gives."""

    def check(name, table, values, schema):
        spark.createDataFrame(values, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con = duckdb.connect()
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        df, answer = plans.queries()[name](spark, str(tmp_path)), con.execute(plans.oracle_sql()[name])
        assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in answer.description], answer.fetchall())

    return check


def test_references_cut_off_before_a_tag_stay(agrees):
    pages = [(0, "<h1>a &amp; b &amp</h1><p>x</p>"), (1, "<b>&quot</b>I"), (2, "&notit; &copy2 &#39 &#39; &eacute;")]
    agrees("html_to_text", "pages", pages, "page_id long, html string")


def test_a_mail_that_begins_like_a_mail_is_one(agrees):
    texts = ["From here on\nFrom there\nend é", "\nFrom x\ny", "Plain\nFrom x", "From "]
    agrees("mbox_read", "documents", [(k, t, "src7") for k, t in enumerate(texts)], "doc_id long, text string, source string")


def test_records_are_dealt_to_all_cores(spark):
    """Three families are no key to deal rows by, and a small file isn't one task's work."""
    from pyspark.sql import functions as F

    from sparkloom.plans import wave4

    rows = wave4.metas(spark, "/root/testdata/sf0.001")
    assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
    dealt = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(dealt) >= 12 and max(dealt) <= 4 * sum(dealt) / len(dealt)


def test_exact_count_keeps_no_sketch_a_word(spark):
    """A sketch is kept a language or a source: no aggregate with one is grouped by the words."""
    plan = plans.queries()["distinct_sketches"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "hll_sketch_agg" in x and "count(distinct" in x]


def test_folders_are_written_and_read_by_even_tasks(spark, tmp_path):
    """Few bytes are no reason to write many folders in one task, nor small files one to read them in many."""
    from pyspark.sql import functions as F

    from sparkloom.sources import folders

    n = F.col("id").cast("string")
    files = spark.range(1200).select(F.concat(F.lit("f"), n).alias("folder"), F.explode(F.array(F.lit("a.md"), F.lit("b.md"), F.lit("c.md"))).alias("file"), F.concat(F.lit("é\n"), n).alias("content"))
    sizes = [r["count"] for r in folders.dealt(files).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 12 and max(sizes) <= 3 * sum(sizes) / len(sizes)
    folders.write_records(files, str(tmp_path / "r"))
    read = folders.read_folders(spark, str(tmp_path / "r"))
    assert read.rdd.getNumPartitions() <= folders.TASKS and sorted(read.collect()) == sorted(files.collect())
    assert {bytes(r.content) for r in folders.read_folders(spark, str(tmp_path / "r"), "file string, content binary").where("file = 'b.md'").limit(1).collect()} <= {f"é\n{k}".encode() for k in range(1200)}


@pytest.mark.parametrize("name", ["export_read", "eml_read"])
def test_a_file_a_conversation_needs_no_folder_or_task_of_its_own(spark, agrees, tmp_path, name):
    from sparkloom.sources.tables import even_tasks

    talk = [(c, t, ("user", "assistant")[t % 2], f"é{c}. {t}\nx") for c in range(1200) for t in range(2)] + [(None, 0, "user", "lost")]
    talk += [(1300, 0, "user", None)] if name == "export_read" else []  # a mail of no text has no SQL of its own
    agrees(name, "conversations", talk, "conv_id long, turn long, role string, text string")
    assert plans.queries()[name](spark, str(tmp_path)).rdd.getNumPartitions() <= even_tasks(spark)


def test_few_buckets_are_written_by_many_tasks(spark, tmp_path):
    """A batch's rows of one bucket go to several tasks: no fewer tasks write because there are few buckets."""
    from sparkloom.streaming import remerge

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows are put together else
    try:
        rows = spark.range(2000).selectExpr("concat('r', id) AS record", "id AS seq", "'## A' AS work_patch", "'P' AS persona_patch", "CAST(NULL AS array<struct<scene:string,wrong:string,correct:string>>) AS fixes")
        remerge.remerge_batch(rows, 0, str(tmp_path), compact=1, buckets=1)
        assert all(len(list(tmp_path.glob(f"{kind}/batch=0/bucket=0/*.parquet"))) > 1 for kind in ("records", "whole"))
        assert remerge.current_records(spark, str(tmp_path), 1, compact=1).count() == 2000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
