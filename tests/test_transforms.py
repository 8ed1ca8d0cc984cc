"""Transforms on small inputs, against plain Python where SQL has no word for them."""

import json
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import text as tx
from sparkloom.functions import urls
from sparkloom.operators import classify, nested, notes, quality, records, select, transcript
from sparkloom.sources import exports


def values(spark, rows, expr, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(expr).collect()]


def fold(lines, full=240):
    out, current = [], []
    for line in lines:
        current.append(line)
        joined = " ".join(current)
        if len(joined) >= full or re.search(r"[.!?。！？]$", line):
            out.append(joined)
            current = []
    return out + ([" ".join(current)] if current else [])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text(alphabet="ab .!。", min_size=1, max_size=60), max_size=12), min_size=1, max_size=6))
def test_paragraphs_match_a_plain_fold(spark, docs):
    docs = [[x for x in (line.strip() for line in d) if x] for d in docs]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, x array<string>")
    got = {r[0]: r[1] for r in df.select("i", transcript.paragraphs(F.col("x"), 40)).collect()}
    assert [got[i] for i in range(len(docs))] == [fold(d, 40) for d in docs]


def test_transcript_of_captions(spark):
    vtt = "WEBVTT\nKind: captions\n\nNOTE hidden\n\n1\n00:00:01.000 --> 00:00:02.000 align:left\n<i>Hello</i> there position:50%\n\n2\n00:00:02.000 --> 00:00:03.000\nHello there\nand more."
    assert values(spark, [vtt, "", None], transcript.transcript(F.col("x"))) == ["Hello there and more.", "", None]


def test_transcript_of_other_line_ends(spark):
    crlf = "WEBVTT\r\n\r\n1\r\n00:01.000 --> 00:02.000\r\nHello there.\r\n\r\nNOTE x\r\n\r\n2\r\n00:02.000 --> 00:03.000\r\nTwo\x0bThree\u2028Three.\r"
    assert values(spark, [crlf, "one\rtwo\x85\u3000two \u3000"], transcript.transcript(F.col("x"))) == ["Hello there.\n\nTwo Three Three.", "one two"]


def test_captions_are_cleaned_in_linear_time(spark):
    import time

    def took(n):
        text = "\n".join(f"00:00:01.000 --> 00:00:02.000\nline {i}" for i in range(n))
        df = spark.createDataFrame([(text,)] * 40, "x string").select(F.size(transcript.without_repeats(transcript.cue_lines(F.col("x")))).alias("n"))
        began = time.time()
        assert {r.n for r in df.collect()} == {n}
        return time.time() - began

    took(100)
    assert took(1600) < 3 * took(400) + 4  # four times the lines; squared it would be sixteen times the time


def test_html_references_are_decoded(spark):
    page = "<p>caf&eacute; &#39;a&#39; &#x41;&hellip;</p>&amp;lt;b&gt; &copy2020<script>&eacute;</script>"
    assert values(spark, [page, None, "plain"], tx.html_to_text(F.col("x"))) == ["caf\u00e9 'a' A\u2026\n&lt;b> \u00a92020", None, "plain"]


def test_the_cap_comes_before_membership(spark):
    channels = spark.createDataFrame([("a", True), ("b", False), ("c", True), ("d", True), ("e", None)], "channel_id string, is_member boolean")
    members = spark.createDataFrame([("b", "u"), ("c", "u"), ("d", "u"), ("e", "u")], "channel_id string, member_id string")
    names = lambda n: [r.channel_id for r in select.shared_channels(channels, members, "u", most=n).collect()]
    assert names(2) == ["c"] and sorted(names(None)) == ["c", "d"]


def test_directory_stops_after_the_group_that_has_enough(spark):
    users = [(d, p, f"ann {p}" if p % 2 else "bob", None, f"u{p % 5}" if p != 3 else None, "o" if p == 3 else None) for d in range(4) for p in range(6)]
    rows = spark.createDataFrame(users, "dept int, place int, name string, en_name string, user_id string, open_id string")
    got = sorted((r.dept, r.place) for r in select.directory_matches(rows, "ann", "dept", "place", enough=5).collect())
    assert got == [(0, 1), (0, 3), (0, 5)]
    assert select.directory_matches(rows, "zoe", "dept", "place").count() == 0


def test_reports_are_written_in_order(spark, tmp_path):
    from sparkloom.operators import report

    rows = spark.createDataFrame([("p", i, "thread" if i % 50 == 0 else "long" if i % 3 else "short", f"t{i}", "c", f"text {i}") for i in range(400)], "who string, seq long, tier string, time string, channel string, content string")
    lines = report.thread_report(rows, "who", shorts=3)
    report.write_report(lines, "who", str(tmp_path / "r"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "r" / "who=p").glob("part-*"))).splitlines()
    threads = [x for i in range(0, 400, 50) for x in (f"[t{i}][#c] text {i}", "")]
    assert text[:6] == ["# Slack 消息记录（自动采集）", "目标：p", "共 400 条消息", "  话题发起消息：8 条", f"  长消息（>50字）：{sum(i % 50 > 0 and i % 3 > 0 for i in range(400))} 条", f"  短消息：{sum(i % 50 > 0 and i % 3 == 0 for i in range(400))} 条"]
    assert text[6:11] == ["", "---", "", report.THREADS[0], ""] and text[11:11 + len(threads)] == threads
    assert text[-3:] == [f"[t{i}] text {i}" for i in (3, 6, 9)] and report.THREADS[1] in text
    assert report.thread_report(rows.limit(0), "who").count() == 0


def test_wiki_pages_lead_to_their_object(spark):
    from sparkloom.operators import report

    links = spark.createDataFrame([("W", "https://x/wiki/W1", "me"), ("D", "https://x/docx/D2?a", None), ("gone", "https://x/wiki/W9", "me"), ("mail", "https://x/mail/1", "me"), (None, "https://x/docs/D3", "me")], "title string, url string, creator string")
    nodes = spark.createDataFrame([("W1", "D1")], "token string, obj_token string")
    objects = spark.createDataFrame([("D1", "  the first text, long enough "), ("D2", "short"), ("D3", "x" * 20)], "token string, content string")
    got = {r.title: r.block for r in report.doc_blocks(report.resolved_docs(links, nodes, objects)).collect()}
    assert got == {"W": "---\n## 《W》\n链接：https://x/wiki/W1\n创建人：me\n\nthe first text, long enough\n", None: f"---\n## 《无标题》\n链接：https://x/docs/D3\n创建人：me\n\n{'x' * 20}\n"}


def test_record_folders(spark, tmp_path):
    for name, text in (("b", '{"slug": "b", "version": "v2"}'), ("a", '{"slug": "a"}'), ("bad", '{"slug": '), ("list", "[1]")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "meta.json").write_text(text)
    (tmp_path / "empty").mkdir()
    got = records.read_records(spark, str(tmp_path), "slug string, version string").collect()
    assert [(r.folder, r.slug, r.version) for r in got] == [("a", "a", None), ("b", "b", "v2")]


def test_corrections_log_keeps_the_newest(spark):
    log = "P\n\n## Correction Log\n" + "\n".join(f"- [s] {i}" for i in range(5)) + "\ntail\n- [s] 9"
    kept = values(spark, [log, "no log\n- [s] 1", None], records.newest_corrections(F.col("x"), 3))
    assert kept == ["P\n\n## Correction Log\n- [s] 0\n- [s] 1\n- [s] 2\ntail", "no log\n- [s] 1", None]


def test_templates_leave_braces_of_values(spark):
    got = values(spark, ["{identity}"], records.filled("a {x} {{b}}", {"x": F.col("x"), "b": F.lit("B")}))
    assert got == ["a {identity} {B}"]
    assert values(spark, ["ZH-cn", "", None], records.language_code(F.col("x"), F.lit("de"))) == ["zh-cn", "de", "de"]


def test_given_values_win(spark):
    defaults = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    given = F.when(F.col("x") == "y", F.create_map(F.lit("b"), F.lit(None).cast("string"), F.lit("c"), F.lit("3")))
    assert values(spark, ["y", "n"], records.merged(defaults, given)) == [{"a": "1", "b": None, "c": "3"}, {"a": "1", "b": "2"}]


def test_audit_conditions(spark):
    lines = spark.createDataFrame([(1, "see https://www.zhihu.com/q/1"), (2, "own"), (3, "微信公众号 x")], "corpus int, line string")
    cited = quality.blacklisted(lines, quality.blacklist(spark))
    assert {(r.corpus, r.source) for r in cited.collect()} == {(1, "zhihu"), (3, "wechat")}
    good = (6, 8, 51, 3, 1, 2, 2)
    rows = [(k, *good) for k in (1, 2, 3)] + [(4, 6, 8, 50, 3, 1, 2, 2), (5, 6, 8, 90, 3, 1, 0, 2)]
    m = spark.createDataFrame(rows, "corpus int, track_coverage_count int, unique_urls int, weighted_source_primary_ratio int, contradiction_bullets int, high_tier_sources int, mid_tier_sources int, low_tier_sources int")
    assert {r.corpus: r.passed for r in quality.audit(m, cited).collect()} == {1: False, 2: True, 3: False, 4: False, 5: False}
    assert [r.tier for r in quality.hierarchy(spark).orderBy("weight").collect()] == ["high"] * 3 + ["mid"] * 2 + ["low"] * 2


def test_windowed_counts_close_with_the_watermark(spark, tmp_path):
    from sparkloom.streaming import incremental

    rows = [("2024-01-01 00:00:00", "a"), ("2024-01-01 00:30:00", "a"), ("2024-01-01 01:10:00", "b"), ("2024-01-01 05:00:00", "a")]
    spark.createDataFrame(rows, "t string, k string").selectExpr("CAST(t AS timestamp) AS t", "k").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, k string").parquet(str(tmp_path / "in"))
    counts = incremental.windowed_counts(stream, "t", "k")
    counts.writeStream.outputMode("append").format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination()
    got = {(str(r["window"].start), r.k, r.n) for r in spark.table("closed").collect()}
    assert {("2024-01-01 00:00:00", "a", 2), ("2024-01-01 01:00:00", "b", 1)} == got


def test_tiers_partition_messages(spark):
    got = values(spark, ["x" * 51, "同意", "ok", "", None, "😀" * 50], classify.message_tier(F.col("x")))
    assert got == ["long", "decision", "daily", "daily", "daily", "daily"]


def test_noise_and_placeholders(spark):
    assert values(spark, [" [图片]\t", "", None, "hi"], classify.is_placeholder(F.col("x"))) == [True, True, True, False]
    assert values(spark, ["<@U1> :ok:", "k", "<@U1> yes", None], classify.is_noise(F.col("x"))) == [True, True, False, True]


def test_urls(spark):
    cases = {"https://a.com/": False, "https://a.com": False, "https://a.com/topic/": False, "https://a.com/one/two": True, "https://a.com/longslug1": True, "https://a.com/s?VID=2": True, "ftp://a.com/one/two": False, "no url": False}
    assert dict(zip(cases, values(spark, list(cases), urls.is_concrete_source(F.col("x"))))) == cases


def test_rich_text_and_unions(spark):
    assert values(spark, ['{"text":"a"}', '{"content":[[{"tag":"text","text":"x"},{"tag":"img","text":"y"}],[{"tag":"a","text":"z"}]]}', "junk", None], nested.rich_text(F.col("x"))) == ["a", "x z", "", ""]
    cases = {'"plain"': "plain", '{"content":"c"}': "c", '[{"text":"a"},"b",3,{"tag":"x"}]': "a b 3 ", '"[OK] merged, thanks"': "[OK] merged, thanks", '"{x} is"': "{x} is", "5": "5", '{"text":["p",{"text":"q"}]}': "p q", '{"a":1}': '{"a":1}', "[]": "", "junk": ""}
    assert dict(zip(cases, values(spark, list(cases), nested.text_of(F.try_parse_json("x"))))) == cases
    falsy = ["null", "false", "0", "0.0", '""', "[]", "{}", "junk"]
    assert values(spark, falsy + ["true", "1", '"0"', '"false"', "[0]"], nested.truthy(F.try_parse_json("x")).isNull()) == [True] * 8 + [False] * 5


def test_corrections_shapes(spark):
    cases = ['{"wrong":"a","correct":"b"}', '[{"scene":"s","wrong":"a","correct":"b"}]', '{"corrections":[{"wrong":"a"},{"wrong":"c","correct":"d"}]}', '{"x":1}', None]
    got = values(spark, cases, F.to_json(nested.corrections(F.col("x"))))
    assert [len(json.loads(g)) for g in got] == [1, 1, 1, 0, 0]


def test_tree_depth_is_bounded(spark):
    edges = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "c")], "parent string, child string")
    assert {r[0]: r[1] for r in select.descend(edges, "r", 2).collect()} == {"r": 0, "a": 1, "b": 2}
    assert {r[0]: r[1] for r in select.descend(edges, "r").collect()} == {"r": 0, "a": 1, "b": 2, "c": 3}
    more = edges.union(spark.createDataFrame([("c", "r"), ("it's", "x"), ("r", "z"), ("r", "b")], edges.schema))
    assert {r[0]: r[1] for r in select.descend(more, "r").collect()} == {"r": 0, "a": 1, "b": 1, "z": 1, "c": 2}
    assert {r[0] for r in select.descend(more, "r", most_children=2).collect()} == {"r", "a", "b", "c"}
    assert {r[0]: r[1] for r in select.descend(more, "it's").collect()} == {"it's": 0, "x": 1}


def test_first_success_prefers_earlier_parts(spark):
    a = spark.createDataFrame([(1, "a")], "k int, v string")
    b = spark.createDataFrame([(1, "b"), (2, "b")], "k int, v string")
    assert sorted((r.k, r.v) for r in select.first_success([a, b], "k").collect()) == [(1, "a"), (2, "b")]


def test_versions(spark):
    assert values(spark, ["v1", "v3_restored", "v2_before_rollback", "draft", None], records.next_version(F.col("x"))) == ["v2", "v4", "v3", "v2", "v2"]
    rows = spark.createDataFrame([("s", 1, "v1", "one"), ("s", 2, "v2", "two"), ("t", 1, "v2", "x")], "k string, seq long, version string, body string")
    got = {(r.k, r.seq): (r.version, r.body) for r in records.rolled_back(rows, "k", "v1").collect()}
    assert got[("s", 3)] == ("v2_before_rollback", "two") and got[("s", 4)] == ("v1_restored", "one") and ("t", 2) not in got


def test_gate_passes_only_if_all_checks_do(spark):
    draft = "- mental model\n- limitations\n- expression DNA honest boundary tension\nhttps://a.com/one/two https://a.com/longslug1"
    df = spark.createDataFrame([(draft, "budget-friendly"), (draft, "budget-unfriendly"), (draft + "\n> quote", "budget-friendly")], "t string, p string")
    named = quality.checks(F.col("t"), F.col("p"), lambda name: F.lit(None))
    rows = df.select(quality.check_map(named).alias("m")).withColumn("passed", quality.passed(F.col("m"))).collect()
    assert [r["passed"] for r in rows] == [True, False, False] and all(r["passed"] == all(r["m"].values()) for r in rows)


def test_notes_metrics(spark):
    text = ["## Source Metadata", "- w", "## Contradictions", "- one", "## Inferences (marked)", "- two", "## Evidence", "- see https://a.com/x) and https://a.com/x", "source weight: 2"]
    rows = [(0, "01-a.md", i, line) for i, line in enumerate(text)] + [(0, "02.md", 0, "> quoted")]
    m = notes.corpus_metrics(spark.createDataFrame(rows, "corpus int, file string, i int, line string")).first()
    assert (m.source_metadata_blocks, m.contradiction_bullets, m.inference_bullets, m.unique_urls, m.url_mentions) == (1, 1, 1, 1, 2)
    assert (m.long_quote_lines, m.track_coverage_count, m.weighted_source_primary_ratio, m.files_scanned) == (1, 1, 100, 2)


def test_time_and_names(spark):
    assert values(spark, ["0", "1700000000.5", "soon"], tx.minute_from_seconds(F.col("x"))) == ["1970-01-01 00:00", "2023-11-14 22:13", "soon"]
    assert values(spark, ["Ann Lee", "  a__b ", "张三", ""], tx.slugify(F.col("x"))) == ["ann_lee", "a_b", "colleague", "colleague"]


def test_chat_json_reader(spark, tmp_path):
    rows = [{"sender_name": "", "sender": "Ann", "content": " hi "}, {"from": "Ann", "text": {"text": "obj"}}, {"sender": "Bob", "content": "no"}, {"sender": "Ann", "content": "[图片]"}, {"user_name": "Ann", "body": [{"text": "a"}, "b"], "time": "t"}]
    (tmp_path / "a.json").write_text(json.dumps({"messages": [], "records": rows}))
    (tmp_path / "b.json").write_text(json.dumps(rows[:1]))
    got = sorted((r.seq, r.sender, r.content) for r in exports.read_chat_json(spark, str(tmp_path), "Ann").collect())
    assert got == [(0, "Ann", "hi"), (0, "Ann", "hi"), (1, "Ann", "obj"), (4, "Ann", "a b")]


def test_chat_log_reader(spark, tmp_path):
    (tmp_path / "a.txt").write_text("2024-01-02 10:00 Ann：hello\n2024/1/2 9:00 Bob: x\n\nAnn left\nnothing\n")
    got = [(r.sender, r.content) for r in exports.read_chat_log(spark, str(tmp_path), "Ann").collect()]
    assert sorted(got) == [("Ann", "Ann left"), ("Ann", "hello")]


def test_mail_readers(spark, tmp_path):
    plain = "From: =?utf-8?b?QW5u?= <ann@x.org>\nSubject: s\nDate: d\n\nhello\n> old\n"
    both = "From: Ann\nSubject: h\nMIME-Version: 1.0\nContent-Type: multipart/alternative; boundary=b\n\n--b\nContent-Type: text/html\n\n<p>rich</p>\n--b\nContent-Type: text/plain\n\nplain wins\n--b--\n"
    rich = "From: Ann\nContent-Type: text/html\n\n<p>one</p><script>x</script>two\n"
    for name, mail in (("a.eml", plain), ("b.eml", both), ("c.eml", rich)):
        (tmp_path / name).write_text(mail)
    got = {r.subject: r.body for r in exports.read_mail(spark, str(tmp_path), "ANN").collect()}
    assert got == {"s": "hello", "h": "plain wins", "": "<p>one</p><script>x</script>two"}  # a lone part is taken as it is
    box = tmp_path / "box"
    box.mkdir()
    (box / "m.mbox").write_text("From a@x Mon\n" + plain + "\nFrom b@x Tue\n" + rich)
    assert sorted(r.body for r in exports.read_mail(spark, str(box / "m.mbox"), "ann", mbox=True).collect()) == ["<p>one</p><script>x</script>two", "hello"]
