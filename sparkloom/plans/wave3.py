"""Research notes and gates, on notes derived from documents and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import lines_of
from ..operators import classify, notes, quality, report
from ..sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = "WITH " + NOTES + sql
        return f

    return register


SECTIONS = ("Evidence", "Contradictions", "Inferences (clearly marked)", "Patterns and repeated themes", "Gaps", "Source Metadata")
#: Lines appended to each note: a weight, a link, and on some a marker or a quote.
TAIL = "['source weight: ' || (1 + n_chars % 7), '- see ' || coalesce(url, '') || ') twice ' || coalesce(url, ''), CASE doc_id % 5 WHEN 0 THEN '- from a Primary Source, first-person' WHEN 1 THEN '> quoted' WHEN 2 THEN 'at 00:01:02.5 it''s said' ELSE '- 一手' END]"
NOTES = f"""n_pages AS (SELECT count(*) AS n FROM pages), raw AS (
  SELECT d.doc_id, d.doc_id // 5 AS corpus, printf('%02d_x-%d.md', 1 + n_chars % 8, doc_id) AS file, list_concat(
    list_transform(string_split(regexp_replace(text, '\\n$', ''), chr(10)), lambda x, i: CASE WHEN (i - 1) % 3 = 0 THEN '## ' || {list(SECTIONS)}[((i - 1) // 3 % 6 + 1)::INT] ELSE '- ' || x END), {TAIL}) AS lines
  FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id % (SELECT n FROM n_pages)
), lines AS (SELECT corpus, file, unnest(lines) AS line, unnest(generate_series(0, len(lines) - 1)) AS i FROM raw
), headed AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS stripped, CASE WHEN regexp_matches(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '^##\\s+.+$') THEN lower(trim(regexp_extract(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '^##\\s+(.+)$', 1))) END AS heading FROM lines
), sec AS (SELECT *, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY corpus, file ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS section FROM headed
), urls AS (SELECT corpus, file, unnest(regexp_extract_all(line, 'https?://[^\\s)]+')) AS url FROM lines
), weights AS (SELECT corpus, file, unnest(regexp_extract_all(line, '(?i)source weight:\\s*(\\d)', 1))::INT AS w FROM lines
), tiers AS (SELECT corpus, count(*) FILTER (w <= 3) AS high, count(*) FILTER (w BETWEEN 4 AND 5) AS mid, count(*) FILTER (w BETWEEN 6 AND 7) AS low FROM weights WHERE w BETWEEN 1 AND 7 GROUP BY corpus
), quotes AS (SELECT corpus, file, CASE WHEN stripped = '' THEN false WHEN stripped LIKE '>%' OR regexp_matches(stripped, '\\b\\d{{2}}:\\d{{2}}:\\d{{2}}(?:[.,]\\d{{1,3}})?\\b') THEN true ELSE regexp_matches(stripped, '["“”'']') AND len(regexp_split_to_array(stripped, '\\s+')) > 25 END AS long FROM sec
), metrics AS (SELECT corpus, count(DISTINCT file) AS files_scanned, sum(length(line) + 1)::BIGINT AS total_chars, count(DISTINCT regexp_extract(file, '^(\\d{{2}})[-_]', 1)) AS track_coverage_count,
    sum(len(regexp_extract_all(line, '(?i)\\b(first-person|primary source)\\b')))::BIGINT AS primary_source_markers,
    count(*) FILTER (heading = 'source metadata') AS source_metadata_blocks,
    count(*) FILTER (heading IS NULL AND stripped LIKE '- %' AND section = 'contradictions') AS contradiction_bullets,
    count(*) FILTER (heading IS NULL AND stripped LIKE '- %' AND section LIKE 'inferences%') AS inference_bullets,
    count(*) FILTER (heading IS NULL AND stripped LIKE '- %' AND section = 'patterns and repeated themes') AS pattern_bullets,
    count(*) FILTER (heading IS NULL AND stripped LIKE '- %' AND (section LIKE 'gaps%' OR section LIKE 'missing information%')) AS gap_bullets FROM sec GROUP BY corpus
), allm AS (SELECT m.*, u.url_mentions, u.unique_urls, q.long_quote_lines, t.high AS high_tier_sources, t.mid AS mid_tier_sources, t.low AS low_tier_sources, round_even(100.0 * t.high / (t.high + t.mid + t.low), 0)::BIGINT AS weighted_source_primary_ratio
  FROM metrics m JOIN (SELECT corpus, count(*) AS url_mentions, count(DISTINCT url) AS unique_urls FROM urls GROUP BY corpus) u USING (corpus) JOIN (SELECT corpus, count(*) FILTER (long) AS long_quote_lines FROM quotes GROUP BY corpus) q USING (corpus) JOIN tiers t USING (corpus))
"""


def note_lines(spark, sf_dir):
    """(corpus, file, i, line): every third line of a document becomes a heading, the others bullets."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages").select("page_id", "url")
    n_pages = pages.agg(F.count(F.lit(1))).scalar()
    linked = docs.withColumn("page", F.col("doc_id") % n_pages).join(pages, F.col("page") == F.col("page_id"), "left")
    names = F.array(*map(F.lit, SECTIONS))
    body = F.transform(lines_of(F.col("text")), lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("## "), F.element_at(names, (F.floor(i / 3) % 6 + 1).cast("int")))).otherwise(F.concat(F.lit("- "), x)))
    url = F.coalesce("url", F.lit(""))
    extra = F.when(F.col("doc_id") % 5 == 0, "- from a Primary Source, first-person").when(F.col("doc_id") % 5 == 1, "> quoted").when(F.col("doc_id") % 5 == 2, "at 00:01:02.5 it's said").otherwise("- 一手")
    tail = F.array(F.concat(F.lit("source weight: "), (1 + F.col("n_chars") % 7).cast("string")), F.concat(F.lit("- see "), url, F.lit(") twice "), url), extra)
    file = F.format_string("%02d_x-%d.md", 1 + F.col("n_chars") % 8, F.col("doc_id"))
    return linked.select(F.floor(F.col("doc_id") / 5).alias("corpus"), file.alias("file"), F.posexplode(F.concat(body, tail)).alias("i", "line"))


@query("SELECT corpus, url_mentions, unique_urls FROM allm")
def url_counts(spark, sf_dir):
    rows = note_lines(spark, sf_dir).select("corpus", F.explode(notes.urls_of(F.col("line"))).alias("url"))
    return rows.groupBy("corpus").agg(F.count(F.lit(1)).alias("url_mentions"), F.count_distinct("url").alias("unique_urls"))


@query("SELECT file, sum(len(regexp_extract_all(line, '(?i)\\b(first-person|primary source)\\b')))::BIGINT AS n, bool_or(regexp_matches(line, '(?i)first-person|primary source|一手|原始')) AS flagged FROM lines GROUP BY file")
def primary_markers(spark, sf_dir):
    return note_lines(spark, sf_dir).groupBy("file").agg(F.sum(F.regexp_count("line", F.lit(notes.PRIMARY))).alias("n"), F.bool_or(F.col("line").rlike(notes.PRIMARY_FLAG)).alias("flagged"))


@query("SELECT corpus, source_metadata_blocks, contradiction_bullets, inference_bullets, pattern_bullets, gap_bullets FROM metrics")
def notes_sections(spark, sf_dir):
    rows = notes.with_sections(note_lines(spark, sf_dir))
    return rows.groupBy("corpus").agg(*[c.alias(n) for n, c in notes.section_counts().items()])


@query("SELECT corpus, high, mid, low, round_even(100.0 * high / (high + mid + low), 0)::BIGINT AS ratio FROM tiers")
def source_tiers(spark, sf_dir):
    rows = note_lines(spark, sf_dir).select("corpus", F.explode(notes.weights_of(F.col("line"))).alias("w"))
    tier = classify.source_tier(F.col("w"))
    out = rows.groupBy("corpus").agg(*[F.count_if(tier == t).alias(t) for t in ("high", "mid", "low")])
    return out.withColumn("ratio", notes.primary_ratio(F.col("high"), F.col("high") + F.col("mid") + F.col("low")))


@query("""SELECT corpus, place, file, finding FROM (SELECT corpus, file, finding, row_number() OVER (PARTITION BY corpus ORDER BY file, i) AS place FROM (SELECT corpus, file, i, trim(substr(stripped, 3)) AS finding, row_number() OVER (PARTITION BY corpus, file ORDER BY i) AS k
  FROM sec WHERE heading IS NULL AND stripped LIKE '- %' AND section IN ('evidence', 'key findings', 'paraphrased findings', 'patterns and repeated themes')) WHERE k <= 2) WHERE place <= 10""")
def key_findings(spark, sf_dir):
    return notes.key_findings(notes.with_sections(note_lines(spark, sf_dir)))


@query("SELECT file, count(*) FILTER (long) AS n FROM quotes GROUP BY file")
def long_quote_lines(spark, sf_dir):
    return note_lines(spark, sf_dir).groupBy("file").agg(F.count_if(notes.is_long_quote(F.col("line"))).alias("n"))


@query("""SELECT corpus, count(DISTINCT t) AS n, string_agg(t, ',' ORDER BY t) AS covered, array_to_string(list_filter(['01', '02', '03', '04', '05', '06'], lambda x: NOT list_contains(list(t), x)), ',') AS missing
  FROM (SELECT DISTINCT corpus, file, regexp_extract(file, '^(\\d{2})[-_]', 1) AS t FROM raw) GROUP BY corpus""")
def track_coverage(spark, sf_dir):
    files = note_lines(spark, sf_dir).select("corpus", "file").distinct().withColumn("t", notes.track_of(F.col("file")))
    out = files.groupBy("corpus").agg(F.count_distinct("t").alias("n"), F.sort_array(F.collect_list("t")).alias("c"))
    missing = F.array_except(F.array(*map(F.lit, notes.TRACKS)), "c")
    return out.select("corpus", "n", F.array_join("c", ",").alias("covered"), F.array_join(missing, ",").alias("missing"))


@query("SELECT * FROM allm")
def notes_summary(spark, sf_dir):
    return notes.corpus_metrics(note_lines(spark, sf_dir))


REVIEWS = "reviews AS (SELECT corpus, ['audit', 'synthesis', 'validation'][k] AS kind, CASE (corpus + k) % 4 WHEN 0 THEN 'Status: PASS / FAIL' WHEN 1 THEN 'verdict PASS\nQuestion: a\nQuestion: b\nan Edge-Case' WHEN 2 THEN 'Status: PASSED' ELSE 'Release Readiness:  ready' END AS t FROM (SELECT DISTINCT corpus FROM raw), (SELECT unnest([1, 2, 3]) AS k) WHERE (corpus + k) % 5 > 0)"


@query(f", {REVIEWS} SELECT corpus, kind, regexp_matches(t, '(?i)Status:\\s*PASS\\b|Release readiness:\\s*ready\\b|Verdict:?\\s*PASS\\b') AS passes FROM reviews")
def review_status(spark, sf_dir):
    return reviews(spark, sf_dir).select("corpus", "kind", classify.review_passes(F.col("t")).alias("passes"))


def reviews(spark, sf_dir):
    corpora = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 5).alias("corpus")).distinct()
    kinds = F.array(*[F.struct(F.lit(k + 1).alias("k"), F.lit(n).alias("kind")) for k, n in enumerate(("audit", "synthesis", "validation"))])
    rows = corpora.select("corpus", F.explode(kinds).alias("r")).select("corpus", "r.kind", (F.col("corpus") + F.col("r.k")).alias("s")).where("s % 5 > 0")
    t = F.when(F.col("s") % 4 == 0, "Status: PASS / FAIL").when(F.col("s") % 4 == 1, "verdict PASS\nQuestion: a\nQuestion: b\nan Edge-Case").when(F.col("s") % 4 == 2, "Status: PASSED").otherwise("Release Readiness:  ready")
    return rows.select("corpus", "kind", t.alias("t"))


DRAFT = "'# Draft' || chr(10) || '- mental model one' || chr(10) || '- Limitations' || chr(10) || CASE WHEN corpus % 3 > 0 THEN '- Expression DNA' ELSE '* metaphor' END || chr(10) || 'honest boundary; tension; influenced by x' || chr(10) || 'Agentic Protocol https://a.example.com/one/two. https://a.example.com/one/' || corpus || ', (https://a.example.com/topic/) https://a.example.com/longslug1' || CASE WHEN corpus % 4 = 0 THEN ' https://b.example.com/x?id=1' ELSE '' END || CASE WHEN corpus % 7 = 0 THEN chr(10) || '> cited' ELSE '' END"
PROFILE = "CASE WHEN corpus % 2 = 0 THEN 'budget-unfriendly' ELSE 'budget-friendly' END"
_MATCH = {k: f"regexp_matches(d, '(?i){p}')" for k, p in quality.PATTERNS.items()}


#: What a draft is judged by, besides its text: counts over its notes, then what its reviews are and say.
COUNTED = ("files_scanned", "unique_urls", "primary_source_markers", "source_metadata_blocks", "contradiction_bullets", "inference_bullets", "pattern_bullets", "gap_bullets", "long_quote_lines", "track_coverage_count", "high_tier_sources", "mid_tier_sources", "low_tier_sources", "weighted_source_primary_ratio")
REVIEWED = {"research_audit_present": "a", "synthesis_review_present": "s", "validation_review_present": "v", "research_audit_pass": "ap", "validation_review_pass": "vp"}
_RESEARCH = ", ".join([f"{c}: {c}" for c in COUNTED] + [f"{k}: coalesce({c}, false)" for k, c in REVIEWED.items()] + ["known_answer_questions: coalesce(q, 0)", "edge_case_markers: coalesce(e, 0)"])
CHECKED = f""", {REVIEWS}, r AS (SELECT corpus, bool_or(kind = 'audit') AS a, bool_or(kind = 'synthesis') AS s, bool_or(kind = 'validation') AS v, coalesce(bool_or(passes) FILTER (kind = 'audit'), false) AS ap, coalesce(bool_or(passes) FILTER (kind = 'validation'), false) AS vp,
  coalesce(sum(len(regexp_extract_all(t, 'Question:\\s*'))) FILTER (kind <> 'synthesis'), 0) AS q, coalesce(sum(len(regexp_extract_all(t, '(?i)edge-case|edge case'))) FILTER (kind <> 'synthesis'), 0) AS e
  FROM (SELECT *, regexp_matches(t, '(?i)Status:\\s*PASS\\b|Release readiness:\\s*ready\\b|Verdict:?\\s*PASS\\b') AS passes FROM reviews) GROUP BY corpus),
  x AS (SELECT m.*, r.* EXCLUDE (corpus), m.corpus AS c, {DRAFT.replace('corpus', 'm.corpus')} AS d, m.corpus % 2 = 0 AS strict FROM allm m LEFT JOIN r USING (corpus)),
  k AS (SELECT corpus, strict, {_MATCH['limitations']} AS limitations, {_MATCH['expression_dna']} AS expression_dna, {_MATCH['honest_boundaries']} AS honest_boundaries, {_MATCH['internal_tension']} AS internal_tension,
   len(regexp_extract_all(d, '(?m)^\\s*[-*]\\s+')) >= 3 AND {_MATCH['mental_models']} AS mental_models, 3 + CASE WHEN corpus % 4 = 0 THEN 1 ELSE 0 END >= CASE WHEN strict THEN 4 ELSE 2 END AS source_grounding, d, len(regexp_extract_all(d, '(?m)^\\s*[-*]\\s+')) AS n_bullets, long_quote_lines,
   NOT regexp_matches(d, '(?m)^\\s*>') AND long_quote_lines = 0 AS copyright_safety, NOT strict OR {_MATCH['intellectual_genealogy']} AS intellectual_genealogy, NOT strict OR {_MATCH['agentic_protocol']} AS agentic_protocol,
   NOT strict OR weighted_source_primary_ratio >= 50 OR high_tier_sources >= 3 AS source_hierarchy, NOT strict OR coalesce(a AND s AND v AND ap AND vp, false) AS review_chain, NOT strict OR (coalesce(q, 0) >= 2 AND coalesce(e, 0) >= 1) AS validation_depth,
   NOT strict OR (files_scanned >= 6 AND unique_urls >= 8 AND primary_source_markers >= 3 AND source_metadata_blocks >= 6 AND contradiction_bullets >= 6 AND inference_bullets >= 6 AND track_coverage_count >= 6) AS research_depth, {{{_RESEARCH}}} AS research FROM x)"""
CHECKS = ("mental_models", "limitations", "expression_dna", "honest_boundaries", "internal_tension", "intellectual_genealogy", "agentic_protocol", "source_grounding", "copyright_safety", "source_hierarchy", "review_chain", "validation_depth", "research_depth")
_ALL = " AND ".join(CHECKS)


@query(f"{CHECKED} SELECT * EXCLUDE (d, n_bullets, long_quote_lines, research), {_ALL} AS passed FROM k")
def quality_checks(spark, sf_dir):
    out = checked(spark, sf_dir)
    out = out.select("corpus", (F.col("profile") == quality.STRICT).alias("strict"), *CHECKS)
    return out.withColumn("passed", quality.passed(quality.check_map({k: F.col(k) for k in CHECKS})))


def checked(spark, sf_dir):
    """A draft for each corpus with its metrics, reviews and one column per check."""
    metrics = notes.corpus_metrics(note_lines(spark, sf_dir))
    r = reviews(spark, sf_dir).withColumn("passes", classify.review_passes(F.col("t")))
    has = lambda k: F.bool_or(F.col("kind") == k)
    ok = lambda k: F.bool_or((F.col("kind") == k) & F.col("passes"))
    read = lambda p: F.sum(F.when(F.col("kind") != "synthesis", F.regexp_count("t", F.lit(p))).otherwise(0))
    r = r.groupBy("corpus").agg(has("audit").alias("research_audit_present"), has("synthesis").alias("synthesis_review_present"), has("validation").alias("validation_review_present"), ok("audit").alias("research_audit_pass"), ok("validation").alias("validation_review_pass"), read(r"Question:\s*").alias("known_answer_questions"), read("(?i)edge-case|edge case").alias("edge_case_markers"))
    rows = metrics.join(r, "corpus", "left").withColumns({"d": F.expr(DRAFT.replace("chr(10)", "'\\n'")), "profile": F.expr(PROFILE)})
    named = quality.checks(F.col("d"), F.col("profile"), F.col)
    return rows.withColumns(named)


@query(f"""{CHECKED} SELECT corpus, {" || chr(10) || ".join(f"CASE WHEN {c} THEN 'PASS' ELSE 'FAIL' END || '  {c}'" for c in CHECKS)} || chr(10) || 'OVERALL ' || CASE WHEN {_ALL} THEN 'PASS' ELSE 'FAIL' END AS report,
  to_json({{passed: {_ALL}, checks: {{{", ".join(f"{c}: {c}" for c in CHECKS)}}}, bullet_count: n_bullets, grounded_url_count: 3 + CASE WHEN corpus % 4 = 0 THEN 1 ELSE 0 END, profile: CASE WHEN strict THEN 'budget-unfriendly' ELSE 'budget-friendly' END, research_metrics: research}})::VARCHAR AS json FROM k""")
def gate_report(spark, sf_dir):
    """All checks as lines and as JSON."""
    rows = checked(spark, sf_dir)
    named = {k: F.col(k) for k in CHECKS}
    passed = quality.passed(quality.check_map(named))
    metrics = {c: F.col(c) for c in COUNTED} | {c: F.coalesce(c, F.lit(False)) for c in REVIEWED} | {c: F.coalesce(c, F.lit(0)) for c in ("known_answer_questions", "edge_case_markers")}
    json = report.gate_json(named, passed, quality.bullets(F.col("d")), F.size(quality.grounded_urls(F.col("d"))), F.col("profile"), metrics)
    return rows.select("corpus", report.gate_report(named, passed).alias("report"), json.alias("json"))


CITED = "CASE doc_id % 13 WHEN 0 THEN '- via https://www.zhihu.com/question/1' WHEN 4 THEN '- 微信公众号 post' WHEN 5 THEN '- 10 lessons from X' WHEN 6 THEN '- 10 big lessons, quoting a primary source, https://x.example/a' WHEN 7 THEN '- Wikipedia as a pointer' WHEN 8 THEN '- Wikipedia, primary source' WHEN 9 THEN '- an AI-generated biography' WHEN 10 THEN '- SEO summary site' ELSE '- own notes' END"
_NAMED = "CASE doc_id % 13 WHEN 0 THEN 'zhihu' WHEN 4 THEN 'wechat' WHEN 5 THEN 'listicle' WHEN 8 THEN 'encyclopedia' WHEN 9 THEN 'generated biography' WHEN 10 THEN 'content farm' END"


@query(f"SELECT source_class, count(*) AS n, count(DISTINCT corpus) AS corpora FROM (SELECT doc_id // 5 AS corpus, {_NAMED} AS source_class FROM documents) WHERE source_class IS NOT NULL GROUP BY source_class")
def cited_blacklist(spark, sf_dir):
    """Lines that cite what is never evidence, by the kind of source: named sites, lists of lessons, generated and search-optimised pages, encyclopedias as primary sources."""
    lines = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 5).alias("corpus"), F.expr(CITED).alias("line"))
    cited = quality.blacklisted(lines, quality.blacklist(spark))
    return cited.groupBy(F.col("source").alias("source_class")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("corpus").alias("corpora"))


@query(f"""SELECT corpus, track_coverage_count >= 6 AS all_tracks, unique_urls >= 8 AS grounded, weighted_source_primary_ratio > 50 AS "primary", contradiction_bullets >= 3 AS contradictions, clean, low_tier_sources <= high_tier_sources + mid_tier_sources AS not_bottom_heavy,
  track_coverage_count >= 6 AND unique_urls >= 8 AND weighted_source_primary_ratio > 50 AND contradiction_bullets >= 3 AND clean AND low_tier_sources <= high_tier_sources + mid_tier_sources AS passed
  FROM (SELECT *, corpus NOT IN (SELECT doc_id // 5 FROM documents WHERE {_NAMED} IS NOT NULL) AS clean FROM allm)""")
def audit_gate(spark, sf_dir):
    """Each corpus against the audit's conditions; sources are judged against the blacklist of kinds."""
    lines = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 5).alias("corpus"), F.expr(CITED).alias("line"))
    cited = quality.blacklisted(lines, quality.blacklist(spark))
    out = quality.audit(notes.corpus_metrics(note_lines(spark, sf_dir)), cited)
    return out.select("corpus", "all_tracks", "grounded", "primary", "contradictions", "clean", "not_bottom_heavy", "passed")


@query("SELECT weight, class, tier, count(*) AS n FROM (SELECT unnest(list_transform(list_filter(regexp_extract_all(line, '(?i)source weight:\\s*(\\d)', 1), lambda x: x::INT BETWEEN 1 AND 7), lambda x: x::INT)) AS weight FROM lines) JOIN (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS weight, unnest(['local material', 'first-person work', 'long-form interview', 'documented decision', 'short first-person post', 'external analysis', 'secondhand summary']) AS class, unnest(['high', 'high', 'high', 'mid', 'mid', 'low', 'low']) AS tier) USING (weight) GROUP BY ALL")
def source_classes(spark, sf_dir):
    """Cited weights by the class of source that they stand for."""
    rows = note_lines(spark, sf_dir).select(F.explode(notes.weights_of(F.col("line"))).alias("weight"))
    counted = rows.groupBy("weight").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(F.broadcast(quality.hierarchy(spark)), "weight").select("weight", "class", "tier", "n")  # seven rows


@query("SELECT corpus, CASE n WHEN 3 THEN 'keep' WHEN 0 THEN 'discard' ELSE 'demote' END AS verdict FROM (SELECT corpus, (track_coverage_count >= 3)::INT + (contradiction_bullets >= 6)::INT + (weighted_source_primary_ratio >= 50)::INT AS n FROM allm)")
def triple_gate(spark, sf_dir):
    m = notes.corpus_metrics(note_lines(spark, sf_dir))
    return m.select("corpus", quality.triple_gate(F.col("track_coverage_count") >= 3, F.col("contradiction_bullets") >= 6, F.col("weighted_source_primary_ratio") >= 50).alias("verdict"))


@query("SELECT corpus, unique_urls AS sources FROM allm WHERE unique_urls < 10")
def cold_figure(spark, sf_dir):
    rows = note_lines(spark, sf_dir).select("corpus", F.explode(notes.urls_of(F.col("line"))).alias("url"))
    return rows.groupBy("corpus").agg(F.count_distinct("url").alias("sources")).where("sources < 10")


_LINES = " || chr(10) || ".join(f"'- {label}: ' || {name}" for label, name in report.SUMMARY)


@query(f"SELECT corpus, '# Research Summary' || chr(10) || chr(10) || {_LINES} || chr(10) || '- Weighted-source primary ratio: ' || weighted_source_primary_ratio || '%' AS report FROM allm")
def notes_report(spark, sf_dir):
    return report.summary_report(notes.corpus_metrics(note_lines(spark, sf_dir)), "corpus")
