"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, lexical, minhash, mixing, personal, quality, quality_rules, secrets, suffix, toxicity, url_rules, whitening
from .common import arrow_rows, cut, fold_of, read, written


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in secrets.RULES if r.base]
    n = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    only = F.filter("secret_spans", lambda s: s["kind"].isin(base))
    return found.select(
        "doc_id",
        *[n(k).alias(f"n_{k}") for k in base],
        F.sha2(secrets.join_spans(only), 256).alias("base_sha256"),
        secrets.join_spans(F.col("secret_spans")).alias("spans"),
    )


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.toxicity(docs, read(spark, sf_dir, "labels"), train=lambda k: fold_of(k, 5) != 0)
    held_out = F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.repeated_spans(read(spark, sf_dir, "documents"))
    removed = (F.col("n_bytes") - F.octet_length("kept")).cast("long")
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.quality(docs, read(spark, sf_dir, "labels"), train=lambda k: fold_of(k, 4) != 2)
    held_out = F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    slim = cut(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")))
    mixed = mixing.mix(slim, size=F.col("size"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The texts are counted once; labels then meet the counts alone.
    counted = cut(quality_rules.base_columns(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    out = quality_rules.judged(counted, read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = personal.fit(docs)
    with arrow_rows(spark, personal.BATCH_ROWS):
        found = written(personal.personal_spans(docs, model).select("doc_id", "personal_spans"), "personal")
    own = F.filter("personal_spans", lambda s: s["base"])
    n = lambda kind: F.size(F.filter(own, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[n(k).alias(f"n_{k}") for k in personal.KINDS],
        F.sha2(secrets.join_spans(own), 256).alias("base_sha256"),
        secrets.join_spans(F.col("personal_spans")).alias("spans"),
    )


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_html_extraction, op3_url_filter, op4_toxicity, op5_decontamination, op6_minhash_near_dedup, op7_suffix_dedup, op8_quality, op9_mix_sources, op10_quality_rules, op11_ranked_search, op12_pii, op13_embedding_whitening)}

OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, 's' || source AS src0, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), rows_ AS (
  SELECT doc_id, coalesce(src0, 't') AS src, size, CAST(floor(log2(size + 1.0) * 4) AS INT) AS cls,
    CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS hash
  FROM sized
), per AS (
  SELECT src, CAST(sum(size) AS DOUBLE) AS s, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY src) - 1) % 3 + 1 AS INT)]::DOUBLE AS w
  FROM rows_ GROUP BY src
), levels AS (
  SELECT src, s, w, 2.0 * s / w AS ratio,
    (1.5 * sum(s) OVER () - coalesce(sum(2.0 * s) OVER before_, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before_, 0)) AS level
  FROM per WINDOW before_ AS (ORDER BY 2.0 * s / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), fixed AS (
  SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, src LIMIT 1
), targets AS (
  SELECT src, s, least(2.0 * s, coalesce(w * (SELECT level FROM fixed), 2.0 * s)) AS target FROM levels
), placed AS (
  SELECT doc_id, src, size, row_number() OVER (PARTITION BY src ORDER BY cls, hash, size, doc_id) AS p FROM rows_
), rated AS (
  SELECT p.*, t.s, t.target, CASE WHEN t.s > 0 THEN t.target / t.s ELSE 0.0 END AS rate,
    CAST(('0x' || substr(md5('7:' || p.src), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM placed p JOIN targets t USING (src)
), done AS (
  SELECT *, CAST(floor(p * rate + u) - floor((p - 1) * rate + u) AS BIGINT) AS copies FROM rated
)
SELECT doc_id, size, CAST(s AS BIGINT) AS source_size, target, copies * size AS taken, copies FROM done
"""



def _secret_sql() -> str:
    """Each rule's matches, placed by summing the lengths of the pieces between them."""
    sets = {c: f"[{c.upper()}{c}]" for c in "abcdefghijklmnopqrstuvwxyz"}
    parts = []
    for rank, r in enumerate(secrets.RULES):
        pattern = r.pattern
        if pattern.startswith("(?i:"):  # letters in either case, ASCII alone
            end = pattern.index(")") + 2
            pattern = "".join(sets.get(c, c) for c in pattern[4:end - 1]) + pattern[end:]
        lit = pattern.replace("'", "''")
        parts.append(f"""
  SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, list_zip(
      string_split_regex(text, '{lit}')[:len(regexp_extract_all(text, '{lit}'))],
      regexp_extract_all(text, '{lit}'), regexp_extract_all(text, '{lit}', {r.group})) AS m, {r.min_length} AS least
  FROM docs""")
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), found AS ({' UNION ALL '.join(parts)}
), each_ AS (
  SELECT doc_id, rank, kind, least, m, unnest(generate_series(1, len(m))) AS i FROM found WHERE len(m) > 0
), placed AS (
  SELECT doc_id, rank, kind, least, m[i][3] AS shown,
    list_sum(list_transform(m[:i], lambda x: length(x[1]) + length(x[2])))::BIGINT AS stop, length(m[i][2]) AS n
  FROM each_
), spans AS (
  SELECT doc_id, rank, kind, stop - n AS start, kind || ':' || (stop - n) || ':' || stop AS span FROM placed WHERE length(shown) >= least
), per AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(span, ',' ORDER BY start, rank) FILTER (kind IN ('assign', 'access', 'hex')) AS base,
    string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN per USING (doc_id)
"""


#: Lower-cased words: ASCII digits and letters, and everything beyond ASCII.
FOLDED_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = f"""
WITH items AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {FOLDED_WORDS} AS w FROM benchmark) WHERE len(w) > 0
), wins AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS i FROM items)
), docs AS (SELECT doc_id, {FOLDED_WORDS} AS w FROM documents
), dwins AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM docs, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)
), met AS (SELECT doc_id, i, n, item_id FROM dwins JOIN wins USING (n, g)
), hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM met) GROUP BY doc_id
), named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM met GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
OP7_SQL = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), wins AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT *, unnest(generate_series(0, length(h) // 2 - 50)) AS i FROM docs WHERE length(h) >= 100)
), firsts AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM wins
), starts AS (SELECT doc_id, i, i + 50 AS e FROM firsts WHERE first < doc_id
), runs AS (SELECT doc_id, min(i) AS s, max(e) AS e FROM (
  SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN i <= lag(e) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS opens FROM starts)) GROUP BY doc_id, run
), gaps AS (SELECT doc_id, s, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before, e FROM runs
), kept AS (
  SELECT r.doc_id, count(*) AS n_spans, sum(r.e - r.s)::BIGINT AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (r.s - before)), '' ORDER BY r.s) || substr(any_value(h), 2 * max(r.e) + 1) AS rest
  FROM gaps r JOIN docs USING (doc_id) GROUP BY r.doc_id
)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""
OP6_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, w FROM (SELECT doc_id, {FOLDED_WORDS} AS w FROM documents) WHERE len(w) > 0
), shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + least(5, len(w)) - 1], ' ')) AS g FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM words)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE s.n >= 0.8 * (x.n + y.n - s.n)
), both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, root) AS (SELECT doc_id, doc_id FROM words UNION SELECT l.b, r.root FROM reach r JOIN both_ l ON l.a = r.doc_id AND r.root < l.b
)
SELECT d.doc_id, coalesce(r.class_id, d.doc_id) AS class_id FROM documents d LEFT JOIN (SELECT doc_id, min(root) AS class_id FROM reach GROUP BY doc_id) r USING (doc_id)
"""
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, w FROM (SELECT doc_id, {FOLDED_WORDS} AS w FROM documents) WHERE len(w) > 0
), i AS (SELECT row_number() OVER () AS i, item_id, w FROM (SELECT item_id, {FOLDED_WORDS} AS w FROM benchmark) WHERE len(w) > 0
), q AS (SELECT i, item_id, t, count(*) AS q FROM (SELECT i, item_id, unnest(w) AS t FROM i) GROUP BY ALL
), p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL
), a AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d
), w AS (SELECT t, floor(1000 * ln((2.0 * any_value(a.n) + 2)::DOUBLE / (2.0 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, a WHERE t IN (SELECT t FROM q) GROUP BY t
), s AS (SELECT i, item_id, r, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * p.n * a.n) // a.l))))::BIGINT AS score FROM q JOIN w USING (t) JOIN p USING (t), a GROUP BY ALL
), o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""

SQL = {"op1_secret_scan": _secret_sql(), "op5_decontamination": OP5_SQL, "op6_minhash_near_dedup": OP6_SQL, "op7_suffix_dedup": OP7_SQL, "op9_mix_sources": OP9_SQL, "op11_ranked_search": OP11_SQL}
