"""Predicates, tiers, caps, joins and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import strip_ws
from ..operators import classify, report, select
from ..sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def any_of(words) -> str:
    return "|".join(w.replace("[", "\\[").replace("]", "\\]") for w in words)


CHAT = """(SELECT *, conv_id * 10000000 + turn * 10000 + part AS seq FROM (SELECT conv_id, turn, role, 0 AS part, text AS content FROM conversations WHERE turn % 3 <> 0
  UNION ALL SELECT conv_id, turn, role, part, piece || CASE WHEN conv_id % 2 = 0 THEN ' 建议' ELSE '' END FROM (
    SELECT conv_id, turn, role, unnest(string_split(text, '. ')) AS piece, unnest(generate_series(0, len(string_split(text, '. ')) - 1)) AS part FROM conversations WHERE turn % 3 = 0)))"""


def messages(conversations: DataFrame) -> DataFrame:
    """conversations as messages (part, content, seq): every third turn is sent sentence by sentence, and half of these ask for a decision."""
    pieces = F.when(F.col("turn") % 3 == 0, F.split("text", r"\. ")).otherwise(F.array("text"))
    rows = conversations.select("conv_id", "turn", "role", F.posexplode(pieces).alias("part", "content"))
    asks = (F.col("turn") % 3 == 0) & (F.col("conv_id") % 2 == 0)
    rows = rows.withColumn("content", F.when(asks, F.concat("content", F.lit(" 建议"))).otherwise(F.col("content")))
    return rows.withColumn("seq", F.col("conv_id") * 10_000_000 + F.col("turn") * 10_000 + F.col("part"))


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(table(spark, sf_dir, "conversations"))


@query(f"""SELECT role, CASE WHEN length(content) > 50 THEN 'long' WHEN regexp_matches(content, '{any_of(classify.CHAT_DECISIONS)}') THEN 'decision' ELSE 'daily' END AS tier,
  count(*) AS n FROM {CHAT} GROUP BY ALL""")
def message_tiers(spark, sf_dir):
    return chat(spark, sf_dir).groupBy("role", classify.message_tier(F.col("content")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT role, CASE WHEN length(body) > 200 THEN 'long' WHEN regexp_matches(lower(body), '{any_of(classify.MAIL_DECISIONS)}') THEN 'decision' ELSE 'daily' END AS tier,
  count(*) AS n, sum(length(body))::BIGINT AS chars FROM (SELECT role, content || CASE WHEN conv_id % 3 = 0 THEN ' LGTM' ELSE '' END AS body FROM {CHAT}) GROUP BY ALL""")
def mail_tiers(spark, sf_dir):
    body = F.concat("content", F.when(F.col("conv_id") % 3 == 0, " LGTM").otherwise(""))
    mails = chat(spark, sf_dir).select("role", body.alias("body"))
    return mails.groupBy("role", classify.mail_tier(F.col("body")).alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("body")).alias("chars"))


@query("SELECT conv_id, turn, role || '-' || (conv_id % 7) AS sender FROM conversations WHERE contains(role || '-' || (conv_id % 7), 'user-3')")
def target_filter(spark, sf_dir):
    sender = F.concat("role", F.lit("-"), (F.col("conv_id") % 7).cast("string"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", sender.alias("sender"))
    return rows.where(select.from_target(F.col("sender"), "user-3"))


@query("SELECT conv_id, turn, 'Mx. ' || upper(role) || ' <' || role || '@example.com>' AS sender FROM conversations WHERE contains(lower('Mx. ' || upper(role) || ' <' || role || '@example.com>'), 'user')")
def target_filter_ci(spark, sf_dir):
    sender = F.concat(F.lit("Mx. "), F.upper("role"), F.lit(" <"), F.col("role"), F.lit("@example.com>"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", sender.alias("sender"))
    return rows.where(select.from_target(F.col("sender"), "User", ignore_case=True))


NOISY = "CASE conv_id % 6 WHEN 0 THEN '[图片]' WHEN 1 THEN ' [语音]' || chr(9) WHEN 2 THEN ':smile_cat: ' WHEN 3 THEN '<@U1> :ok: k' WHEN 4 THEN '' ELSE text END"


@query(rf"""SELECT conv_id, turn, regexp_replace(content, '^\s+|\s+$', '', 'g') AS content FROM (SELECT conv_id, turn, role, unnest([text, {NOISY}]) AS content FROM conversations)
  WHERE regexp_replace(content, '^\s+|\s+$', '', 'g') NOT IN ('', '[图片]', '[文件]', '[撤回了一条消息]', '[语音]') AND role <> 'system'
  AND length(trim(regexp_replace(trim(regexp_replace(content, '<[^>]+>', '', 'g')), ':[a-z_]+:', '', 'g'))) >= 2""")
def noise_filter(spark, sf_dir):
    """Every message, and then with placeholders and noise in the place of most."""
    content = F.expr(NOISY.replace("chr(9)", "'\\t'"))
    rows = table(spark, sf_dir, "conversations").withColumns({"content": F.explode(F.array("text", content)), "subtype": F.when(F.col("role") == "system", "channel_join")})
    kept = rows.where(F.col("subtype").isNull() & ~classify.is_placeholder(F.col("content")) & ~classify.is_noise(F.col("content")))
    return kept.select("conv_id", "turn", strip_ws(F.col("content")).alias("content"))


ROUTED = "CASE page_id % 7 WHEN 0 THEN 'https://x.example.com/wiki/Ab' || page_id WHEN 1 THEN 'https://x.example.com/docx/Cd' || page_id || '?a=1' WHEN 2 THEN 'https://x.example.com/docs/Ef' || page_id WHEN 3 THEN 'https://x.example.com/sheets/Gh' || page_id WHEN 4 THEN 'https://x.example.com/base/Ij' || page_id WHEN 5 THEN 'https://x.example.com/spreadsheets/Kl' ELSE url END"


@query(f"""SELECT page_id, CASE WHEN contains(u, '/wiki/') THEN 'wiki' WHEN contains(u, '/docx/') OR contains(u, '/docs/') THEN 'doc' WHEN contains(u, '/sheets/') OR contains(u, '/spreadsheets/') THEN 'sheet' WHEN contains(u, '/base/') THEN 'base' ELSE 'unknown' END AS page_type,
  nullif(regexp_extract(u, '/(wiki|docx|docs|sheets|base)/([A-Za-z0-9]+)', 2), '') AS token,
  CASE regexp_extract(u, '/(wiki|docx|docs|sheets|base)/([A-Za-z0-9]+)', 1) WHEN 'wiki' THEN 'wiki' WHEN 'docx' THEN 'docx' WHEN 'docs' THEN 'doc' WHEN 'sheets' THEN 'sheet' WHEN 'base' THEN 'base' END AS token_type
  FROM (SELECT page_id, unnest([url, {ROUTED}]) AS u FROM pages)""")
def url_route(spark, sf_dir):
    """Every page's own address, and then one of each kind of document."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array("url", F.expr(ROUTED))).alias("u"))
    token, kind = urls.doc_token(F.col("u"))
    return rows.select("page_id", urls.page_type(F.col("u")).alias("page_type"), token.alias("token"), kind.alias("token_type"))


KEYS = "CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'u' || c_custkey || '@example.com' WHEN 2 THEN '+86-138' || c_custkey ELSE c_custkey || '' END"


@query(f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN contains(k, '@') THEN 'mail' WHEN regexp_matches(regexp_replace(k, '[+-]', '', 'g'), '^[0-9]+$') THEN 'phone' ELSE 'name' END AS kind FROM (SELECT {KEYS} AS k FROM customer)) GROUP BY kind")
def key_sniff(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(F.expr(KEYS).alias("k"))
    return keys.groupBy(classify.key_kind(F.col("k")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


GROUNDED = "CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'https://a.example.com/' WHEN 2 THEN 'https://a.example.com/topic/' WHEN 3 THEN 'http://a.example.com/short' WHEN 4 THEN 'http://a.example.com/read-it?BVID=' || page_id ELSE 'ftp://a.example.com/one/two' END"


@query(rf"""SELECT page_id, u AS url, regexp_matches(u, '^https?://[^/?#]+') AND (CASE WHEN p = '' THEN '/' ELSE p END) NOT IN {urls.GENERIC_PATHS}
  AND (len(segs) >= 2 OR length(coalesce(segs[1], '')) >= 8 OR regexp_matches(lower(regexp_extract(u, '\?([^#]*)', 1)), 'id=|vid=|aid=|bvid=|p=|article')) AS grounded
  FROM (SELECT *, list_filter(string_split(p, '/'), lambda s: s <> '') AS segs FROM (SELECT page_id, u, regexp_replace(regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS p FROM (SELECT page_id, unnest([url, {GROUNDED}]) AS u FROM pages)))""")
def url_grounding(spark, sf_dir):
    """Every page's own address, and then one of each kind that is or isn't a source."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array("url", F.expr(GROUNDED))).alias("url"))
    return rows.withColumn("grounded", urls.is_concrete_source(F.col("url")))


MARKED = "CASE doc_id % 4 WHEN 0 THEN text || '\n```' WHEN 1 THEN text || '\n  > quoted' WHEN 2 THEN 'at 00:12:13 ' || text ELSE text END"


@query(rf"SELECT doc_id, NOT contains(t, '```') AND NOT regexp_matches(t, '(?m)^\s*>') AND NOT regexp_matches(t, '\b\d{{2}}:\d{{2}}:\d{{2}}(?:[.,]\d{{1,3}})?\b') AS safe FROM (SELECT doc_id, {MARKED} AS t FROM documents)".replace("\n", "' || chr(10) || '"))
def copyright_safe(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(MARKED.replace("\n", "\\n")).alias("t"))
    return rows.select("doc_id", classify.copyright_safe(F.col("t")).alias("safe"))


NAMES = ("ex", " Self", "ICON", "nuwa ", "celebrity", "Relationship", "robot", "", "fictional-character")


@query(f"""SELECT name, family, count(*) AS n FROM (SELECT name, CASE WHEN k IN ('ex', 'self', 'yourself', 'relationship') THEN 'relationship' WHEN k IN ('icon', 'character', 'fictional-character', 'nuwa', 'celebrity') THEN 'celebrity' ELSE 'colleague' END AS family
  FROM (SELECT name, lower(trim(name)) AS k FROM (SELECT {list(NAMES)}[(c_custkey % 9 + 1)::INT] AS name FROM customer))) GROUP BY ALL""")
def alias_normalize(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("c_custkey") % 9 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select(name.alias("name"))
    return rows.groupBy("name", classify.family(F.col("name")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


# Order, limits and joins ---------------------------------------------------------------------------


@query("""SELECT channel, conv_id, turn FROM (SELECT 'ch' || (conv_id % 3) AS channel, conv_id, turn, row_number() OVER (PARTITION BY conv_id % 3 ORDER BY conv_id DESC, turn DESC) AS n FROM conversations) WHERE n <= 100""")
def per_channel_limit(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.concat(F.lit("ch"), (F.col("conv_id") % 3).cast("string")).alias("channel"), "conv_id", "turn")
    return select.head_per_group(rows, ["channel"], [F.desc("conv_id"), F.desc("turn")], select.channel_cap(200, 3))


AT = "strftime(TIMESTAMP '2024-01-01' + to_minutes((conv_id * 7 + turn)::INT), '%Y-%m-%d %H:%M')"


def timed(rows: DataFrame) -> DataFrame:
    """rows with ``time``, a minute of its own kind for each turn."""
    return rows.withColumn("time", F.date_format(F.timestamp_seconds(F.lit(1704067200) + (F.col("conv_id") * 7 + F.col("turn")) * 60), "yyyy-MM-dd HH:mm"))


def _lines_sql(cte: str, key: str, head: list[str], sections: list[tuple]) -> str:
    """SQL of report_lines(). sections: (titles, where, line, at, cap, optional)."""
    n = ", ".join(f"count(*) FILTER (WHERE {s[1]}) AS n{k}" for k, s in enumerate(sections, 1))
    lit = lambda x: "'" + x.replace("'", "''") + "'"
    fixed = [(0, head, "true"), *[(k, [lit(x) for x in s[0]], f"n{k} > 0" if s[5] else "true") for k, s in enumerate(sections, 1)]]
    parts = [f"SELECT {key}, {k} AS section, NULL::VARCHAR AS moment, NULL::BIGINT AS seq, unnest(generate_series(0, {len(lines) - 1})) AS place, unnest([{', '.join(lines)}]) AS line FROM totals WHERE {cond}" for k, lines, cond in fixed if lines]
    for k, (_, where, line, at, cap, _) in enumerate(sections, 1):
        parts.append(f"SELECT {key}, {k}, moment, seq, 0, line FROM (SELECT {key}, {at} AS moment, seq, {line} AS line, row_number() OVER (PARTITION BY {key} ORDER BY {at}, seq) AS k FROM base WHERE {where}) WHERE k <= {cap or 10**12} AND line IS NOT NULL")
    return f"WITH base AS ({cte}), totals AS (SELECT {key}, count(*) AS total, {n} FROM base GROUP BY {key}) " + " UNION ALL ".join(parts)


_THREADS = f"SELECT role, seq, {AT} AS time, 'ch' || (conv_id % 3) AS channel, content, CASE WHEN turn = 0 AND part = 0 THEN 'thread' WHEN length(content) > 50 THEN 'long' ELSE 'short' END AS tier FROM {CHAT}"
_PLACED = "'[' || time || '][#' || channel || '] ' || content || chr(10)"


@query(_lines_sql(_THREADS, "role", ["'# Slack 消息记录（自动采集）'", "'目标：' || role", "'共 ' || total || ' 条消息'", "'  话题发起消息：' || n1 || ' 条'", "'  长消息（>50字）：' || n2 || ' 条'", "'  短消息：' || n3 || ' 条'"], [
    (("", "---", "", "## 话题发起消息（权重最高：观点/决策/技术分享）", ""), "tier = 'thread'", _PLACED, "''", None, False),
    (("---", "", "## 长消息（观点/方案/讨论类）", ""), "tier = 'long'", _PLACED, "''", None, False),
    (("---", "", "## 日常消息（风格参考）", ""), "tier = 'short'", "'[' || time || '] ' || content", "''", 300, False),
]))
def thread_tier_report(spark, sf_dir):
    """Each role's messages as a report of threads, whole texts."""
    tier = classify.thread_tier(F.col("content"), (F.col("turn") == 0) & (F.col("part") == 0))
    rows = timed(chat(spark, sf_dir)).withColumns({"tier": tier, "channel": F.concat(F.lit("ch"), (F.col("conv_id") % 3).cast("string"))})
    return report.thread_report(rows, "role")


_PERSON = f"SELECT 'p' || (conv_id % 5) AS name, seq, {AT} AS time, CASE WHEN conv_id % 4 = 0 THEN '私聊' ELSE 'ch' || (conv_id % 3) END AS chat, role = 'user' AS is_target, content FROM {CHAT}"


@query(_lines_sql(_PERSON, "name", ["'# 飞书消息记录（自动采集）'", "'目标：' || name", "'共 ' || total || ' 条消息（目标用户 ' || n4 || ' 条，对话方 ' || (total - n4) || ' 条）'"], [
    (("", "---", "", "## 长消息（观点/决策/技术类）", ""), "is_target AND length(content) > 50", "'[' || time || '][' || chat || '] ' || content || chr(10)", "''", None, False),
    (("---", "", "## 日常消息（风格参考）", ""), "is_target AND length(content) <= 50", "'[' || time || '] ' || content", "''", 300, False),
    (("", "---", "", "## 私聊对话上下文（含双方消息）", ""), "chat = '私聊'", "'[' || time || '] ' || CASE WHEN is_target THEN '[' || name || ']' ELSE '[对方]' END || ' ' || content", "time", 500, True),
    ((), "is_target", "NULL::VARCHAR", "''", None, False),
]))
def dm_context(spark, sf_dir):
    """Each person's report: long messages, short ones, and direct talk of both sides in order of time."""
    where = F.when(F.col("conv_id") % 4 == 0, "私聊").otherwise(F.concat(F.lit("ch"), (F.col("conv_id") % 3).cast("string")))
    rows = timed(chat(spark, sf_dir)).withColumns({"name": F.concat(F.lit("p"), (F.col("conv_id") % 5).cast("string")), "chat": where, "is_target": F.col("role") == "user"})
    return report.person_report(rows, "name")


@query("""SELECT o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 > 0 ORDER BY o_orderkey LIMIT 500) WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 7 OR l_partkey = 7)""")
def shared_channels_semi(spark, sf_dir):
    """Of the first 500 joined channels those with the user: the cap comes first."""
    channels = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 3 > 0).alias("is_member"))
    members = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_partkey")
    return select.shared_channels(channels, members, "7", "o_orderkey", ("o_orderkey",), 500, ("l_suppkey", "l_partkey")).select("o_orderkey")


@query("SELECT o_orderkey, o_custkey, coalesce(c_name, 'customer ' || o_custkey) AS name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey")
def lookup_fallback(spark, sf_dir):
    hits = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.concat(F.lit("customer "), F.col("o_custkey").cast("string")).alias("name"))
    details = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return select.with_detail(hits, details, "o_custkey", {"name": "c_name"})


LINK = "'https://x.example.com/' || CASE doc_id % 4 WHEN 0 THEN 'wiki/W' || doc_id WHEN 1 THEN 'docx/D' || doc_id WHEN 2 THEN 'docs/D' || doc_id || '?from=a' ELSE 'mail/D' || doc_id END"
_TRIMMED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@query(rf"""SELECT doc_id, creator, md5(block) AS block_md5, length(block) AS n FROM (SELECT *, '---' || chr(10) || '## 《' || title || '》' || chr(10) || '链接：' || url || chr(10) || '创建人：' || creator || chr(10) || chr(10) || body || chr(10) AS block
  FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS creator, CASE WHEN doc_id % 10 = 0 THEN '无标题' ELSE 'Doc ' || doc_id END AS title, {LINK} AS url, {_TRIMMED} AS body FROM documents WHERE text IS NOT NULL AND NOT (doc_id % 4 = 0 AND doc_id % 8 > 0)))
  WHERE NOT contains(url, '/mail/') AND length(body) >= 20 AND (creator = '' OR creator = 'src7')""")
def doc_filter(spark, sf_dir):
    """Documents of one creator, found by link: pages of a wiki lead to their object by way of a node, and half of the nodes are gone."""
    docs = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    links = docs.select("doc_id", F.when(k % 3 == 0, "").otherwise(F.col("source")).alias("creator"), F.when(k % 10 > 0, F.concat(F.lit("Doc "), k.cast("string"))).alias("title"), F.expr(LINK).alias("url"))
    nodes = docs.where(k % 8 == 0).select(F.concat(F.lit("W"), k.cast("string")).alias("token"), F.concat(F.lit("D"), k.cast("string")).alias("obj_token"))
    objects = docs.select(F.concat(F.lit("D"), k.cast("string")).alias("token"), F.col("text").alias("content"))
    found = report.doc_blocks(report.resolved_docs(links.where((F.col("creator") == "") | (F.col("creator") == "src7")), nodes, objects))
    return found.select("doc_id", "creator", F.md5("block").alias("block_md5"), F.length("block").alias("n"))


@query("""SELECT c_custkey, score, place FROM (SELECT c_custkey, score, row_number() OVER (ORDER BY score DESC, c_custkey) AS place FROM (SELECT c_custkey, CASE WHEN lower(c_name) = q OR d = q OR u = q THEN 3 WHEN contains(lower(c_name), q) OR contains(d, q) OR contains(u, q) THEN 2
  WHEN list_bool_and(list_transform(list_filter(string_split(q, ''), lambda c: trim(c) <> ''), lambda c: contains(lower(c_name), c) OR contains(d, c))) THEN 1 ELSE 0 END AS score
  FROM (SELECT c_custkey, c_name, lower(c_mktsegment) AS d, 'u' || c_custkey AS u, 'u12' AS q FROM customer WHERE c_mktsegment <> 'MACHINERY' AND c_acctbal > 0)) WHERE score > 0) WHERE place <= 10""")
def user_match(spark, sf_dir):
    from pyspark.sql import Window

    people = table(spark, sf_dir, "customer").where("c_mktsegment <> 'MACHINERY' AND c_acctbal > 0")  # no bots, none deleted
    user = F.concat(F.lit("u"), F.col("c_custkey").cast("string"))
    scored = people.select("c_custkey", select.match_score("u12", F.col("c_name"), F.col("c_mktsegment"), user).alias("score")).where("score > 0")
    shown = scored.orderBy(F.desc("score"), "c_custkey").limit(10)  # what a chooser is shown
    return shown.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "c_custkey")))


@query("""WITH a AS (SELECT c_custkey AS k, 'contact' AS via, c_name AS name FROM customer WHERE c_acctbal > 2000), b AS (SELECT c_custkey AS k, 'tree' AS via, c_mktsegment AS name FROM customer WHERE c_mktsegment < 'F')
  SELECT k, via, name FROM a UNION ALL SELECT k, via, name FROM b WHERE k NOT IN (SELECT k FROM a)""")
def fallback_chain(spark, sf_dir):
    people = table(spark, sf_dir, "customer")
    part = lambda found, via, name: people.where(found).select(F.col("c_custkey").alias("k"), F.lit(via).alias("via"), F.col(name).alias("name"))
    return select.first_success([part("c_acctbal > 2000", "contact", "c_name"), part("c_mktsegment < 'F'", "tree", "c_mktsegment")], "k").select("k", "via", "name")


_EDGES = """SELECT 'root' AS parent, r_name AS child FROM region UNION ALL SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT s_name, c_name FROM customer JOIN supplier ON c_custkey = s_suppkey UNION ALL SELECT c_name, 'root' FROM customer WHERE c_custkey = 1"""


@query(f"""WITH RECURSIVE e AS (SELECT parent, child FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY child) AS k FROM ({_EDGES})) WHERE k <= 50),
  tree AS (SELECT 'root' AS node, 0 AS depth UNION SELECT e.child, t.depth + 1 FROM tree t JOIN e ON e.parent = t.node WHERE t.depth < 9) SELECT node, min(depth) AS depth FROM tree GROUP BY node""")
def tree_expand(spark, sf_dir):
    """The whole tree below its root, 50 children a node at most; one edge leads back to the root."""
    t = lambda n: table(spark, sf_dir, n)
    edges = t("region").select(F.lit("root").alias("parent"), F.col("r_name").alias("child"))
    edges = edges.unionByName(t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child")))
    edges = edges.unionByName(t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("parent"), F.col("s_name").alias("child")))
    edges = edges.unionByName(t("customer").join(t("supplier"), F.col("c_custkey") == F.col("s_suppkey")).select(F.col("s_name").alias("parent"), F.col("c_name").alias("child")))
    edges = edges.unionByName(t("customer").where("c_custkey = 1").select(F.col("c_name").alias("parent"), F.lit("root").alias("child")))
    return select.descend(edges, "root", most_children=50)


@query("""WITH u AS (SELECT c_custkey // 40 AS dept, c_custkey AS place, c_name AS name, c_mktsegment AS en_name, CASE WHEN c_custkey % 5 > 0 THEN 'u' || (c_custkey % 37) END AS user_id, CASE WHEN c_custkey % 10 > 0 THEN 'o' || (c_custkey % 11) END AS open_id FROM customer),
  m AS (SELECT * FROM u WHERE contains(name, '7') OR contains(en_name, '7')), last_ AS (SELECT max(dept) AS dept FROM (SELECT dept FROM m ORDER BY dept, place LIMIT 10)),
  k AS (SELECT *, coalesce(user_id, open_id) AS id FROM m WHERE dept <= (SELECT dept FROM last_) OR (SELECT count(*) FROM m) < 10)
  SELECT dept, place, name, user_id, open_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dept, place) AS n FROM k) WHERE n = 1 OR id IS NULL""")
def directory_match(spark, sf_dir):
    """People of a directory by name, department by department until ten are found, one row an id."""
    k = F.col("c_custkey")
    users = table(spark, sf_dir, "customer").select(F.floor(k / 40).alias("dept"), k.alias("place"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("en_name"), F.when(k % 5 > 0, F.concat(F.lit("u"), (k % 37).cast("string"))).alias("user_id"), F.when(k % 10 > 0, F.concat(F.lit("o"), (k % 11).cast("string"))).alias("open_id"))
    return select.directory_matches(users, "7", "dept", "place").drop("en_name")
