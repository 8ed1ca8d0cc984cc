"""Updates that keep arriving, budgets, mail in parts, folders of files, sketches and names beyond ASCII."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import metadata, notes, records, select
from ..sources import containers, exports, folders, mailboxes
from ..sources.scratch import scratch_folder
from ..sources.tables import even_tasks, spread, table
from ..streaming import remerge
from .wave2 import STRIP
from .wave4 import META_SQL, _MANIFESTS, rendered
from .wave4 import SQL as WAVE4_SQL

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# Updates that keep arriving -------------------------------------------------------------------------


def updates(spark, sf_dir):
    """Each order as an update to its customer's record: a section for its status, and every third a correction."""
    k = F.col("o_orderkey")
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    first = number == 1
    fix = F.struct(F.lit("s").alias("scene"), F.concat(F.lit("x"), k.cast("string")).alias("wrong"), F.lit("y").alias("correct"))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("record"), k.alias("seq"), F.concat(F.lit("## "), "o_orderstatus", F.lit("\n\n"), k.cast("string"), F.lit("  \n")).alias("work_patch"),
        F.when(first, "P").alias("persona_patch"), F.when(~first & (k % 3 == 0), F.array(fix)).alias("fixes"),
    )


def arriving(spark, sf_dir):
    """A stream over files of updates in three lots, of which the second arrives twice; and the folder it keeps its records in."""
    folder, rows = scratch_folder(spark, "updates"), updates(spark, sf_dir)
    rows.write.parquet(f"{folder}/all")
    rows = spark.read.parquet(f"{folder}/all")
    a, b = rows.approxQuantile("seq", [0.3, 0.7], 0.01)
    n = even_tasks(spark)  # files of a lot
    for lot in (F.col("seq") <= a, F.col("seq").between(a + 1, b), F.col("seq").between(a + 1, b), F.col("seq") > b):
        rows.where(lot).repartition(n, "record").write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", n).parquet(f"{folder}/in"), f"{folder}/state"


_UPDATES = "u AS (SELECT 'c' || o_custkey AS record, o_orderkey AS seq, o_orderstatus AS h, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders), s AS (SELECT record, h, min(seq) AS first, max(seq) AS last FROM u GROUP BY ALL)"


@query(f"""WITH {_UPDATES}, w AS (SELECT record, string_agg('## ' || h || chr(10) || chr(10) || last, chr(10) || chr(10) ORDER BY first) AS work, max(last) AS seq, max(last) = max(CASE WHEN first < last THEN last END) AS again FROM s GROUP BY record),
  p AS (SELECT record, count(*) AS n, list('- [s] should not x' || seq || '; should y' ORDER BY seq DESC) FILTER (n > 1 AND seq % 3 = 0) AS l FROM u GROUP BY record)
  SELECT record, 'v' || n AS version, seq, CASE WHEN n = 1 THEN work || '  ' || chr(10) WHEN again THEN work || chr(10) ELSE work END AS work,
    CASE WHEN l IS NULL THEN 'P' ELSE 'P' || chr(10) || chr(10) || '## Correction Log' || CASE WHEN len(l) > 1 THEN chr(10) || array_to_string(l[:-2], chr(10)) ELSE '' END || chr(10) || chr(10) || l[-1] || chr(10) END AS persona, coalesce(len(l), 0) AS corrections
  FROM w JOIN p USING (record)""")
def stream_remerge(spark, sf_dir):
    """Customers' records after all updates that a stream has brought, one lot of them twice."""
    stream, folder = arriving(spark, sf_dir)
    return remerge.current_records(spark, folder, remerge.remerge(stream, folder, compact=2, buckets=4), compact=2)


@query(f"""WITH {_UPDATES} SELECT record, 'v' || n AS version, seq FROM u QUALIFY lead(n) OVER (PARTITION BY record ORDER BY n) IS NOT NULL""")
def stream_archive(spark, sf_dir):
    """Every version that an update took the place of, each once."""
    stream, folder = arriving(spark, sf_dir)
    remerge.remerge(stream, folder, compact=2, buckets=4)
    return remerge.archived_versions(spark, folder).select("record", "version", "seq")


# Budgets --------------------------------------------------------------------------------------------


_BUDGET = "SELECT role AS target, 'ch' || (conv_id % 5) AS chat, conv_id % 3 = 0 AS direct, conv_id, turn FROM conversations"


@query(f"""WITH m AS ({_BUDGET}), c AS (SELECT DISTINCT target, chat FROM m WHERE chat <> 'ch4'), d AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY conv_id DESC, turn DESC) AS n FROM m WHERE direct),
  k AS (SELECT target, count(*) AS chats, coalesce((SELECT least(count(*), 150) FROM m x WHERE x.target = c.target AND direct), 0) AS used FROM c GROUP BY target),
  g AS (SELECT *, row_number() OVER (PARTITION BY target, chat ORDER BY conv_id DESC, turn DESC) AS n FROM m WHERE NOT direct AND chat <> 'ch4')
  SELECT target, chat, conv_id, turn FROM d WHERE n <= 150 UNION ALL SELECT target, chat, conv_id, turn FROM g JOIN k USING (target) WHERE used < 150 AND n <= greatest(20, (150 - used) // chats)""")
def direct_first_limit(spark, sf_dir):
    """Each role's direct talk first; then of each chat a share of what the limit has left."""
    c = F.col("conv_id")
    rows = table(spark, sf_dir, "conversations").select(F.col("role").alias("target"), F.concat(F.lit("ch"), (c % 5).cast("string")).alias("chat"), (c % 3 == 0).alias("direct"), "conv_id", "turn")
    chats = rows.where("chat <> 'ch4'").select("target", "chat")
    out = select.direct_then_chats(rows, chats, "target", "chat", F.col("direct"), [F.desc("conv_id"), F.desc("turn")], 150, least=20)
    return out.select("target", "chat", "conv_id", "turn")


# Mail -----------------------------------------------------------------------------------------------


def _part(kind: str, body, disposition: str = ""):
    return F.concat(F.lit(f"--b\nContent-Type: {kind}; charset=utf-8\n{disposition}Content-Transfer-Encoding: 8bit\n\n"), body, F.lit("\n"))


@query(f"""SELECT 'ann' || conv_id || '@example.com' AS sender, 'S' || conv_id AS subject, md5({STRIP.format("CASE WHEN k IN (0, 1) THEN 'plain ' || t WHEN k = 2 THEN t ELSE '<p>raw ' || t || '</p>' END")}) AS body_md5
  FROM (SELECT conv_id, conv_id % 5 AS k, string_agg(md5(text), ' ' ORDER BY turn) AS t FROM conversations GROUP BY conv_id) WHERE k < 4""")
def eml_read(spark, sf_dir):
    """Each conversation as an .eml file: HTML before plain text, an attachment, HTML alone, a lone part, and an empty plain text."""
    k = F.col("conv_id") % 5
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.md5("text").alias("t")))).alias("m"))  # a conversation's turns
    t = F.array_join(F.transform("m", lambda x: x["t"]), " ")
    html, plain = _part("text/html", F.concat(F.lit("<p>"), t, F.lit("</p>"))), _part("text/plain", F.concat(F.lit("plain "), t))
    note = _part("text/plain", F.lit("a note"), "Content-Disposition: attachment; filename=n.txt\n")
    several = F.concat(F.lit("Content-Type: multipart/mixed; boundary=b\n\n"), F.when(k == 0, F.concat(html, plain)).when(k == 1, F.concat(note, html, plain, _part("text/plain", F.lit("second")))).when(k == 2, F.concat(note, html)).otherwise(F.concat(_part("text/plain", F.lit("")), html)), F.lit("--b--\n"))
    lone = F.concat(F.lit("Content-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n<p>raw "), t, F.lit("</p>\n> quoted"))
    head = F.concat(F.lit("From: ann"), F.col("conv_id").cast("string"), F.lit("@example.com\nSubject: S"), F.col("conv_id").cast("string"), F.lit("\nMIME-Version: 1.0\n"))
    folder = scratch_folder(spark, "eml")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("none")), F.lit(".eml"))
    folders.write_shared(rows.select(name.alias("file"), F.concat(head, F.when(k == 3, lone).otherwise(several)).alias("content")), folder)
    mails = folders.read_folders(spark, folder, "file string, content binary")
    return exports.mail_texts(mails.select(F.col("content").alias("raw")), "ANN").select("sender", "subject", F.md5("body").alias("body_md5"))


_CONTAINER = "SELECT doc_id // 50 AS container, doc_id, 'From x' || chr(10) || 'From: d' || doc_id || '@example.com' || chr(10) || 'Subject: S' || doc_id || chr(10) || chr(10) || md5(text) AS mail FROM documents WHERE text IS NOT NULL"


@query(f"SELECT container, (row_number() OVER (PARTITION BY container ORDER BY doc_id) - 1)::INT AS place, 'd' || doc_id || '@example.com' AS sender, 'S' || doc_id AS subject, substr(mail, strpos(mail, chr(10) || chr(10)) + 2) AS plain FROM ({_CONTAINER})")
def mail_containers(spark, sf_dir):
    """Fifty documents to an mbox, whose lines go through a table function, container by container."""
    containers.register(spark)
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.floor(F.col("doc_id") / 50).alias("container"), "doc_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"), F.md5("text").alias("t"))
    who = F.col("doc_id").cast("string")
    line = F.element_at(F.array(F.lit("From x"), F.concat(F.lit("From: d"), who, F.lit("@example.com")), F.concat(F.lit("Subject: S"), who), F.lit(""), F.col("t")), F.col("i") + 1)
    lines = rows.select("container", (F.col("doc_id") * 10 + F.col("i")).alias("place"), line.alias("line"))
    return spark.sql("SELECT container, place, sender, subject, plain FROM mails_of_lines(TABLE({lines}) PARTITION BY container ORDER BY place)", lines=lines)


@query(f"SELECT 'd' || doc_id || '@example.com' AS sender, 'S' || doc_id AS subject, md5({STRIP.format('text')}) AS body_md5 FROM documents WHERE text IS NOT NULL AND NOT contains(chr(10) || text, chr(10) || 'From ')")
def mail_ranges(spark, sf_dir):
    """Documents as mails of mbox files, read back as a data source by ranges of bytes that begin and end within mails."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL AND NOT contains(concat('\n', text), '\nFrom ')")
    who = F.col("doc_id").cast("string")
    mail = F.concat(F.lit("From x\nFrom: d"), who, F.lit("@example.com\nSubject: S"), who, F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), "text", F.lit("\n> quoted\n____\nolder"))
    folder = scratch_folder(spark, "mailbox")
    docs.select(mail.alias("value")).write.text(folder)
    mailboxes.register(spark)
    read = spark.read.format(mailboxes.FORMAT).schema("sender string, subject string, plain string").option("rangeBytes", "300000").load(folder)
    return read.select("sender", "subject", F.md5(tx.strip_quoted_reply(F.col("plain"))).alias("body_md5"))


# Files ----------------------------------------------------------------------------------------------


def _suppliers(spark, sf_dir):
    slug = tx.slugify(F.concat(F.lit("s "), F.col("s_suppkey").cast("string")))
    rows = spread(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")).select(slug.alias("slug"), F.parse_json(F.concat(F.lit('{"character":"ex","created_at":"2024-01-01","name":"'), "s_name", F.lit('"}'))).alias("meta"))
    return metadata.enriched(rows, metadata.preset_table(spark), F.lit("now"))


@query("""SELECT 's_' || s_suppkey AS folder, file, CASE file WHEN 'work.md' THEN 'work of s_' || s_suppkey WHEN 'persona.md' THEN 'persona {of} s_' || s_suppkey END AS content FROM supplier, (SELECT unnest(['work.md', 'persona.md', 'SKILL.md', 'work_skill.md', 'persona_skill.md', 'manifest.json', 'meta.json']) AS file)""")
def record_folders(spark, sf_dir):
    """Each supplier's record written as a folder of seven files, and read back; two of the files are shown."""
    folder = scratch_folder(spark, "records")
    folders.write_records(rendered(_suppliers(spark, sf_dir)).withColumnRenamed("slug", "folder"), folder)
    return folders.read_folders(spark, folder).select("folder", "file", F.when(F.col("file").isin("work.md", "persona.md"), F.col("content")).alias("content"))


# Sketches, names, patches ---------------------------------------------------------------------------


@query(r"""WITH u AS (SELECT lang, source, unnest(regexp_extract_all(text, '[^\s]+')) AS w FROM documents) SELECT lang, count(DISTINCT w) AS exact, true AS near, true AS same FROM u GROUP BY lang""")
def distinct_sketches(spark, sf_dir):
    """Distinct words by language from sketches kept a source each: how near they are, and that their union is one pass's."""
    words = table(spark, sf_dir, "documents").select("lang", "source", F.explode(F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0))).alias("w"))
    kept = notes.distinct_sketches(words, ["lang", "source"], "w")
    folder = scratch_folder(spark, "sketches")
    kept.write.parquet(folder)
    union = notes.merged_sketches(spark.read.parquet(folder), ["lang"]).withColumnRenamed("distinct", "estimate")
    # Apart, as a distinct count beside a sketch would keep a sketch for each distinct word.
    exact = words.select("lang", "w").distinct().groupBy("lang").agg(F.count("w").alias("exact"))
    once = words.groupBy("lang").agg(F.hll_sketch_estimate(F.hll_sketch_agg("w", F.lit(notes.LG_K))).alias("once"))
    both = exact.join(once, exact["lang"].eqNullSafe(once["lang"])).join(union, exact["lang"].eqNullSafe(union["lang"])).select(exact["lang"], "once", "exact", "estimate")
    near = F.abs(F.col("estimate") - F.col("exact")) <= F.greatest(F.lit(2), 4 * notes.sketch_error() * F.col("exact"))
    # A union's last digits depend on how its sketches were held, so it may be off by the same error, not more.
    return both.select("lang", "exact", near.alias("near"), (F.abs(F.col("estimate") - F.col("once")) <= F.greatest(F.lit(2), 4 * notes.sketch_error() * F.col("exact"))).alias("same"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'zhang_san' WHEN 1 THEN 'zhangsan_feng_' || p_partkey WHEN 2 THEN 'strasse_' || p_partkey ELSE 'colleague' END AS slug FROM part""")
def slug_transliterated(spark, sf_dir):
    """Names beyond ASCII by a mapping table, the longest entry first, and names that it has nothing of."""
    n = F.expr("CASE p_partkey % 4 WHEN 0 THEN '张三' WHEN 1 THEN concat('张三丰 ', p_partkey) WHEN 2 THEN concat('Stra', 'ß', 'e ', p_partkey) ELSE '李' END")
    listed = spark.createDataFrame([("张", "zhang"), ("三", "san"), ("张三丰", "zhangsan_feng"), ("ß", "ss"), (None, "x"), ("", "y")], "source string, target string")
    words = tx.bounded_mapping(listed)
    inner = {k: v for k, v in words.items() if k == "ß"}
    return table(spark, sf_dir, "part").select("p_partkey", tx.slugify(tx.transliterated(n, inner), mapping={k: v for k, v in words.items() if k != "ß"}).alias("slug"))


def patch_log(spark, sf_dir):
    """Each customer's orders as a log of patches to one document: repeated headings, two sections, none, and empty ones."""
    k = F.col("o_orderkey").cast("string")
    head = F.element_at(F.array(*map(F.lit, ("A", "B", "C", "D"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    kind = F.floor(F.col("o_orderkey") / 4) % 4
    patch = F.when(kind == 0, F.concat(F.lit("lost\n\n## "), head, F.lit("\n\nnew "), k, F.lit("\n"))).when(kind == 1, F.concat(F.lit("tail "), k)).when(kind == 2, F.concat(F.lit("## "), head, F.lit("\nx "), k, F.lit("\n## Z\nz"))).otherwise("")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", patch.alias("patch"))


_DOCUMENT = "# Top\n\n## A\n\none\n\n## B  \ntwo\n\n## A\n\nagain"


@query(f"""WITH RECURSIVE p AS (SELECT o_custkey, o_orderkey, ['A', 'B', 'C', 'D'][(o_orderkey % 4 + 1)::INT] AS h, o_orderkey // 4 % 4 AS kind FROM orders),
  s AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, i) AS n, kind, h, text, last FROM (
    SELECT o_custkey, o_orderkey, 0 AS i, kind, '## ' || h AS h, '## ' || h || chr(10) || chr(10) || 'new ' || o_orderkey AS text, true AS last FROM p WHERE kind = 0 UNION ALL SELECT o_custkey, o_orderkey, 0, kind, '', 'tail ' || o_orderkey, true FROM p WHERE kind = 1
    UNION ALL SELECT o_custkey, o_orderkey, 0, kind, '## ' || h, '## ' || h || chr(10) || 'x ' || o_orderkey, false FROM p WHERE kind = 2 UNION ALL SELECT o_custkey, o_orderkey, 1, kind, '## Z', '## Z' || chr(10) || 'z', true FROM p WHERE kind = 2)),
  x AS (SELECT DISTINCT o_custkey, 0::BIGINT AS n, '{_DOCUMENT.replace(chr(10), "' || chr(10) || '")}' AS t, false AS any_ FROM orders UNION ALL
    SELECT o_custkey, n, CASE WHEN last AND any_ THEN {STRIP.format('t')} || chr(10) ELSE t END, any_ AND NOT last FROM (
      SELECT o_custkey, n, last, any_ OR found AS any_, CASE WHEN kind = 1 THEN t || chr(10) || chr(10) || text WHEN NOT found THEN regexp_replace(t, '\\s+$', '') || chr(10) || chr(10) || text
        ELSE regexp_replace(before, '\\s+$', '') || chr(10) || chr(10) || text || chr(10) || chr(10) || CASE WHEN strpos(after, chr(10) || '## ') > 0 THEN substr(after, strpos(after, chr(10) || '## ') + 1) ELSE '' END END AS t
      FROM (SELECT *, at_ > 0 AS found, substr(t, 1, at_ - 1) AS before, substr(t, at_ + length(h)) AS after FROM (
        SELECT x.o_custkey, s.n, x.t, x.any_, s.kind, s.h, s.text, s.last, CASE WHEN s.h = '' THEN 0 WHEN starts_with(x.t, s.h || chr(10)) THEN 1 ELSE greatest(strpos(x.t || chr(10), chr(10) || s.h || chr(10)), strpos(x.t, chr(10) || s.h || '  ' || chr(10))) + CASE WHEN strpos(x.t || chr(10), chr(10) || s.h || chr(10)) + strpos(x.t, chr(10) || s.h || '  ' || chr(10)) > 0 THEN 1 ELSE 0 END END AS at_
        FROM x JOIN s ON s.o_custkey = x.o_custkey AND s.n = x.n + 1))))
  SELECT o_custkey, arg_max(t, n) AS text FROM x GROUP BY o_custkey""")
def patch_fold(spark, sf_dir):
    """Each customer's document after all patches of its log, in order."""
    rows = patch_log(spark, sf_dir).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "patch"))).alias("p"))  # a record's patches
    return rows.select("o_custkey", records.merge_patches(F.lit(_DOCUMENT), F.transform("p", lambda x: x["patch"])).alias("text"))
