"""Incremental queries, and exports written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import exports, folders
from ..sources.scratch import scratch_folder
from ..sources.tables import table
from ..streaming.incremental import run_batches, stream_table, tier_counts, windowed_counts
from .wave1 import CHAT, messages
from .wave1 import SQL as WAVE1_SQL
from .wave2 import STRIP

QUERIES, SQL = {}, {"stream_message_tiers": WAVE1_SQL["message_tiers"]}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query()
def stream_message_tiers(spark, sf_dir):
    """message_tiers over conversations that arrive as a stream of files."""
    return tier_counts(messages(stream_table(spark, sf_dir, "conversations")), scratch_folder(spark, "tiers"))


@query("""SELECT start, event_type, n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL) WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_windows(spark, sf_dir):
    """Events by hour and type, from a stream: the windows that the watermark has closed."""
    events = stream_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = windowed_counts(events, "ts", "event_type").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
    return spark.read.parquet(run_batches(counts, scratch_folder(spark, "windows"), lambda batch: batch)).select("start", "event_type", "n")


@query(f"""SELECT sender, content, time FROM (SELECT role || '-' || (conv_id % 7) AS sender, {STRIP.format('content')} AS content, CASE WHEN turn % 2 = 0 THEN 't' || turn ELSE '' END AS time FROM {CHAT}) WHERE contains(sender, 'user') AND content NOT IN ('', '[图片]', '[文件]', '[撤回了一条消息]', '[语音]')""")
def export_read(spark, sf_dir):
    """Each conversation written as a JSON export of its own, and read back for one kind of sender."""
    rows = messages(table(spark, sf_dir, "conversations")).withColumn("sender", F.concat("role", F.lit("-"), (F.col("conv_id") % 7).cast("string")))
    message = F.struct("seq", F.lit("").alias("sender_name"), F.when(F.col("turn") % 3 > 0, F.col("sender")).alias("sender"), F.col("sender").alias("user_name"),
                       F.when(F.col("turn") % 2 == 0, F.concat(F.lit("t"), F.col("turn").cast("string"))).alias("create_time"), F.when(F.col("part") == 0, F.col("content")).alias("content"), F.struct(F.col("content").alias("text")).alias("body"))
    each = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("m"))  # a conversation's messages
    listed = F.when(F.col("conv_id") % 2 == 0, F.to_json("m")).otherwise(F.to_json(F.struct(F.array().cast("array<string>").alias("messages"), F.col("m").alias("records"))))
    folder = scratch_folder(spark, "exports")
    folders.write_shared(each.select(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("none")), F.lit(".json")).alias("file"), listed.alias("content")), folder)
    return exports.chat_messages(folders.read_folders(spark, folder).select(F.col("file").alias("source"), F.col("content").alias("value")), "user").select("sender", "content", "time")


#: A line that begins like a mail is marked in an mbox, and then goes as a quoted one.
_UNESCAPED = r"regexp_replace(text, '\nFrom [^\n]*', '', 'g')"


@query(f"""SELECT 'Ünit ' || source || ' <' || source || '@example.com>' AS sender, 'Über ' || doc_id AS subject, CASE WHEN doc_id % 2 = 0 THEN 'd' || doc_id ELSE '' END AS date, md5({STRIP.format(_UNESCAPED)}) AS body_md5 FROM documents WHERE source IS NOT NULL AND text IS NOT NULL AND {STRIP.format('text')} <> '' AND contains(lower(source), '7')""")
def mbox_read(spark, sf_dir):
    """Documents as mails of mbox files, with encoded headers and a quoted reply, read back for some senders."""
    docs = table(spark, sf_dir, "documents").where("source IS NOT NULL AND text IS NOT NULL")
    word = lambda x: F.concat(F.lit("=?utf-8?b?"), F.base64(F.encode(x, "UTF-8")), F.lit("?="))
    head = F.concat(F.lit("From ann@example.com Mon\nFrom: "), word(F.concat(F.lit("Ünit "), "source")), F.lit(" <"), "source", F.lit("@example.com>\nSubject: "), word(F.concat(F.lit("Über "), F.col("doc_id").cast("string"))), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\nDate: d"), F.col("doc_id").cast("string"))).otherwise(""))
    body = F.concat(F.replace("text", F.lit("\nFrom "), F.lit("\n>From ")), F.lit("\n> quoted\n____\nolder"))
    sent = F.when(F.startswith("text", F.lit("From ")), F.concat(F.lit("base64\n\n"), F.base64(F.encode(body, "UTF-8")))).otherwise(F.concat(F.lit("8bit\n\n"), body))  # no mark before a first line 'From '
    mail = F.concat(head, F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: "), sent)
    folder = scratch_folder(spark, "mbox")
    docs.select(mail.alias("value")).write.text(folder)
    return exports.read_mail(spark, folder, "7", mbox=True).select("sender", "subject", "date", F.md5("body").alias("body_md5"))


@query(f"""SELECT sender, content, time FROM (SELECT role AS sender, {STRIP.format("replace(text, chr(10), ' ')")} AS content, '2024-01-0' || (1 + turn % 9) || ' 10:00' AS time FROM conversations) WHERE sender = 'user' AND content <> ''""")
def chat_log_read(spark, sf_dir):
    """Conversations as text logs of one message a line, read back for one sender."""
    rows = table(spark, sf_dir, "conversations")
    line = F.concat(F.lit("2024-01-0"), (1 + F.col("turn") % 9).cast("string"), F.lit(" 10:00 "), "role", F.when(F.col("turn") % 2 == 0, ": ").otherwise("："), F.replace("text", F.lit("\n"), F.lit(" ")))
    folder = scratch_folder(spark, "logs")
    rows.select(line.alias("value")).write.text(folder)
    return exports.read_chat_log(spark, folder, "user").select("sender", "content", "time")
