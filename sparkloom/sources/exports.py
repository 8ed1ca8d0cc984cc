"""Readers of chat and mail exports, notes and subtitles.

Text and JSON are parsed with built-in functions. MIME needs a parser for each message, so mail files
are parsed message by message within Spark's tasks.
"""

from __future__ import annotations

import email
import email.policy
import re
from collections.abc import Iterator
from email.header import decode_header, make_header

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_ws
from ..operators.classify import EXPORT_PLACEHOLDERS, is_placeholder
from ..operators.nested import first_of, message_fields, text_of
from ..operators.select import from_target

#: A chat log's line, and the keys that exports use for each field.
CHAT_LINE = r"^(\d{4}[-/]\d{1,2}[-/]\d{1,2}[\s\d:]*)\s+(.+?)[:：]\s*(.+)$"
ROOT_KEYS = ("messages", "records", "data")
SENDER_KEYS = ("sender_name", "sender", "from", "user_name")
CONTENT_KEYS = ("content", "text", "message", "body")
TIME_KEYS = ("timestamp", "create_time", "time")


def parse_chat_line(lines: DataFrame, column: str, target: str) -> DataFrame:
    """lines with sender, content and time. A line of another form stays, as the target's, if it names the target."""
    line = F.col(column)
    part = lambda k: strip_ws(F.regexp_extract(line, CHAT_LINE, k))
    parsed = line.rlike(CHAT_LINE)
    out = lines.withColumns({
        "sender": F.when(parsed, part(2)).otherwise(F.lit(target)),
        "content": F.when(parsed, part(3)).otherwise(line),
        "time": F.when(parsed, part(1)).otherwise(F.lit("")),
    })
    return out.where(F.when(parsed, from_target(F.col("sender"), target)).otherwise(line.contains(target)))


def read_chat_log(spark: SparkSession, path: str, target: str = "") -> DataFrame:
    """(source, sender, content, time) of text logs with one message a line."""
    lines = spark.read.text(path).withColumn("source", F.input_file_name()).where(strip_ws(F.col("value")) != "")
    return parse_chat_line(lines.withColumn("value", strip_ws(F.col("value"))), "value", target).select("source", "sender", "content", "time")


def read_chat_json(spark: SparkSession, path: str, target: str = "", placeholders=EXPORT_PLACEHOLDERS) -> DataFrame:
    """(source, seq, sender, content, time) of JSON exports: a list, or an object with one under a known key.

    Of the keys for a field the first whose value is truthy counts; a file that isn't JSON has no rows.
    """
    return chat_messages(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), "value"), target, placeholders)


def chat_messages(files: DataFrame, target: str = "", placeholders=EXPORT_PLACEHOLDERS) -> DataFrame:
    """read_chat_json() of files that are rows already: (source, value)."""
    files = files.select("source", F.try_parse_json("value").alias("json"))
    root = F.when(F.schema_of_variant("json").startswith("ARRAY"), F.col("json")).otherwise(first_of(F.col("json"), ROOT_KEYS))
    rows = files.select("source", F.posexplode(F.try_variant_get(root, "$", "array<variant>")).alias("seq", "m"))
    fields = message_fields(F.col("m"), {"sender": SENDER_KEYS, "time": TIME_KEYS})
    content = strip_ws(text_of(first_of(F.col("m"), CONTENT_KEYS)))
    out = rows.select("source", "seq", fields["sender"].alias("sender"), content.alias("content"), fields["time"].alias("time"))
    return out.where(from_target(F.col("sender"), target) & ~is_placeholder(F.col("content"), placeholders))


def _decoded(value: str | None) -> str:
    try:
        return str(make_header(decode_header(value or "")))
    except (LookupError, UnicodeError, ValueError):
        return value or ""


def _payload(part) -> str:
    raw = part.get_payload(decode=True) or b""
    try:
        return raw.decode(part.get_content_charset() or "utf-8", "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


def _headers(message) -> dict:
    return {"sender": _decoded(message["From"]), "subject": _decoded(message["Subject"]), "date": message["Date"] or ""}


def _mail_row(raw: bytes) -> dict:
    """Headers and body: the first plain text of several parts, else their first HTML that shows anything; a lone part as it is.

    Attachments don't count. A first plain text that is empty makes the body empty.
    """
    message = email.message_from_bytes(raw, policy=email.policy.compat32)
    plain, html = None, ""
    if not message.is_multipart():
        plain = _payload(message)
    for part in message.walk() if plain is None else ():
        if "attachment" in str(part.get("Content-Disposition", "")):
            continue
        kind = part.get_content_type()
        if kind == "text/plain":
            plain = _payload(part)
            break
        if kind == "text/html" and not re.sub(r"<[^>]*>", "", html).strip():
            html = _payload(part)
    return _headers(message) | {"plain": plain, "html": html}


def mail_rows(raw: DataFrame, column: str = "raw") -> DataFrame:
    """(sender, subject, date, plain, html) of mails as bytes, parsed in batches; a null one gives no row."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([_mail_row(bytes(r)) for r in b[column]], columns=["sender", "subject", "date", "plain", "html"])

    return raw.select(column).where(F.col(column).isNotNull()).mapInPandas(parse, "sender string, subject string, date string, plain string, html string")


def read_mail(spark: SparkSession, path: str, target: str = "", mbox: bool = False) -> DataFrame:
    """(sender, subject, date, body) of .eml files, or of mbox files where lines 'From ' part the messages.

    An mbox is split by Spark's own text reader, so a large one is read by many tasks.
    """
    if mbox:
        whole = spark.read.option("lineSep", "\nFrom ").text(path).select(F.col("value").cast("binary").alias("raw"))
        whole = whole.select(F.expr("CASE WHEN instr(cast(raw AS string), '\\n') > 0 THEN cast(substr(cast(raw AS string), instr(cast(raw AS string), '\\n') + 1) AS binary) ELSE raw END").alias("raw"))
    else:
        whole = spark.read.format("binaryFile").load(path).select(F.col("content").alias("raw"))

    return mail_texts(whole, target)


def mail_texts(raw: DataFrame, target: str = "") -> DataFrame:
    """read_mail() of mails that are rows already: (raw), as bytes."""
    from ..functions.text import html_to_text, strip_quoted_reply

    mails = mail_rows(raw)
    body = F.coalesce("plain", html_to_text(F.col("html")))
    out = mails.select("sender", "subject", "date", strip_quoted_reply(body).alias("body"))
    return out.where(from_target(F.col("sender"), target, ignore_case=True) & (F.col("body") != ""))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of whole text files: notes, subtitles, drafts."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"[^/]+$", 0).alias("file"), F.col("value").alias("text"))
