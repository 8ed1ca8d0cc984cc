"""Mail as a data source: ``spark.read.format("mailbox").load(path)`` over mbox and .eml files.

An mbox is cut into ranges of bytes, each read by a task of its own: the task looks for the first line that begins
with 'From ' in its range, and reads on beyond the range's end until its last message is whole. So no task reads a
large file whole, and what is in memory is one message. Small files are read many to a task. Only the columns of the
schema are made: without plain and html, bodies aren't decoded, and with ``option("target", …)`` mails of other
senders aren't either.
"""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .exports import _headers, _mail_row
from .stores import files_below, store, uri

FORMAT = "mailbox"
SCHEMA = "file string, place bigint, sender string, subject string, date string, plain string, html string"
#: Bytes of a range, and of a read.
RANGE_BYTES, CHUNK = 64_000_000, 1_000_000
_MARK = b"\nFrom "


@dataclass
class Ranges(InputPartition):
    """(path, start, end, whole) of stretches of files; whole: the file is one mail."""

    stretches: list[tuple[str, int, int, bool]]


def ranges_of(files: list[tuple[str, int]], most: int) -> list[Ranges]:
    """Stretches of at most ``most`` bytes, small ones together. A mail of its own file isn't cut."""
    out, held, size = [], [], 0
    for path, n in files:
        whole = path.lower().endswith(".eml")
        for start in range(0, n, n if whole else most):
            end = n if whole else min(start + most, n)
            if held and size + end - start > most:
                out.append(Ranges(held))
                held, size = [], 0
            held.append((path, start, end, whole))
            size += end - start
    return out + ([Ranges(held)] if held else [])


def messages_in(stream, start: int, end: int, chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(place, raw) of the messages whose 'From ' line begins at a byte in [start, end); raw is without that line."""
    buffer = bytearray(b"" if start else b"\n")  # as if a line had ended before the file
    stream.seek(max(start - 1, 0))
    base, begin, scan = start - 1, None, 0  # the file's place of buffer[0]; where the open message begins; what is searched

    def raw(message: bytearray) -> bytes:
        return bytes(message).partition(b"\n")[2]

    while True:
        data = stream.read(chunk)
        buffer += data
        while (at := buffer.find(_MARK, scan)) >= 0:
            if begin is not None:
                yield base + begin, raw(buffer[begin:at + 1])
            if base + at + 1 >= end:
                return
            begin, scan = at + 1, at + len(_MARK)
        scan = max(scan, len(buffer) - len(_MARK) + 1)
        gone = scan if begin is None else begin
        del buffer[:gone]
        base, scan, begin = base + gone, scan - gone, None if begin is None else 0
        if begin is None and base + 1 >= end:
            return
        if not data:
            break
    if begin is not None:
        yield base + begin, raw(buffer[begin:])


class Mailbox(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> MailboxReader:
        known = [x.split()[0] for x in SCHEMA.split(", ")]
        other = [c for c in schema.fieldNames() if c not in known]
        if other:
            raise ValueError(f"mails have no {', '.join(other)}; they have {', '.join(known)}")
        return MailboxReader(uri(self.options["path"]), schema.fieldNames(), self.options.get("target", ""), int(self.options.get("rangeBytes", RANGE_BYTES)))


class MailboxReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], target: str, most: int):
        self.path, self.columns, self.target, self.most = path, columns, target.lower(), max(most, 1)

    def partitions(self) -> list[Ranges]:
        return ranges_of(files_below(self.path), self.most) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[tuple]:
        system, _ = store(self.path)
        bodies = {"plain", "html"} & set(self.columns)
        for path, start, end, whole in partition.stretches:
            with system.open_input_file(path) as stream:
                mails = iter([(0, stream.read())]) if whole else messages_in(stream, start, end)
                for place, raw in mails:
                    head = _headers(email.message_from_bytes(raw.partition(b"\n\n")[0], policy=email.policy.compat32) if b"\r\n\r\n" not in raw[:65_536] else email.message_from_bytes(raw, policy=email.policy.compat32))
                    if self.target in head["sender"].lower():
                        row = {"file": path, "place": place} | (_mail_row(raw) if bodies else head)
                        yield tuple(row[c] for c in self.columns)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Mailbox)
