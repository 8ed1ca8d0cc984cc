"""Mail containers as table functions in SQL: one container to many messages.

``register(spark)`` makes two functions known. ``mails(container)``, in a lateral join, gives the messages of an mbox
text. ``mails_of_lines(TABLE lines PARTITION BY container ORDER BY place)`` takes a container as rows, a line each, and
gives a message as soon as the next one begins, so what is in memory is one message, however large the container.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .exports import _mail_row

SCHEMA = StructType([StructField("place", IntegerType()), *(StructField(c, StringType()) for c in ("sender", "subject", "date", "plain", "html"))])


class _Messages:
    """Collects lines into messages; a line that begins with 'From ' starts one and isn't part of it."""

    def __init__(self):
        self.lines, self.place = None, 0

    def take(self, line: str) -> Iterator[tuple]:
        if line.startswith("From "):
            yield from self.rest()
            self.lines = []
        elif self.lines is not None:
            self.lines.append(line)

    def rest(self) -> Iterator[tuple]:
        if self.lines is not None:
            row = _mail_row("\n".join(self.lines).encode("utf-8", "surrogatepass"))
            yield self.place, row["sender"], row["subject"], row["date"], row["plain"], row["html"]
            self.lines, self.place = None, self.place + 1


class Mails:
    """The messages of one mbox text; none of a null one."""

    def eval(self, container: str):
        found = _Messages()
        for line in (container or "").split("\n"):
            yield from found.take(line)
        yield from found.rest()


class MailsOfLines:
    """The messages of containers whose lines are rows with ``container`` and ``line``, partitioned and in order."""

    def __init__(self):
        self.found, self.container = _Messages(), None

    @staticmethod
    def analyze(lines) -> AnalyzeResult:
        own = next(f for f in lines.dataType.fields if f.name == "container")
        return AnalyzeResult(StructType([StructField("container", own.dataType), *SCHEMA.fields]))

    def eval(self, lines: Row):
        self.container = lines["container"]
        for row in self.found.take(lines["line"] or ""):
            yield self.container, *row

    def terminate(self):
        for row in self.found.rest():
            yield self.container, *row


def register(spark: SparkSession) -> None:
    spark.udtf.register("mails", udtf(Mails, returnType=SCHEMA))
    spark.udtf.register("mails_of_lines", udtf(MailsOfLines))
