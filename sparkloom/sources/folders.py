"""Records as folders of files: a data source that commits whole folders, or none, and reads them back.

``df.write.format("record_folders").option("path", …)`` takes (folder, file, content). Tasks write below a pending
folder of their own job; when all tasks are done the folders are put in place, and a job that fails leaves none. A
folder that exists is refused before anything is moved, or taken the place of with ``option("replace", "true")``.
Reading, the driver lists the folders alone; tasks list and read the files of many folders each, so there is no task
for every few small files. With a binary content files are given as they are.
Paths are URIs of any store that Arrow's file systems reach, so driver and executors need share nothing but the store.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType, StructType

from .stores import store as _store
from .stores import uri as _uri
from .tables import even_tasks

FORMAT = "record_folders"
SCHEMA = "folder string, file string, content string"
#: Tasks that folders are read by at least, folders of a task at most, bytes that a task hands on at once, and moves at a time.
TASKS, FOLDERS, BATCH_BYTES, MOVES = 96, 5_000, 4_000_000, 16


def _name(value: str | None, what: str) -> str:
    if not value or value in (".", "..") or "/" in value or "\0" in value:
        raise ValueError(f"{value!r} can't be the name of a {what}")
    return value


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    rows: int


class RecordFolders(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RecordFoldersReader:
        other = set(schema.fieldNames()) - {"folder", "file", "content"}
        if other:
            raise ValueError(f"folders have no {', '.join(sorted(other))}; they have folder, file, content")
        return RecordFoldersReader(_uri(self.options["path"]), schema)

    def writer(self, schema: StructType, overwrite: bool) -> RecordFoldersWriter:
        missing = {"folder", "file", "content"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
        replace = str(self.options.get("replace", "false")).lower() == "true"
        made = RecordFoldersWriter(_uri(self.options["path"]), replace or overwrite, uuid.uuid4().hex)
        made.begin()
        return made


class RecordFoldersWriter(DataSourceWriter):
    """A task's files go to <path>/_pending/<job>/<attempt>/<folder>/<file>; an attempt that is lost is never moved.

    The driver makes <job>. Once it is taken away, tasks that still run have no place to write to, so they leave nothing.
    """

    def __init__(self, path: str, replace: bool, job: str):
        self.path, self.replace, self.job = path, replace, job

    def _pending(self, root: str) -> str:
        return f"{root}/_pending/{self.job}"

    def begin(self) -> None:
        store, root = _store(self.path)
        store.create_dir(self._pending(root), recursive=True)

    def write(self, rows: Iterator[Row]) -> Written:
        store, root = _store(self.path)
        attempt, made, n = uuid.uuid4().hex, set(), 0
        store.create_dir(f"{self._pending(root)}/{attempt}", recursive=False)
        for row in rows:
            folder = f"{self._pending(root)}/{attempt}/{_name(row['folder'], 'folder')}"
            if folder not in made:
                store.create_dir(folder, recursive=False)
                made.add(folder)
            with store.open_output_stream(f"{folder}/{_name(row['file'], 'file')}") as out:
                out.write((row["content"] or "").encode("utf-8", "surrogatepass"))
            n += 1
        return Written(attempt, n)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, root = _store(self.path)
        folders = []
        for m in messages:
            if m is not None and m.rows:
                pending = f"{self._pending(root)}/{m.attempt}"
                folders += [(x.path, f"{root}/{x.base_name}") for x in store.get_file_info(fs.FileSelector(pending))]
        there = [x.path for x in store.get_file_info([to for _, to in folders]) if x.type != fs.FileType.NotFound]
        if there and not self.replace:
            self.abort(messages)
            raise FileExistsError(f"{len(there)} folders exist already, {there[0]} first")
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(store.delete_dir, there))
            list(pool.map(lambda x: store.move(*x), folders))
        self._clear(store, root, self._pending(root))

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, root = _store(self.path)
        pending = self._pending(root)
        if store.get_file_info(pending).type != fs.FileType.NotFound:
            store.move(pending, f"{pending}-gone")  # at once, so that no task adds to what is deleted
        self._clear(store, root, f"{pending}-gone")

    def _clear(self, store, root: str, folder: str) -> None:
        from pyarrow import fs

        if store.get_file_info(folder).type != fs.FileType.NotFound:
            store.delete_dir(folder)
        rest = store.get_file_info(fs.FileSelector(f"{root}/_pending", allow_not_found=True))
        if not rest and store.get_file_info(f"{root}/_pending").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/_pending")


@dataclass
class Chosen(InputPartition):
    folders: list[str]


class RecordFoldersReader(DataSourceReader):
    """All files of all folders but the pending one; a task's folders are listed and read in it, file by file."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.columns = path, {f.name: isinstance(f.dataType, BinaryType) for f in schema.fields}

    def partitions(self) -> list[Chosen]:
        from pyarrow import fs

        store, root = _store(self.path)
        found = sorted(x.path for x in store.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.Directory and x.base_name != "_pending")
        n = min(len(found), max(TASKS, -(-len(found) // FOLDERS)))
        return [Chosen(found[k::n]) for k in range(n)] or [Chosen([])]

    def read(self, partition: Chosen) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        store, _ = _store(self.path)
        kinds = {c: pa.binary() if raw else pa.string() for c, raw in self.columns.items()}

        def batch(rows: list[dict]):
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in kinds.items()], list(kinds))

        held, size = [], 0
        for folder in partition.folders:
            name = folder.rpartition("/")[2]
            for x in store.get_file_info(fs.FileSelector(folder)):
                if not x.is_file:
                    continue
                with store.open_input_file(x.path) as stream:
                    content = stream.read()
                size += len(content)
                held.append({"folder": name, "file": x.base_name, "content": content if self.columns.get("content") else content.decode("utf-8", "replace")})
                if size >= BATCH_BYTES or len(held) >= 10_000:
                    yield batch(held)
                    held, size = [], 0
        if held:
            yield batch(held)


def dealt(files: DataFrame) -> DataFrame:
    """(folder, file, content), a folder's rows in one task and one row a file; as many tasks as cores keep busy, however few the bytes."""
    whole = files.select("folder", "file", "content").repartition(even_tasks(files.sparkSession), "folder")
    return whole.groupBy("folder", "file").agg({"content": "max"}).withColumnRenamed("max(content)", "content")


def write_records(files: DataFrame, path: str, replace: bool = False) -> None:
    """Writes (folder, file, content) as one folder a record. Rows of a folder go to one task, so it is moved whole.

    Of rows that repeat a folder and file one is kept, the greatest content. A null content makes an empty file; names
    that are null, empty or lead elsewhere are an error, after which no folder of the job is left.
    """
    register(files.sparkSession)
    dealt(files).write.format(FORMAT).mode("append").option("path", path).option("replace", str(replace).lower()).save()


def write_shared(files: DataFrame, path: str) -> None:
    """Writes (file, content) as one file a row, in as many folders as there are tasks, by a hash of the name: a folder is moved, not each file."""
    n = even_tasks(files.sparkSession)
    write_records(files.withColumn("folder", F.pmod(F.xxhash64("file"), F.lit(n)).cast("string")), path)


def read_folders(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """(folder, file, content) of all files in the folders below the path."""
    register(spark)
    return spark.read.format(FORMAT).schema(schema).load(path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordFolders)
