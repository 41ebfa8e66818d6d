"""A durable queue between jobs: files in a shared folder that writers append by commits and readers poll.

The data source ``quire_queue`` (option ``path``) is written by batches and streams and read by both. A commit is one small
manifest, put in place by a move, which lists files that tasks have written before; what no manifest lists is not there. A
commit has its writer's name and batch in its own name, so that a batch that runs again after a crash adds nothing. One
writer appends at a time.

A reading stream's offset counts commits and the files of the next one. A poll moves it on by at most ``maxFiles`` files (all,
if not set), and writes down how far it has let the stream go under the reader's name (option ``reader``), so that a stream that is
started again goes on from there. Files of a commit come in the order of the writing tasks.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "quire_queue"


class Folder:
    """The queue's files: data/*.parquet, commits/*.json, readers/*.json and the schema."""

    def __init__(self, path: str):
        self.path = path
        self.store, self.root = fs.FileSystem.from_uri(path)

    def put(self, name: str, data: bytes) -> None:
        """A small file that appears under its name whole."""
        full = f"{self.root}/{name}"
        self.store.create_dir(full.rsplit("/", 1)[0], recursive=True)
        with self.store.open_output_stream(trial := f"{self.root}/trial-{uuid.uuid4().hex}") as f:
            f.write(data)
        self.store.move(trial, full)

    def get(self, name: str) -> bytes | None:
        full = f"{self.root}/{name}"
        if self.store.get_file_info(full).type != fs.FileType.File:
            return None
        with self.store.open_input_file(full) as f:
            return f.readall()

    def commits(self) -> list[str]:
        """The manifests' names in order."""
        found = self.store.get_file_info(fs.FileSelector(f"{self.root}/commits", allow_not_found=True))
        return sorted(x.base_name for x in found)

    def files(self, commit: str) -> list[str]:
        return json.loads(self.get(f"commits/{commit}"))["files"]

    def commit(self, writer: str, batch: str, messages: list, schema: StructType) -> None:
        """Add the files of a writer's batch, unless it is there already."""
        known = self.commits()
        own = f"-{writer}-{batch}.json"
        if any(x.endswith(own) for x in known):
            return
        if self.get("schema.json") is None:
            later = re.sub(r'("(?:nullable|containsNull|valueContainsNull)": ?)false', r"\1true", schema.json())  # other commits may hold nulls
            self.put("schema.json", later.encode())
        files = [name for m in messages if m for name in m.files]
        self.put(f"commits/{len(known):012d}{own}", json.dumps({"files": files}).encode())


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


@dataclass
class Part(InputPartition):
    name: str


class Appending:
    """What batches and streams do alike: a task writes one file; a commit lists them."""

    def __init__(self, path: str, writer: str, schema: StructType):
        self.path, self.writer, self.schema = path, writer, schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder, name, out = Folder(self.path), f"data/{uuid.uuid4().hex}.parquet", None
        folder.store.create_dir(f"{folder.root}/data", recursive=True)
        for b in iterator:
            if b.num_rows:
                out = out or pq.ParquetWriter(f"{folder.root}/{name}", b.schema, filesystem=folder.store, compression="zstd")
                out.write_batch(b)
        if out is None:
            return Written([])
        out.close()
        return Written([name])

    def abort(self, messages, batchId: int | None = None) -> None:  # noqa: N803
        folder = Folder(self.path)
        for name in (n for m in messages if m for n in m.files):
            folder.store.delete_file(f"{folder.root}/{name}")


class BatchAppend(Appending, DataSourceArrowWriter):
    def commit(self, messages) -> None:
        Folder(self.path).commit(self.writer, uuid.uuid4().hex, messages, self.schema)


class StreamAppend(Appending, DataSourceStreamArrowWriter):
    def commit(self, messages, batchId: int) -> None:  # noqa: N803
        Folder(self.path).commit(self.writer, str(batchId), messages, self.schema)


class Reading:
    def __init__(self, path: str):
        self.path = path

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        folder = Folder(self.path)
        with folder.store.open_input_file(f"{folder.root}/{partition.name}") as f:
            yield from pq.ParquetFile(f).iter_batches()


class BatchRead(Reading, DataSourceReader):
    def partitions(self) -> list[Part]:
        folder = Folder(self.path)
        return [Part(name) for c in folder.commits() for name in folder.files(c)]


class StreamRead(Reading, DataSourceStreamReader):
    def __init__(self, path: str, reader: str, most: int | None):
        super().__init__(path)
        self.reader, self.most = f"readers/{reader}.json", most

    def initialOffset(self) -> dict:  # noqa: N802
        return {"commits": 0, "files": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        folder = Folder(self.path)
        at = json.loads(folder.get(self.reader) or json.dumps(self.initialOffset()))
        before = dict(at)
        left = self.most
        for commit in folder.commits()[at["commits"] :]:
            rest = len(folder.files(commit)) - at["files"]
            if left is not None and rest > left:
                at["files"] += left
                break
            at = {"commits": at["commits"] + 1, "files": 0}
            if left is not None:
                left -= rest
                if not left:
                    break
        if at != before:
            folder.put(self.reader, json.dumps(at).encode())
        return at

    def partitions(self, start: dict, end: dict) -> list[Part]:
        folder, out = Folder(self.path), []
        for k, commit in enumerate(folder.commits()[start["commits"] : end["commits"] + 1], start["commits"]):
            low = start["files"] if k == start["commits"] else 0
            high = end["files"] if k == end["commits"] else None
            out += [Part(name) for name in folder.files(commit)[low:high]]
        return out

    def commit(self, end: dict) -> None:
        """Nothing is deleted: another reader may come."""


class QueueTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        known = Folder(self.options["path"]).get("schema.json")
        if known is None:
            raise ValueError("the queue has no commit yet: give the schema")
        return StructType.fromJson(json.loads(known))

    def reader(self, schema: StructType) -> BatchRead:
        return BatchRead(self.options["path"])

    def streamReader(self, schema: StructType) -> StreamRead:  # noqa: N802
        most = self.options.get("maxFiles")
        return StreamRead(self.options["path"], self.options.get("reader", "reader"), int(most) if most else None)

    def writer(self, schema: StructType, overwrite: bool) -> BatchAppend:
        if overwrite:
            raise ValueError("a queue is appended to only")
        return BatchAppend(self.options["path"], self.options.get("writer", "batch"), schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamAppend:  # noqa: N802
        return StreamAppend(self.options["path"], self.options.get("writer", "stream"), schema)


def append(rows: DataFrame, path: str) -> None:
    """Commit ``rows`` to a queue."""
    rows.sparkSession.dataSource.register(QueueTable)
    rows.write.format(NAME).option("path", path).mode("append").save()


def committed(spark: SparkSession, path: str) -> DataFrame:
    """All that has been committed to a queue."""
    spark.dataSource.register(QueueTable)
    return spark.read.format(NAME).option("path", path).load()


def polled(spark: SparkSession, path: str, schema: StructType | str | None = None, max_files: int | None = None, reader: str = "reader") -> DataFrame:
    """A queue as a stream."""
    spark.dataSource.register(QueueTable)
    source = spark.readStream.format(NAME).option("path", path).option("reader", reader)
    source = source.option("maxFiles", max_files) if max_files else source
    return (source.schema(schema) if schema else source).load()
