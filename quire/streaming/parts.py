"""Parts of files, put together as they come: a file is handed on as soon as its last part is there.

Large files are parsed in parts, which come in any order and may come twice. For each file the state holds its parts and where it
stands; messages are taken in the order of their event time. A file is ``whole`` when each part's first message says done, and
``failed`` when a part's first message does not; either is told once, and what comes later for it is ignored. A file of
which nothing has been heard for longer than ``patience`` of event time is forgotten, ``expired`` if it was still open, by a timer or
by the message that comes after that time, whichever is first; that message begins the file anew.

Each call for a state is a way to the JVM and back, so the files are dealt over buckets, and a bucket's files are one state.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from datetime import timedelta
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: A message: a part (from 0) of ``n_parts`` of a file, whether it is done, what it holds, where its pages begin, and when that was.
PART = "file long, part int, n_parts int, state string, path string, page_offset int, n_items long, ts timestamp, seq long"
RESULT = "file long, began timestamp, status string, n_parts int, n_items long, paths array<string>, page_offsets array<int>, failed_part int"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

US = 1_000_000

#: Fixed value: how many buckets files are dealt over; a stream that goes on needs the number it began with.
BUCKETS = 1024

MESSAGE = ["file", "part", "n_parts", "state", "path", "page_offset", "n_items", "ts", "seq"]


class Assembler(StatefulProcessor):
    """The state of a file: value (began, last, status) and its parts by number."""

    def __init__(self, patience: timedelta):
        self.patience = round(patience.total_seconds() * US)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.file = handle.getValueState("file", "began long, last long, status string, timer long")
        self.parts = handle.getMapState("parts", "part int", "path string, page_offset int, n_items long")

    def _held(self) -> dict[int, tuple]:
        return {k[0]: tuple(v) for k, v in self.parts.iterator()}

    def _told(self, file: int, held: dict[int, tuple], began: int, status: str, failed: int | None = None) -> tuple:
        parts = [(k, *v) for k, v in sorted(held.items())]
        return file, began, status, len(parts), sum(p[3] for p in parts), [p[1] for p in parts], [p[2] for p in parts], failed

    def _heard(self, file: int, known: tuple, held: dict[int, tuple], messages: Iterable[tuple], told: list[tuple]) -> tuple:
        """The file's (began, last, status), its parts, those that are new and whether earlier ones are gone, after messages of MESSAGE in their order."""
        began, last, status = known
        stale, new = False, {}
        for _, part, n_parts, state, path, page_offset, n_items, at, _ in messages:
            if last is not None and at > last + self.patience:
                if status == "open":
                    told.append(self._told(file, held, began, "expired"))
                held, new, stale = {}, {}, True
                last = None
            if last is None:
                began, status = at, "open"
            last = at
            if status == "open" and part not in held:
                if state != "done":
                    status = "failed"
                    told.append(self._told(file, held, began, status, part))
                else:
                    held[part] = new[part] = (path, page_offset, n_items)
                    if len(held) == n_parts:
                        status = "whole"
                        told.append(self._told(file, held, began, status))
                if status != "open":
                    held, new, stale = {}, {}, True
        return (began, last, status), held, new, stale

    def _due(self, last: int) -> int:
        """When a file of which nothing was heard after ``last`` is forgotten, in ms."""
        return (last + self.patience) // 1000 + 1

    def _forget(self) -> None:
        self.file.clear()
        self.parts.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        told: list[tuple] = []
        if pd.isna(key[0]):
            yield frame_of(told)
            return
        began, last, status, timer = self.file.get() or (None, None, None, None)
        # The state is asked once and told once: each call is a way to the JVM and back.
        held = self._held() if status == "open" else {}
        (began, last, status), _, new, stale = self._heard(key[0], (began, last, status), held, messages_of(rows), told)
        if stale:
            self.parts.clear()
        for part, v in new.items():
            self.parts.updateValue((part,), v)
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = self._due(last)
        self.handle.registerTimer(timer)
        self.file.update((began, last, status, timer))
        yield frame_of(told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        told = []
        if self.file.exists():
            began, _, status, timer = self.file.get()
            if timer == expiredTimerInfo.getExpiryTimeInMs():
                if status == "open":
                    told.append(self._told(key[0], self._held(), began, "expired"))
                self._forget()
        yield frame_of(told)

    def close(self) -> None:
        pass


class Assemblers(Assembler):
    """The state of a bucket of files: value ``files``, a JSON object by file of [began, last, status, parts], and one timer, of the first that is due."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getValueState("files", "files string, timer long")

    def _keep(self, files: dict[str, list], timer: int | None) -> None:
        due = min((self._due(f[1]) for f in files.values()), default=None)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if files:
            self.files.update((json.dumps(files), due))
        else:
            self.files.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        told: list[tuple] = []
        if pd.isna(key[0]):
            yield frame_of(told)
            return
        text, timer = self.files.get() or ("{}", None)
        files = json.loads(text)
        for file, messages in groupby(messages_of(rows), lambda m: m[0]):
            *known, parts = files.get(str(file)) or [None, None, None, []]
            known, held, _, _ = self._heard(file, known, {k: tuple(v) for k, *v in parts}, messages, told)
            files[str(file)] = [*known, [[k, *v] for k, v in held.items()]]
        self._keep(files, timer)
        yield frame_of(told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Tells and forgets all files of the bucket that are due by now."""
        told = []
        text, timer = self.files.get() or ("{}", None)
        if timer == expiredTimerInfo.getExpiryTimeInMs():
            files, now = json.loads(text), timerValues.getCurrentWatermarkInMs()
            for file in [f for f, (_, last, _, _) in files.items() if self._due(last) <= now]:
                began, _, status, parts = files.pop(file)
                if status == "open":
                    told.append(self._told(int(file), {k: tuple(v) for k, *v in parts}, began, "expired"))
            self._keep(files, None)  # the timer is gone with this call
        yield frame_of(told)


def messages_of(rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """A micro-batch's messages of one key as tuples of MESSAGE, by file and then in their order; times are microseconds."""
    frame = pd.concat(list(rows)).sort_values(["file", "ts", "seq"])
    frame["ts"] = frame["ts"].astype("datetime64[us]").astype("int64")
    return zip(*(frame[c].tolist() for c in MESSAGE), strict=True)


def frame_of(told: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in RESULT.split(", ")]
    out = pd.DataFrame(told, columns=names, dtype=object)
    out["began"] = pd.to_datetime(out["began"], unit="us")
    return out.astype({"file": "int64", "n_parts": "int32", "n_items": "int64", "failed_part": "Int32"})


def assembled(parts: DataFrame, patience: timedelta, late: str = "0 seconds", buckets: int | None = BUCKETS) -> DataFrame:
    """A stream of PART messages as a stream of RESULT rows. Messages that are later than ``late`` may be dropped.

    A message without file only moves the event time on, as at a stream's end. Without ``buckets`` each file has a state of its own.
    """
    timed = parts.withWatermark("ts", late)
    of = F.when(F.col("file").isNotNull(), F.pmod(F.xxhash64("file"), F.lit(buckets)))
    keyed = timed.groupBy("file") if buckets is None else timed.withColumn("bucket", of).groupBy("bucket")
    one = Assembler(patience) if buckets is None else Assemblers(patience)
    return keyed.transformWithStateInPandas(statefulProcessor=one, outputStructType=StructType.fromDDL(RESULT), outputMode="append", timeMode="EventTime")


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries that are started within keep their state in RocksDB, which states with timers need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def run(stream: DataFrame, path: str, checkpoint: str, batches: int | None = None) -> None:
    """All that a stream's source has now, appended to the table at ``path`` once for each row, whatever is run again.

    The source is polled until it is empty, each time as far as it admits; ``batches`` stops after so many.
    """
    with keyed_state(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
        try:
            if batches is None:
                query.processAllAvailable()
            else:
                while query.isActive and (query.lastProgress is None or query.lastProgress["batchId"] + 1 < batches):
                    query.awaitTermination(0.05)
        finally:
            query.stop()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; on one machine the warehouse's will do."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/streams"
    root = root if ":" in root else f"file://{root}"
    return f"{root.rstrip('/')}/quire-{name}-{uuid.uuid4().hex}"
