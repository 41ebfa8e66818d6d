"""URL filter over a sorted array of 64-bit digests.

A key is ``host`` + ``path``, such as ``example.com/en/``: it fits the host and all its subdomains where the url's path starts with
the key's. A list is a table of keys and what each says, of any size. Spark hashes its keys, deals them by ranges of digests
and sorts them; each range is a file in the shared folder: digests in ascending order, then the keys in that order and what
each says. Executors get the files from Spark, map them into memory, hash every candidate of a batch (each parent of the
host, with each path length that the list has), probe all of them by one vectorised binary search in each file, and
compare the stored key, so equal digests of different keys decide nothing. The longest key that fits wins; a later list is
asked only where an earlier one is silent. A list of more than ``ship_keys`` keys isn't given to every executor: the
candidates, each once, are dealt to the files by their digests, and a task probes one file at a time.

Cases: a null url, or one without ``://``, has an empty host and path and fits no key; a null or empty key, and a key without host,
fit nothing; a key that is listed twice must say the same; an empty list is silent; repeated rows are judged alike; null ids
are kept.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.base import shared_dir

MAGIC = b"QUIREURL"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path of a url, empty where there are none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def digest(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"))


def list_bytes(rows: list[tuple[int, bytes, bytes]], paths: list[int], longest: int) -> bytes:
    """A file of (digest, key, verdict) rows that are sorted; ``paths`` and ``longest`` are the whole list's path lengths and
    longest host."""
    ends = np.cumsum([len(b) for _, k, v in rows for b in (k, v)], dtype="<u8")
    head = struct.pack("<8sQQQ", MAGIC, len(rows), longest, len(paths)) + np.array(paths, "<u8").tobytes()
    return head + np.array([d for d, _, _ in rows], "<u8").tobytes() + ends.tobytes() + b"".join(b for _, k, v in rows for b in (k, v))


def candidates(host: str, path: str, lengths: list[int], longest: int) -> list[str]:
    """Every key that could fit, longest first."""
    out, at = [], 0
    ends = [k for k in lengths if k <= len(path)]
    while at >= 0 and host:
        if len(host) - at <= longest:
            out += [host[at:] + path[:k] for k in ends]
        at = host.find(".", at) + 1 or -1
    return sorted(out, key=len, reverse=True)


class UrlList:
    """A list's file of a range of digests, mapped into memory, or its bytes."""

    def __init__(self, path: str | bytes):
        data = np.frombuffer(path, np.uint8) if isinstance(path, bytes) else np.memmap(path, np.uint8, "r")
        magic, self.n, self.longest, n_paths = struct.unpack("<8sQQQ", data[:32].tobytes())
        if magic != MAGIC:
            raise ValueError("not a url list")
        at = 32 + 8 * n_paths
        self.paths = data[32:at].view("<u8").tolist()
        self.digests = data[at : at + 8 * self.n].view("<u8")
        self.ends = data[at + 8 * self.n : at + 24 * self.n].view("<u8")
        self.blob = data[at + 24 * self.n :]

    def _blob(self, k: int) -> str:
        return self.blob[int(self.ends[k - 1]) if k else 0 : int(self.ends[k])].tobytes().decode()

    def find(self, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each digest, where it begins and ends in the file."""
        return np.searchsorted(self.digests, want, "left"), np.searchsorted(self.digests, want, "right")

    def verdict(self, candidate: str, low: int, high: int) -> str | None:
        """What the file says of a key, if it is one of those with its digest."""
        k = next((k for k in range(low, high) if self._blob(2 * k) == candidate), None)
        return None if k is None else self._blob(2 * k + 1)


def judge(files: list[UrlList], hosts: list[str], paths: list[str]) -> tuple[list, list]:
    """For each url the longest key of a list (its files) that fits and its verdict, or None twice."""
    keys, verdicts = [None] * len(hosts), [None] * len(hosts)
    tried = [candidates(h, p, files[0].paths, files[0].longest) if files else [] for h, p in zip(hosts, paths, strict=True)]
    flat = [c for t in tried for c in t]
    want = np.array([digest(c) for c in flat], "<u8")
    places = [f.find(want) for f in files]
    held = np.zeros(len(flat), bool)
    for low, high in places:
        held |= high > low
    at = 0
    for n, t in enumerate(tried):
        for i in range(at, at + len(t)):
            if held[i]:
                said = next((v for f, (low, high) in zip(files, places, strict=True) if (v := f.verdict(flat[i], low[i], high[i])) is not None), None)
                if said is not None:
                    keys[n], verdicts[n] = flat[i], said
                    break
        at += len(t)
    return keys, verdicts


@dataclass(frozen=True)
class Stored:
    """A list in the shared folder: its files, each with its first digest, in the order of these."""

    keys: int
    lengths: list[int]
    longest: int
    files: list[tuple[int, str]]


def store(listed: DataFrame, key: str = "key", verdict: str = "verdict", file_keys: int = 1_000_000) -> Stored:
    """Write a list's files into the shared folder, ``file_keys`` keys each or so."""
    spark = listed.sparkSession
    where = shared_dir(spark)
    rows = listed.select(F.col(key).cast("string").alias("key"), F.col(verdict).cast("string").alias("verdict")).where("key != '' and verdict is not null")
    once = rows.groupBy("key").agg(F.min("verdict").alias("verdict"), (F.min("verdict") != F.max("verdict")).alias("torn"))
    host = F.split_part("key", F.lit("/"), F.lit(1))
    n, torn, longest, lengths = once.agg(F.count("*"), F.count_if("torn"), F.max(F.length(host)), F.sort_array(F.collect_set(F.length("key") - F.length(host)))).first()
    if torn:
        raise ValueError(f"{torn} keys are listed with different verdicts")
    if not n:
        return Stored(0, [], 0, [])

    def hashed(batches):
        for b in batches:
            # As a signed number of the same order.
            found = np.array([digest(k) for k in b.column(0).to_pylist()], np.uint64) ^ np.uint64(1 << 63)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), b.column(0), b.column(1)], ["d", "key", "verdict"])

    def write(batches):
        out = []
        for b in batches:
            found = b.column(0).to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
            out += zip(found.tolist(), (k.encode() for k in b.column(1).to_pylist()), (v.encode() for v in b.column(2).to_pylist()), strict=True)
        if out:
            data = list_bytes(out, lengths, longest)
            name = f"quire-urls-{hashlib.sha256(data).hexdigest()[:24]}.bin"
            disk, folder = fs.FileSystem.from_uri(where)
            disk.create_dir(folder, recursive=True)
            with disk.open_output_stream(trial := f"{folder}/{name}.{uuid.uuid4().hex}") as f:
                f.write(data)
            disk.move(trial, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([str(out[0][0])]), pa.array([name])], ["first", "name"])

    dealt = once.select("key", "verdict").mapInArrow(hashed, "d long, key string, verdict string").repartitionByRange(-(-n // file_keys), "d").sortWithinPartitions("d", "key")
    files = sorted((int(r.first), r.name) for r in dealt.mapInArrow(write, "first string, name string").collect())  # one row a file
    return Stored(n, lengths, longest, files)


def ship(spark: SparkSession, stored: Stored) -> list[str]:
    """Have Spark give a list's files to all executors; their names."""
    known = {os.path.basename(x) for x in spark.sparkContext.listFiles}
    names = [name for _, name in stored.files]
    for name in names:
        if name not in known:
            spark.sparkContext.addFile(f"{shared_dir(spark)}/{name}")
    return names


def looked_up(rows: DataFrame, stored: Stored) -> DataFrame:
    """``host, path, key, verdict`` of the urls that a key fits, by candidates that are dealt to the list's files."""
    where = shared_dir(rows.sparkSession)
    edges = np.array([first for first, _ in stored.files], "<u8")

    def spread(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                out = [(h, p, c, digest(c)) for h, p in zip(b.column(0)[at : at + 1000].to_pylist(), b.column(1)[at : at + 1000].to_pylist(), strict=True) for c in candidates(h, p, stored.lengths, stored.longest)]
                hosts, paths, keys, digests = zip(*out, strict=True) if out else ((), (), (), ())
                file = np.maximum(np.searchsorted(edges, np.array(digests, "<u8"), "right") - 1, 0)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in (hosts, paths, keys)), pa.array(file, pa.int32())], ["host", "path", "key", "file"])

    def probe(batches):
        disk, folder = fs.FileSystem.from_uri(where)
        number, file = -1, None
        for b in batches:
            asked, keys = b.column(0).to_numpy(), b.column(1).to_pylist()
            for n in np.unique(asked).tolist():  # in order
                if n != number:
                    with disk.open_input_file(f"{folder}/{stored.files[n][1]}") as f:
                        number, file = n, UrlList(f.readall())
                mine = [keys[i] for i in np.flatnonzero(asked == n).tolist()]
                low, high = file.find(np.array([digest(k) for k in mine], "<u8"))
                said = [file.verdict(k, int(a), int(z)) for k, a, z in zip(mine, low, high, strict=True)]
                held = [(k, v) for k, v in zip(mine, said, strict=True) if v is not None]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.string()), pa.array([v for _, v in held], pa.string())], ["key", "verdict"])

    tried = rows.where("host != ''").select("host", "path").distinct().mapInArrow(spread, "host string, path string, key string, file int")
    once = tried.select("file", "key").distinct()
    found = once.repartition("file").sortWithinPartitions("file", "key").mapInArrow(probe, "key string, verdict string")
    # Of equally long keys the one of the longer host, as in candidates().
    rank = F.struct(F.length("key"), F.length(F.split_part("key", F.lit("/"), F.lit(1))))
    best = tried.select("host", "path", "key").join(found, "key").groupBy("host", "path").agg(F.max_by(F.struct("key", "verdict"), rank).alias("said"))
    return best.select("host", "path", "said.*")


def judged(pages: DataFrame, lists: list[DataFrame], id_col: str = "page_id", url_col: str = "url", ship_keys: int = 4_000_000, file_keys: int = 1_000_000) -> DataFrame:
    """``page_id, host, path, rule, list, verdict`` of every row; rule, list (its number) and verdict are null where all are silent.

    A list is a table with the columns ``key`` and ``verdict``.
    """
    spark = pages.sparkSession
    held = [store(listed, file_keys=file_keys) for listed in lists]
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    if any(x.keys > ship_keys for x in held):
        for k, stored in enumerate(held):
            said = looked_up(rows, stored).select("host", "path", F.col("key").alias(f"key{k}"), F.col("verdict").alias(f"verdict{k}"))
            rows = rows.join(said, ["host", "path"], "left")
        first = F.coalesce(*(F.when(F.col(f"key{k}").isNotNull(), F.struct(F.col(f"key{k}").alias("rule"), F.lit(k).alias("list"), F.col(f"verdict{k}").alias("verdict"))) for k in range(len(held))))
        return rows.select("page_id", "host", "path", first.alias("said")).select("page_id", "host", "path", "said.*")
    names = [ship(spark, stored) for stored in held]

    def run(batches):
        loaded = [[UrlList(SparkFiles.get(n)) for n in files] for files in names]
        for b in batches:
            hosts, paths = b.column(1).to_pylist(), b.column(2).to_pylist()
            rule, which, verdict = [None] * len(hosts), [None] * len(hosts), [None] * len(hosts)
            for k, files in enumerate(loaded):
                for i, (r, v) in enumerate(zip(*judge(files, hosts, paths), strict=True)):
                    if rule[i] is None and r is not None:
                        rule[i], which[i], verdict[i] = r, k, v
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(rule, pa.string()), pa.array(which, pa.int32()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "list", "verdict"])

    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, list int, verdict string")
