"""Token-id files: one array of ids, with document boundaries in Elias-Fano code.

A file holds consecutive documents. After a fixed header come the documents' ids and the ends of their id runs, both as
Elias-Fano lists (about log2(universe / n) + 2 bits an entry), and the ids themselves. The high parts of a list
are a bit vector in which the k-th one says the k-th entry; every SAMPLE-th one's place is stored, so that select(k) reads
a sample and counts bits from there.

Cases: a null text is the empty one and has the end id alone; null ids come first; repeated rows and equal ids stay as they are,
ordered by their text; an empty table gives no files; columns besides id and text are ignored.
"""

from __future__ import annotations

import io
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.base import shared_dir, slices, whole_text, written
from quire.llm.tokens import encoder

MAGIC = b"QUIREID1"
SAMPLE = 256
HEAD = struct.Struct("<8sQQQB")


class EliasFano:
    """A nondecreasing list of nonnegative integers."""

    LAYOUT = struct.Struct("<QQBQQ")

    def __init__(self, n: int, top: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.top, self.width, self.low, self.high, self.samples = n, top, width, low, high, samples
        self.lows = memoryview(np.ascontiguousarray(low))
        self.words = memoryview(np.ascontiguousarray(high).view("<u8")) if len(high) else []

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * width, np.uint8)
        for k in range(width):
            low[k::width] = values >> k & 1
        ones = (values >> width) + np.arange(n)
        bits = np.zeros(((top >> width) + n + 64) // 64 * 64, np.uint8)
        bits[ones] = 1
        return cls(n, top, width, np.packbits(low, bitorder="little"), np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def _low(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for k in range(self.width):
            bit = at * self.width + k
            out |= (self.low[bit >> 3] >> (bit & 7) & 1).astype(np.int64) << k
        return out

    def decode(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        at = np.arange(self.n)
        return (ones - at) << self.width | self._low(at)

    def select(self, k: int) -> int:
        """Entry ``k``, by a sample and a count of bits from it on."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        at = int(self.samples[k // SAMPLE])
        words, left = self.words, k % SAMPLE
        word = at >> 6
        now = words[word] >> (at & 63) << (at & 63)
        while left >= now.bit_count():
            left -= now.bit_count()
            word += 1
            now = words[word]
        for _ in range(left):
            now &= now - 1
        one = word * 64 + (now & -now).bit_length() - 1
        bit = k * self.width
        low = int.from_bytes(self.lows[bit >> 3 : (bit + self.width + 7) >> 3], "little") >> (bit & 7) & (1 << self.width) - 1
        return (one - k) << self.width | low

    def tobytes(self) -> bytes:
        return self.LAYOUT.pack(self.n, self.top, self.width, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def read(cls, f) -> EliasFano:
        n, top, width, low, high = cls.LAYOUT.unpack(f.read(cls.LAYOUT.size))
        take = lambda size, kind: np.frombuffer(f.read(size), kind)
        return cls(n, top, width, take(low, np.uint8), take(high, np.uint8), take(-(-n // SAMPLE) * 4, "<u4"))


def file_bytes(doc_ids: list[int | None], ends: list[int], ids: bytes, width: int) -> bytes:
    """A file's bytes; ``doc_ids`` ascend with nulls first, ``ends`` count ids, ``ids`` are packed ``width`` bytes each."""
    nulls = sum(x is None for x in doc_ids)
    known = np.array(doc_ids[nulls:], np.int64)
    base = int(known[0]) if len(known) else 0
    head = HEAD.pack(MAGIC, len(doc_ids), nulls, base & (1 << 64) - 1, width)
    return b"".join([head, EliasFano.encode(known - base).tobytes(), EliasFano.encode(np.array(ends, np.int64)).tobytes(), ids])


class IdFile:
    """A file that is read back: document ids, boundaries, and the ids of any document."""

    def __init__(self, f):
        magic, self.n, nulls, base, self.width = HEAD.unpack(f.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        base -= (base >> 63) << 64
        self.doc_ids = [None] * nulls + (EliasFano.read(f).decode() + base).tolist()
        self.ends = EliasFano.read(f)
        self.ids = np.frombuffer(f.read(), f"<u{self.width}")

    def document(self, k: int) -> np.ndarray:
        return self.ids[self.ends.select(k - 1) if k else 0 : self.ends.select(k)]


def write(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = 1 << 22) -> DataFrame:
    """Write the files into a new folder of the shared one; ``path, part, nth, n_docs, n_tokens, base`` for each file.

    Documents are dealt by ranges of ids and sorted in each, so files in the order of (part, nth) hold ascending ids;
    ``base`` is the number of ids in all files before. A file takes no further document beyond ``file_tokens`` ids.
    A file appears under its name only when whole, with the same bytes from whichever attempt of a task.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/quire-ids-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    # Rows without id, or with the same one, are ordered and spread by hashes of their texts; rows that are equal in both are alike.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.xxhash64(F.lit(1), "text")]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = "path string, part int, nth int, n_docs long, n_tokens long"

    def run(batches):
        enc, part, nth = encoder(tokenizer), TaskContext.get().partitionId(), 0
        store, root = fs.FileSystem.from_uri(folder)
        width, end = np.dtype(enc.dtype).itemsize, enc.pack([end_id])

        def flush():
            name = f"{root}/part-{part:06d}-{nth:06d}.ids"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(trial := f"{name}.{uuid.uuid4().hex}") as f:
                f.write(file_bytes(held, ends, b"".join(packed), width))
            store.move(trial, name)
            return pa.RecordBatch.from_pylist([{"path": name, "part": part, "nth": nth, "n_docs": len(held), "n_tokens": n}], pa.schema([("path", pa.string()), ("part", pa.int32()), ("nth", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        held, ends, packed, n = [], [], [], 0
        for b in slices(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = enc.encode(text) + end
                n += len(ids) // width
                held.append(doc_id)
                ends.append(n)
                packed.append(ids)
                if n >= file_tokens:
                    yield flush()
                    held, ends, packed, n, nth = [], [], [], 0, nth + 1
        if held:
            yield flush()

    files, _ = written(rows.mapInArrow(run, schema), "idfiles")
    # Within a part by its files; between parts by one row for each of them, which are as many as partitions.
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    in_part = F.coalesce(F.sum("n_tokens").over(before.partitionBy("part").orderBy("nth")), F.lit(0))
    of_part = F.coalesce(F.sum("total").over(before.orderBy("part")), F.lit(0))
    bases = files.groupBy("part").agg(F.sum("n_tokens").alias("total")).select("part", of_part.alias("part_base"))
    return files.withColumn("base", in_part).join(bases, "part").select(*files.columns, (F.col("base") + F.col("part_base")).alias("base"))


def read(files: DataFrame) -> DataFrame:
    """``doc_id, start, ids`` (unsigned 32-bit, little-endian) of every document in the files."""
    spark = files.sparkSession
    where = shared_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        store, _ = fs.FileSystem.from_uri(where)
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_file(path) as f:
                    file = IdFile(io.BytesIO(f.readall()))
                start = 0
                for at in range(0, file.n, 1024):
                    ends = [file.ends.select(k) for k in range(at, min(at + 1024, file.n))]
                    starts = [start, *ends[:-1]]
                    start = ends[-1]
                    ids = [file.ids[a:z].astype("<u4").tobytes() for a, z in zip(starts, ends, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids[at : at + 1024], pa.int64()), pa.array([a + base for a in starts], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])

    dealt = files.select("path", "base").repartition(parts, "path")
    return dealt.mapInArrow(run, "doc_id long, start long, ids binary")
