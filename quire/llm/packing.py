"""Lexical retrieval packing: documents that share rare tokens fill the same training window.

1. Every text becomes token ids and an end id; a table of them is written. Document frequencies and the mean length are
   counted over all documents; the terms are token ids, so the counts are bounded by the vocabulary.
2. Documents are dealt by ranges of (min-hash of token triples, id, row): copies and near copies come to the same part, parts
   have like sizes whatever the copies, since ids and row numbers break the ties. A part is one index shard, or several of
   ``shard_docs`` documents or ``shard_tokens`` ids.
3. Each shard has a BM25 inverted index: postings by term, with weights from the counts over all documents.
4. Windows are filled greedily: a window's seed is the document that it begins with. The seed queries the postings of all
   its terms, and the unused document of the highest score comes next (the first one on ties), cut at the window's
   end; its rest begins the next window. An open window goes on in the part's next shard, which its seed queries anew. A
   part's last, short window is cut into powers of two, so nothing is padded.

A seed's neighbours are looked for in its own shard, where the search is exact; README tells what share of the corpus-wide
nearest ones that finds. The whole corpus is not searched, since for whole documents as queries that work grows with its square.

Cases: a null text is the empty one and has the end id alone; repeated rows and equal ids are documents of their own; a null
id stays null; a text of any length is cut over as many windows as it takes; an empty table gives no rows; columns
besides id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.base import slices, trim, whole_text, written
from quire.llm.tokens import encoder

K1, B = 1.2, 0.75
#: Odd multipliers of the triples' hash; any will do.
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _triples(x: np.ndarray) -> np.ndarray:
    h = x[:-2] * MIX[0] + x[1:-1] * MIX[1] + x[2:] * MIX[2]
    h ^= h >> np.uint64(31)
    h *= MIX[0]
    return h >> np.uint64(1)


def signatures(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each document's least hash of its token triples (of what there is, where there are fewer than three tokens)."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    out = np.zeros(len(sizes), np.uint64)
    wide = sizes > 2
    x = ids.astype(np.uint64)
    if wide.any():
        edges = np.stack([starts[wide], ends[wide] - 2], axis=1).ravel()
        out[wide] = np.minimum.reduceat(np.r_[_triples(x), np.uint64(0)], edges)[::2]
    for k in np.flatnonzero(~wide):
        out[k] = _triples(np.r_[x[starts[k] : ends[k]], np.zeros(3 - sizes[k], np.uint64)])[0]
    return out.astype(np.int64)


def id_type(spark: SparkSession, tokenizer: str) -> str:
    """The numpy type of a tokenizer's packed ids, asked of a worker, so that the driver loads no vocabulary."""

    def run(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([encoder(tokenizer).dtype])], ["kind"])

    return spark.range(1, numPartitions=1).mapInArrow(run, "kind string").first().kind


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """A table ``doc_id, row, sig, n, ids`` (packed ids with the end id), and their numpy type; ``row`` tells rows apart."""
    kind = id_type(docs.sparkSession, tokenizer)

    def run(batches):
        enc = encoder(tokenizer)
        end = enc.pack([end_id])
        row = TaskContext.get().partitionId() << 36
        for b in slices(batches):
            ids = [enc.encode(t) + end for t in b.column(1).to_pylist()]
            flat = np.frombuffer(b"".join(ids), enc.dtype)
            sizes = np.array([len(x) for x in ids], np.int64) // flat.itemsize
            cols = [pa.array(np.arange(row, row + len(ids))), pa.array(signatures(flat, sizes)), pa.array(sizes), pa.array(ids, pa.binary())]
            row += len(ids)
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "row", "sig", "n", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return written(rows.mapInArrow(run, "doc_id long, row long, sig long, n long, ids binary"), "tokens")[0], kind


def statistics(tokens: DataFrame, kind: str) -> tuple[np.ndarray, int, int]:
    """Document frequency by token id, the number of documents, and of ids, over the whole table."""

    def run(batches):
        df = np.zeros(0, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 255):  # as many documents as eight bits count
                docs = [np.frombuffer(x, kind) for x in b.column(0).slice(lo, 255).to_pylist()]
                count = np.zeros(max(1 << 16, 1 + max(int(d.max()) for d in docs)), np.uint8)
                for d in docs:
                    held = np.zeros(len(count), bool)
                    held[d] = True
                    count += held
                df = np.pad(df, (0, max(0, len(count) - len(df))))
                df[: len(count)] += count
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["token", "df"])

    rows = tokens.select("ids").mapInArrow(run, "token long, df long").groupBy("token").agg(F.sum("df").alias("df")).toArrow()
    n_docs, n_ids = tokens.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    token = rows["token"].to_numpy()
    df = np.zeros(int(token.max()) + 1 if len(token) else 1, np.int64)
    df[token] = rows["df"].to_numpy()
    return df, n_docs, n_ids


class Index:
    """A shard's BM25 inverted index: the postings of the term in ``place`` k are ``docs[at[k]:at[k + 1]]``, with weights.

    A term that more than one in ``common`` documents have is kept as a row of weights instead; what these rows add to the
    scores of the shard's own documents comes from one product of matrices.
    """

    def __init__(self, documents: list[np.ndarray], idf: np.ndarray, mean: float, common: int = 8):
        self.n = len(documents)
        sizes = [len(d) for d in documents]
        key = np.concatenate(documents).astype(np.uint64) << np.uint64(32)
        key |= np.repeat(np.arange(self.n, dtype=np.uint64), sizes)
        key.sort()
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        tf = np.diff(np.r_[first, len(key)]).astype(np.float32)
        key = key[first]
        term = (key >> np.uint64(32)).astype(np.int64)
        docs = (key & np.uint64((1 << 32) - 1)).astype(np.int64)
        norm = (K1 * (1 - B + B * np.array(sizes) / mean)).astype(np.float32)[docs]
        weights = idf[term] * (tf * (K1 + 1) / (tf + norm))
        new = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        ends = np.r_[new, len(term)]
        held = np.diff(ends)
        wide = np.flatnonzero(held * common > self.n)
        self.row = np.full(len(idf), -1, np.int64)
        self.row[term[new[wide]]] = np.arange(len(wide))
        self.rows = np.zeros((len(wide), self.n), np.float32)
        for k, w in enumerate(wide.tolist()):
            self.rows[k, docs[ends[w] : ends[w + 1]]] = weights[ends[w] : ends[w + 1]]
        self.shared = (self.rows > 0).T.astype(np.float32) @ self.rows  # document by document
        narrow = np.flatnonzero(held * common <= self.n)
        kept = np.repeat(held * common <= self.n, held)
        self.docs, self.weights = docs[kept], weights[kept].astype(np.float64)
        self.at = np.r_[0, np.cumsum(held[narrow])]
        self.place = np.full(len(idf), -1, np.int64)  # of each term's postings
        self.place[term[new[narrow]]] = np.arange(len(narrow))
        self.held = np.zeros(len(idf), bool)  # marks a query's terms

    def query(self, document: np.ndarray, number: int | None = None) -> np.ndarray:
        """Each document's score for the different terms of ``document``, whose ``number`` is known if it is the shard's own."""
        self.held[document] = True
        terms = np.flatnonzero(self.held)
        self.held[document] = False
        k = self.place[terms]
        k = k[k >= 0]
        out = np.zeros(self.n, np.float32) if number is None else self.shared[number].copy()
        starts = self.at[k]
        sizes = self.at[k + 1] - starts
        ends = np.cumsum(sizes)
        if len(k):
            at = np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)  # of all these terms' postings
            out += np.bincount(self.docs[at], self.weights[at], self.n)
        if number is None:
            for r in self.row[terms].tolist():
                if r >= 0:
                    out += self.rows[r]
        return out


class Packer:
    """Fills windows; a piece is (document, start, length, sequence, offset), where documents go by their keys."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence = window, first_sequence
        self.open: list[tuple] = []
        self.fill, self.seed = 0, None

    def shard(self, documents: dict[int, np.ndarray], index: Index, seeds: dict[int, np.ndarray]):
        """Pieces of all windows that get full; ``seeds`` has the ids of the open window's seed as well."""
        keys = list(documents)
        number = {key: n for n, key in enumerate(keys)}
        used = np.zeros(len(keys), bool)
        free, done = 0, []
        at, start = -1, 0
        scores, scored = None, None  # of the seed that was asked last
        while True:
            if at < 0:
                while free < len(keys) and used[free]:
                    free += 1
                if free == len(keys):
                    return done
                at, start = free, 0
                if self.fill:
                    if scored != self.seed:
                        scores, scored = index.query(seeds[self.seed], number.get(self.seed)), self.seed
                        scores[used] = -1
                    at = int(np.argmax(scores))
                used[at] = True
                if scores is not None:
                    scores[at] = -1
            if not self.fill:
                self.seed = keys[at]
            size = len(documents[keys[at]])
            take = min(size - start, self.window - self.fill)
            self.open.append((keys[at], start, take, self.sequence, self.fill))
            self.fill += take
            start += take
            if start == size:
                at = -1
            if self.fill == self.window:
                done += self.open
                self.open, self.fill, self.seed = [], 0, None
                self.sequence += 1

    def close(self):
        """The open window's pieces, cut so that each sequence's length is a power of two."""
        done, room, at = [], 0, 0
        left = self.fill
        for key, start, length, _, _ in self.open:
            while length:
                if not room:
                    room, at = 1 << (left.bit_length() - 1), 0
                take = min(length, room)
                done.append((key, start, take, self.sequence, at))
                start, length, room, at, left = start + take, length - take, room - take, at + take, left - take
                self.sequence += not room
        self.open, self.fill = [], 0
        return done


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, window: int = 1024, shard_docs: int = 4096, shard_tokens: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` (unsigned 32-bit little-endian).

    Each id of each document is in exactly one piece. A sequence has ``window`` ids, or a smaller power of two at a part's end.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tokens, kind = tokenized(docs, tokenizer, end_id, id_col, text_col)
    df, n_docs, n_ids = statistics(tokens, kind)
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean = max(1.0, n_ids / max(1, n_docs))
    parts = max(parts, n_ids >> 24)  # some 16 million ids each at most
    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

    def run(batches):
        trim()
        packer = Packer(window, TaskContext.get().partitionId() << 36)
        held: dict[int, np.ndarray] = {}  # ids of the documents that open or coming windows need
        doc_ids: dict[int, int | None] = {}
        shard: dict[int, np.ndarray] = {}
        serial, n = 0, 0

        def rows(done):
            for at in range(0, len(done), 4096):
                out = []
                for key, start, length, sequence, offset in done[at : at + 4096]:
                    ids = held[key]
                    out.append((doc_ids[key], start, length, len(ids), sequence, offset, ids[start : start + length].astype("<u4").tobytes()))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.binary())], [c.split()[0] for c in schema.split(", ")])
            keep = {p[0] for p in packer.open} | {packer.seed}
            for key in [k for k in held if k not in keep]:
                del held[key], doc_ids[key]

        def flush():
            yield from rows(packer.shard(shard, Index(list(shard.values()), idf, mean), held))

        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard[serial] = held[serial] = np.frombuffer(ids, kind)
                doc_ids[serial] = doc_id
                n += len(held[serial])
                serial += 1
                if n >= shard_tokens or len(shard) >= shard_docs:
                    yield from flush()
                    shard.clear()
                    n = 0
        if shard:
            yield from flush()
        yield from rows(packer.close())

    dealt = tokens.repartitionByRange(parts, "sig", "doc_id", "row").sortWithinPartitions("sig", "doc_id", "row").select("doc_id", "ids")
    return dealt.mapInArrow(run, schema)
