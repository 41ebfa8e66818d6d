"""Toxicity by a factorization machine over hashed terms.

A text's terms are its different words, lower-cased, and their beginnings of three to eight letters, hashed to
``2 ** bits`` slots. The score is the logistic function of bias, the terms' weights and all their pairwise products, whose
weights are inner products of short vectors, so that a pair of terms weighs more or less than its two terms alone.
The model is trained on at most ``max_rows`` labelled rows (a bounded sample by a hash of the id), on all slots of all their terms.
Its size is that of the slots, whatever the corpus.

Cases: a null or empty text has no terms and gets the bias alone; rows without label, id or known label value are not learnt
from; with no labelled rows the model scores the prior 0; repeated rows count as often as they occur; all columns but
the id and the text (and the label in training) are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.base import beside, named, slices, whole_text

WORD = re.compile(r"[^\W\d_]+")


class Terms(dict):
    """Packed slots of a word and its beginnings."""

    def __init__(self, bits: int, keep: int = 100_000):
        self.mask, self.keep = (1 << bits) - 1, keep

    def __missing__(self, word: str) -> bytes:
        data = word.encode()
        found = [zlib.crc32(b"w" + data)] + [zlib.crc32(b"p" + word[:k].encode()) for k in range(3, min(8, len(word)) + 1)]
        out = self[word] = np.array([x & self.mask for x in found], "<u4").tobytes()
        return out

    def slots(self, text: str) -> np.ndarray:
        """A text's different slots, ascending."""
        if len(self) > self.keep:
            self.clear()
        words = set(WORD.findall(text.lower()))
        return np.unique(np.frombuffer(b"".join(map(self.__getitem__, words)), "<u4"))


@dataclass
class Model:
    bits: int
    bias: float
    weight: np.ndarray  # by slot
    factors: np.ndarray  # slot x rank

    def score(self, slots: np.ndarray) -> float:
        v = self.factors[slots]
        z = self.bias + float(self.weight[slots].sum()) + 0.5 * float((v.sum(0) ** 2 - (v * v).sum(0)).sum())
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def tobytes(self) -> bytes:
        return np.array([self.bits, self.bias]).tobytes() + self.weight.tobytes() + self.factors.tobytes()

    @classmethod
    def frombytes(cls, data: bytes) -> Model:
        bits, bias = np.frombuffer(data, np.float64, 2)
        values = np.frombuffer(data, np.float32, offset=16)
        size = 1 << int(bits)
        return cls(int(bits), float(bias), values[:size], values[size:].reshape(size, -1))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learnt from: crc32 of the id as text, modulo four, is two."""
    return F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def values(docs: list[np.ndarray], y: np.ndarray, size: int, scale: float = 10.0) -> np.ndarray:
    """Each slot's value, above zero for all that occur: near one where presence and label go together far beyond
    chance or, less so, where the slot is frequent; small for a few rows' own words, which would be learnt by heart."""
    df, hit = np.zeros(size), np.zeros(size)
    for d, positive in zip(docs, y, strict=True):
        df[d] += 1
        hit[d] += positive
    share = y.mean() if len(y) else 0.0
    beyond = np.maximum(np.abs(hit - df * share) - 0.5, 0) ** 2 / (df * share * (1 - share) + 1)
    signal = beyond + df / 50
    return (signal / (signal + scale)).astype(np.float32)


def fit(docs: list[np.ndarray], y: np.ndarray, bits: int, rank: int, epochs: int, rate: float, l1: float, l2: float, seed: int, block: int = 64) -> Model:
    """Adagrad over shuffled blocks of documents, each the ascending slots of its terms; all slots that occur are learnt."""
    size = 1 << bits
    rng = np.random.default_rng(seed)
    bias, gb = (float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else -30.0), 1e-2
    x = values(docs, y, size)
    w, gw = np.zeros(size, np.float32), np.full(size, 1e-2, np.float32)
    v = (rng.normal(0, 0.01, (rank, size)) * (x > 0)).astype(np.float32)
    gv = np.full((rank, size), 1e-2, np.float32)
    docs = [(d, t) for d, t in zip(docs, y.tolist(), strict=True) if len(d)]
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), block):
            some = [docs[i] for i in order[lo : lo + block]]
            sizes = np.array([len(d) for d, _ in some])
            at = np.concatenate([d for d, _ in some])
            first = np.cumsum(sizes) - sizes
            xa, wa = x[at], w[at]
            va = [v[k][at] * xa for k in range(rank)]
            total = [np.add.reduceat(a, first) for a in va]
            z = bias + np.add.reduceat(wa * xa - 0.5 * sum(a * a for a in va), first) + 0.5 * sum(t * t for t in total)
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - np.array([t for _, t in some])) / len(some)).astype(np.float32)
            each = np.repeat(g, sizes) * xa
            dw = np.bincount(at, each, size).astype(np.float32)
            slots = np.flatnonzero(dw)
            d = dw[slots]
            gw[slots] += d * d
            step = rate / np.sqrt(gw[slots])
            moved = w[slots] - step * d
            w[slots] = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
            for k in range(rank):
                pair = np.repeat(total[k], sizes) - va[k]
                d = np.bincount(at, each * pair, size)[slots].astype(np.float32) + l2 * v[k][slots]
                gv[k][slots] += d * d
                v[k][slots] -= 0.3 * rate / np.sqrt(gv[k][slots]) * d
            gb += float(g.sum()) ** 2
            bias -= rate / np.sqrt(gb) * float(g.sum())
    return Model(bits, bias, w * x, np.ascontiguousarray((v * x).T))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", bits: int = 18, rank: int = 4, max_rows: int = 12_000, epochs: int = 8, rate: float = 0.1, l1: float = 1e-4, l2: float = 1e-4, seed: int = 7) -> Model:
    """Fit on the documents that ``labels`` (id, label 0 or 1) names.

    The sample is drawn from the labels alone, so that ids and no texts are sorted and the sample is small enough to be
    broadcast: ``max_rows`` rows. An id that is labelled or found more than once counts once. One task fits; the
    driver gets the model alone.
    """

    def run(batches):
        terms = Terms(bits)
        for b in slices(batches):
            slots = [terms.slots(t).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(slots, pa.binary())], ["_id", "y", "slots"])

    def fitted(batches):
        y, found = [], []
        for b in slices(batches):
            y += b.column(0).to_pylist()
            found += [np.frombuffer(x, "<u4") for x in b.column(1).to_pylist()]
        model = fit(found, np.array(y, np.float32), bits, rank, epochs, rate, l1, l2, seed)
        yield pa.RecordBatch.from_arrays([pa.array([model.tobytes()], pa.binary())], ["model"])

    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label).cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), whole_text(text_col).alias("text")).join(F.broadcast(sample), "_id").select("_id", "y", "text")
    found = rows.mapInArrow(run, "_id long, y int, slots binary").groupBy("_id").agg(F.max("y").alias("y"), F.max("slots").alias("slots"))
    one = found.repartition(1).sortWithinPartitions(F.xxhash64("_id"), "_id").select("y", "slots").mapInArrow(fitted, "model binary").first()
    return Model.frombytes(one.model) if one else fit([], np.zeros(0, np.float32), bits, rank, 0, rate, l1, l2, seed)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as its slots

    def run(batches):
        fm = shared.value
        terms = Terms(fm.bits)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fm.score(terms.slots(t)) for t in b.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def train_on(docs: DataFrame, labels: DataFrame, **kwargs) -> Model:
    """train() with the labels that are not held out."""
    return train(docs, labels.where(~held_out()), **kwargs)


def below(docs: DataFrame, model: Model, most: float, text_col: str = "text") -> DataFrame:
    """The rows whose score is below ``most``, scored by an Arrow function of the text; all columns stay, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        fm = shared.value
        terms = Terms(fm.bits)
        return pd.Series([fm.score(terms.slots(t)) for t in texts], dtype=float)

    scored = docs.select(beside(docs), score(F.coalesce(named(text_col), F.lit(""))).alias("score"))
    return scored.where(F.col("score") < most).select("row.*")
