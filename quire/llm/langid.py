"""Language of texts by multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, its runs of other characters than letters become one space, and its n-grams of one to ``ORDERS`` characters are
hashed to slots. Tasks count the slots by language, Spark adds the counts, and the smoothed log-probabilities, a matrix of
languages by slots, are broadcast. It has at most CELLS cells: beyond 64 languages there are fewer slots, and more than 1024
are refused. Texts are scored in batches of sparse rows: their slots pick entries of the matrix, which are summed by text.
The model is fitted on some ``per_language`` documents of each language (all, if there are fewer), picked by a hash; it
scores whole texts, very long ones piece by piece.

Cases: a text that is null or has no letter is ``und`` with score 0, and so is any text if nothing was learnt; documents without
language, text or letters are not learnt from; those without id are; of languages with equal scores the first by name
is taken; repeated rows count as often as they occur; other columns than id, text and, in training, language are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.base import slices
from quire.llm.toxicity import held_out

ORDERS = 3
CELLS, SLOTS, MOST = 1 << 22, 1 << 16, 1 << 10
#: Characters that are hashed at once.
PIECE = 1 << 19
NOT_LETTERS = re.compile(r"[\W\d_]+")
#: What Java takes for a letter.
LETTER = r"\p{L}"


def letters(text: str) -> str:
    """Lower-cased words between single spaces."""
    words = NOT_LETTERS.sub(" ", text.lower()).strip()
    return words and f" {words} "


def grams(codes: np.ndarray, slots: int) -> list[np.ndarray]:
    """For each order, the slots of the n-grams that begin at each character; the last ones of a text are cut short."""
    out, h = [], np.zeros(len(codes), np.uint32)
    for n in range(1, ORDERS + 1):
        h = (h[: len(codes) - n + 1] + codes[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        out.append(((h * np.uint32(0x85EBCA6B)) >> np.uint32(16)) & np.uint32(slots - 1))
    return out


def pieces(texts: list[str]):
    """Arrays of characters, with the texts that begin in each, where these begin and what was cut off a text before.

    Yields (codes, numbers of the texts, begin of each, end of each); a text longer than PIECE comes in several pieces, which
    share the last ORDERS - 1 characters.
    """
    some, at = [], 0
    for i, text in enumerate(texts):
        if at and at + len(text) > PIECE:
            yield joined(some)
            some, at = [], 0
        if len(text) > PIECE:
            for lo in range(0, len(text) - ORDERS + 1, PIECE):
                yield joined([(i, text[lo : lo + PIECE + ORDERS - 1])], last=lo + PIECE + ORDERS - 1 >= len(text))
        elif text:
            some.append((i, text))
            at += len(text)
    if some:
        yield joined(some)


def joined(some: list[tuple[int, str]], last: bool = True):
    sizes = np.array([len(t) for _, t in some])
    codes = np.frombuffer("".join(t for _, t in some).encode("utf-32-le", "surrogatepass"), "<u4")
    return codes, np.array([i for i, _ in some]), np.cumsum(sizes) - sizes, np.cumsum(sizes), last


def spans(begin: np.ndarray, end: np.ndarray, n: int, last: bool) -> np.ndarray:
    """First and end of each text's n-grams: those that begin in a piece that is not the last belong to the next one."""
    return np.column_stack([begin, end - (n if last else ORDERS) + 1]).ravel()


@dataclass(frozen=True)
class Model:
    names: tuple[str, ...]
    prior: np.ndarray  # log-probability by language
    weight: np.ndarray  # log-probability, language x slot

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log-probability of each text's n-grams and each language together."""
        out = np.zeros((len(texts), len(self.names))) + self.prior
        for codes, rows, begin, end, last in pieces(texts):
            for n, slots in enumerate(grams(codes, self.weight.shape[1]), 1):
                cut = spans(begin, end, n, last)
                for k in range(len(self.names)):
                    # a zero is put behind, since the last end may be that of the array
                    out[rows, k] += np.add.reduceat(np.append(self.weight[k][slots], 0.0), cut)[::2]
        return out

    def predicted(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        texts = [letters(t) if t and self.names else "" for t in texts]
        if not self.names:
            return ["und"] * len(texts), [0.0] * len(texts)
        scores = self.scores(texts)
        best = scores.argmax(1)
        share = 1 / np.exp(scores - scores.max(1, keepdims=True)).sum(1)
        return [self.names[k] if t else "und" for k, t in zip(best, texts, strict=True)], [float(s) if t else 0.0 for s, t in zip(share, texts, strict=True)]


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int = 20_000, alpha: float = 0.5) -> Model:
    """Fit on the rows that have a language and are not held out."""
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(LETTER))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST + 1).collect()}
    if len(sizes) > MOST:
        raise ValueError(f"more than {MOST} languages")
    if not sizes:
        return Model((), np.zeros(0), np.zeros((0, SLOTS)))
    names = sorted(sizes)
    slots = SLOTS
    while slots * len(names) > CELLS:
        slots //= 2
    share = F.create_map(*(F.lit(x) for name in names for x in (name, min(1.0, per_language / sizes[name]))))
    number = F.create_map(*(F.lit(x) for i, name in enumerate(names) for x in (name, i)))
    picked = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).select(number[F.col("lang")].alias("k"), "text")

    def run(batches):
        count = np.zeros((len(names), slots + 1), np.int64)  # the last column has the documents
        for b in slices(batches):
            by = np.array(b.column(0).to_pylist())
            texts = [letters(t) for t in b.column(1).to_pylist()]
            count[:, slots] += np.bincount(by, [bool(t) for t in texts], len(names)).astype(np.int64)
            for codes, at, begin, end, last in pieces(texts):
                for n, found in enumerate(grams(codes, slots), 1):
                    edges = spans(begin, end, n, last).reshape(-1, 2)
                    for k in np.unique(by[at]):
                        mine = [found[lo:hi] for lo, hi in edges[by[at] == k]]
                        count[k, :slots] += np.bincount(np.concatenate(mine), minlength=slots)
        k, slot = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(count[k, slot])], ["k", "slot", "n"])

    found = picked.mapInArrow(run, "k int, slot int, n long").groupBy("k", "slot").agg(F.sum("n").alias("n")).toArrow()  # at most CELLS rows
    k, slot, n = (found.column(c).to_numpy() for c in ("k", "slot", "n"))
    count = np.zeros((len(names), slots + 1))
    count[k, slot] = n
    grams_of, texts_of = count[:, :slots] + alpha, count[:, slots] + alpha
    return Model(tuple(names), np.log(texts_of / texts_of.sum()), np.log(grams_of / grams_of.sum(1, keepdims=True)))


def predictions(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row; the score is the language's posterior probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most CELLS cells

    def run(batches):
        for b in slices(batches):
            names, scores = shared.value.predicted(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.when(F.col(text_col).rlike(LETTER), F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
