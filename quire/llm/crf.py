"""Line quality by a linear-chain conditional random field.

A text's lines are a sequence; each is content or boilerplate. Features of a line (its shape, symbols, case, repetition within
the text, marked in steps) and of its neighbours' labels make the score; Viterbi decoding gives the best labels of a
whole text, and the share of its word characters in content lines decides whether it is kept.

The field is trained on at most ``max_rows`` labelled documents (a bounded sample by a hash of the id) that pass the base rules:
lines of a document of good quality count as content; of a poor one as boilerplate where they look unlike the good
documents' lines, which one round of relabelling by the field itself settles. Training maximises the likelihood of the label
sequences by Adagrad on forward-backward gradients.

Cases: null and empty texts have no words and fail the base rules; a text of one line is a sequence of one; with no usable labels the
field keeps every line; lines without words are content of no weight; very long texts are decoded whole; repeated rows are
judged alike; null ids are kept; columns besides id, text and quality are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.base import slices, whole_text

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
COUNTED = str.maketrans("", "", SYMBOLS)
SPACES = re.compile(r"[\x09-\x0D]")
#: Words that 3-word windows are looked for in.
WINDOW = 3


def words_of(text: str) -> list[str]:
    return WORD.findall(text) if SPACES.search(text.replace("\n", " ")) else [w for w in text.replace("\n", " ").split(" ") if w]


def repeated(words: list[str]) -> np.ndarray:
    """Which words lie in a window of three words that stands in the list more than once."""
    n = len(words)
    out = np.zeros(n, bool)
    if n < WINDOW + 1:
        return out
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    key = (ids[:-2] * len(number) + ids[1:-1]) if len(number) < 1 << 20 else None
    if key is not None and len(number) ** 3 < 1 << 62:
        key = key * len(number) + ids[2:]
        _, index, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = count[index] > 1
    else:
        rows = np.stack([ids[:-2], ids[1:-1], ids[2:]], axis=1)
        _, index, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        twice = count[index.ravel()] > 1
    out[:-2] |= twice
    out[1:-1] |= twice
    out[2:] |= twice
    return out


@dataclass
class Text:
    """A text's base counts and its lines' features."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    features: np.ndarray  # line x feature
    weight: np.ndarray  # word characters of each line

    @property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


STEPS = {  # fixed cuts: a feature is set for each cut that the measure reaches
    "symbols": (0.02, 0.05, 0.1, 0.2, 0.4),
    "upper": (0.2, 0.5, 0.8),
    "digits": (0.1, 0.3, 0.6),
    "marks": (0.5, 1.0, 2.0),
    "repeat": (0.2, 0.5, 0.8),
    "words": (1, 3, 8, 20, 60),
    "length": (3.0, 5.0, 7.0, 10.0),
}
N_FEATURES = 1 + sum(map(len, STEPS.values())) + 4


def analyse(text: str) -> Text:
    lines = text.split("\n")
    n = len(lines)
    by_line = [words_of(line) for line in lines]
    words = [w for ws in by_line for w in ws]
    again = repeated(words)
    sizes = np.fromiter(map(len, by_line), np.int64, n)
    chars = np.array([sum(map(len, ws)) for ws in by_line], np.int64)
    ends = np.cumsum(sizes)
    total = np.r_[0, np.cumsum(again)]
    rep = total[ends] - total[ends - sizes]
    seen: set[str] = set()
    dup = np.zeros(n, bool)
    for k, line in enumerate(lines):
        if sizes[k]:
            dup[k] = line in seen
            seen.add(line)
    symbols = np.array([len(line) - len(line.translate(COUNTED)) for line in lines], np.int64)
    some, wide = np.maximum(sizes, 1), np.maximum(chars, 1)
    upper = np.array([sum(map(str.isupper, line)) for line in lines])
    digits = np.array([sum(map(str.isdigit, line)) for line in lines])
    alnum = np.array([sum(map(str.isalnum, line)) for line in lines])
    measures = {"symbols": symbols / wide, "upper": upper / wide, "digits": digits / wide, "marks": (chars - alnum) / some, "repeat": rep / some, "words": sizes, "length": chars / some}
    columns = [np.ones(n)] + [measures[k] >= cut for k, cuts in STEPS.items() for cut in cuts]
    columns += [dup, np.array([line.rstrip().endswith((".", "!", "?", ":", ";")) for line in lines]), np.arange(n) == 0, np.arange(n) == n - 1]
    return Text(len(words), int(chars.sum()), int(symbols.sum()), int(dup.sum()), int(again.sum()), np.stack(columns, axis=1).astype(np.float32), chars)


@dataclass
class Field:
    """Weights of a feature for content (its negative for boilerplate) and of label pairs; label 1 is content."""

    weight: np.ndarray
    pair: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.weight
        return np.stack([-z, z], axis=1)

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """The best labels; content on ties."""
        e = self.emissions(features)
        p = self.pair
        a, b = float(e[0, 0]), float(e[0, 1])
        back = np.zeros((len(e), 2), np.int8)
        p00, p01, p10, p11 = (float(x) for x in p.ravel())
        for t, (x, y) in enumerate(e[1:].tolist(), 1):
            back[t, 0], back[t, 1] = b + p10 >= a + p00, b + p11 >= a + p01
            a, b = x + (b + p10 if back[t, 0] else a + p00), y + (b + p11 if back[t, 1] else a + p01)
        out = np.empty(len(e), np.int8)
        out[-1] = b >= a
        for t in range(len(e) - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out

    def share(self, text: Text) -> float:
        """The share of word characters in content lines."""
        total = int(text.weight.sum())
        return float(text.weight[self.viterbi(text.features) == 1].sum()) / total if total else 0.0


def _scan(m: np.ndarray) -> np.ndarray:
    """Running products of two-by-two matrices of logarithms, ``m[0] m[1] ... m[t]`` for each t, by doubling."""
    out, span = m.copy(), 1
    while span < len(out):
        a, b = out[:-span], out[span:]
        out = np.concatenate([out[:span], np.logaddexp(a[:, :, :1] + b[:, :1, :], a[:, :, 1:] + b[:, 1:, :])])
        span *= 2
    return out


def _gradient(field: Field, features: np.ndarray, labels: np.ndarray, starts: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Observed less expected counts of several sequences, each line's and pair's times its ``weight``.

    The sequences stand in a row, beginning at ``starts`` (the first is 0). Across a start nothing is scored, so that the
    row's marginals are those of its sequences.
    """
    e = field.emissions(features).astype(np.float64)
    pair = np.broadcast_to(field.pair, (len(e), 2, 2)).copy()
    pair[starts] = 0
    step = pair + e[:, None, :]  # to each line from the one before
    f = np.logaddexp(*_scan(step).transpose(1, 0, 2)) if len(e) else e
    b = np.zeros_like(e)
    if len(e) > 1:
        after = _scan(step[:0:-1].transpose(0, 2, 1))  # products from the end on, transposed
        b[:-1] = np.logaddexp(*after.transpose(1, 0, 2))[::-1]
    log_z = np.logaddexp(f[-1, 0], f[-1, 1])
    content = np.exp(f[:, 1] + b[:, 1] - log_z)
    # The weight counts twice: for content and, negated, for boilerplate.
    g = 2 * ((labels - content) * weight) @ features
    inner = np.ones(len(e), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    found = np.zeros((2, 2))
    np.add.at(found, (labels[at - 1], labels[at]), weight[at])
    expected = np.exp(f[at - 1][:, :, None] + step[at] + b[at][:, None, :] - log_z)
    return g, found - (expected * weight[at, None, None]).sum(0)


def _fit(data: list[tuple[np.ndarray, np.ndarray]], epochs: int, rate: float, l2: float, rng, block: int = 16) -> Field:
    """Adagrad; each step takes ``block`` whole sequences, each of which weighs the same."""
    field = Field(np.zeros(N_FEATURES), np.zeros((2, 2)))
    gw, gp = np.full(N_FEATURES, 1e-6), np.full((2, 2), 1e-6)
    for _ in range(epochs):
        for _ in range(0, len(data), block):
            some = [data[i] for i in rng.integers(0, len(data), block)]
            sizes = np.array([len(y) for _, y in some])
            features = np.concatenate([np.asarray(x, np.float32) for x, _ in some])
            w, p = _gradient(field, features, np.concatenate([y for _, y in some]), np.cumsum(sizes) - sizes, np.repeat(1 / sizes, sizes))
            w = w / block - l2 * field.weight
            p = p / block - l2 * field.pair
            gw += w * w
            gp += p * p
            field.weight += rate * w / np.sqrt(gw)
            field.pair += rate * p / np.sqrt(gp)
    return field


def fit(texts: list[tuple[int, np.ndarray]], epochs: int, rate: float, l2: float, seed: int) -> Field:
    """Fit on (quality, features of all lines) of each text; lines of poor texts are labelled again by a first field."""
    rng = np.random.default_rng(seed)
    if len({y for y, _ in texts}) < 2:
        return Field(np.eye(1, N_FEATURES)[0], np.zeros((2, 2)))
    first = _fit([(f, np.full(len(f), y, np.int64)) for y, f in texts], epochs, rate, l2, rng)
    again = [(f, np.ones(len(f), np.int64) if y else first.viterbi(f).astype(np.int64)) for y, f in texts]
    again = [(f, np.zeros(len(f), np.int64) if not y and z.all() else z) for (y, f), (_, z) in zip(texts, again, strict=True)]
    return _fit(again, epochs, rate, l2, rng)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 1500, epochs: int = 6, rate: float = 0.1, l2: float = 1e-3, seed: int = 5) -> Field:
    """Fit on documents with a ``quality`` label of 0 or 1, as many of either as half of ``max_rows`` at most, on all their lines.

    One task fits, on features of one bit each; the driver gets the weights alone.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").cast("int").alias("y"))
    order = [F.xxhash64("_id"), "_id"]
    half = max_rows // 2
    sample = known.where("y = 0").orderBy(*order).limit(half).union(known.where("y = 1").orderBy(*order).limit(half))

    def run(batches):
        for b in slices(batches):
            for i, y, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                text = analyse(t)
                if not text.base_failed:
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([y], pa.int32()), pa.array([np.packbits(text.features.astype(bool)).tobytes()], pa.binary()), pa.array([len(text.features)], pa.int32())], ["_id", "y", "bits", "n"])

    def fitted(batches):
        texts = []
        for b in slices(batches):
            for y, bits, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                texts.append((y, np.unpackbits(np.frombuffer(bits, np.uint8))[: n * N_FEATURES].reshape(n, N_FEATURES)))
        field = fit(texts, epochs, rate, l2, seed)
        yield pa.RecordBatch.from_arrays([pa.array([field.weight.tolist()]), pa.array([field.pair.ravel().tolist()])], ["weight", "pair"])

    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), whole_text().alias("text")).join(F.broadcast(sample), "_id").select("_id", "y", "text")
    found = rows.mapInArrow(run, "_id long, y int, bits binary, n int").groupBy("_id").agg(F.max("y").alias("y"), F.max(F.struct("n", "bits")).alias("f"))
    one = found.repartition(1).sortWithinPartitions(*order).select("y", "f.bits", "f.n").mapInArrow(fitted, "weight array<double>, pair array<double>").first()
    return Field(np.array(one.weight), np.array(one.pair).reshape(2, 2)) if one else fit([], epochs, rate, l2, seed)


def judged(docs: DataFrame, field: Field, min_share: float = 0.5) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept`` of every row."""

    def run(batches):
        for b in slices(batches):
            texts = [analyse(t) for t in b.column(1).to_pylist()]
            share = [field.share(t) for t in texts]
            longs = [pa.array([getattr(t, k) for t in texts], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            failed = [t.base_failed for t in texts]
            kept = [not f and s >= min_share for f, s in zip(failed, share, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *longs, pa.array(failed), pa.array(share, pa.float64()), pa.array(kept)], names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean")
