"""Whitening of embeddings: leading eigenvectors of their covariance by LOBPCG over distributed products.

An entry c becomes the integer ``floor(1024 * c) + 100000``; sums are exact integers, and rows are centred exactly before they are
multiplied. The covariance is never formed: each round, one pass over the rows multiplies it with a block of a few
columns, namely the iterate, its residuals and the previous directions; a task sends one block's product, and products are added as a tree.
The driver holds such blocks alone, whose size is that of a vector times three times the block. Rayleigh-Ritz in
their span gives the next iterate, until a product of its own certifies that each wanted pair's residual is below ``tol`` of the
largest eigenvalue. Tasks keep nothing between rounds, so a lost executor costs its tasks only.

Cases: vectors that are null, empty, hold null or non-finite entries or entries beyond 2^42, or have another length than most (the
longer of two equally common lengths) are dropped; ids may be null or repeated, and repeated vectors count as often as they occur; no
vectors give no rows; there are as many components as dimensions if these are fewer; components without variance to
double precision have null as whitened value, 0 as explained share and no part in the identity error, which is null if there are no
others; a deviation beyond the range of long is null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, LARGEST = 1024, 100_000, 2.0**42


def exact(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column are fit, and their integers."""
    right = pc.fill_null(pc.equal(pc.list_value_length(column), size), False)
    values = column.filter(right).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, size)
    with np.errstate(invalid="ignore"):
        fit = (np.abs(values) <= LARGEST).all(1)
    return np.flatnonzero(right.to_numpy(zero_copy_only=False))[fit], np.floor(values[fit] * SCALE).astype(np.int64) + SHIFT


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: tuple[int, ...]  # exact
    largest: int  # absolute integer
    vectors: np.ndarray | None = None  # dimension x component
    values: np.ndarray | None = None  # falling eigenvalues; not a number where there is no variance
    trace: float = 0.0
    error: float | None = None  # of the whitened covariance against the identity

    def spread(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, as integers of 64 bits where these are wide enough, else as Python's."""
        if self.n * self.largest < 1 << 61:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.spread(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        away = self.spread(x)
        if len(away) and float(np.abs(away).max()) ** 2 * away.shape[1] >= 2.0**62:
            away = away.astype(object)
        return [int(d) if d < 1 << 63 else None for d in (away * away).sum(1)]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))


def summed(rows: DataFrame, size: int) -> Whitening:
    """Number and exact sums of the fit vectors; sums go in two halves, which cannot overflow."""

    def run(batches):
        n, top, high, low = 0, 0, np.zeros(size, np.int64), np.zeros(size, np.int64)
        for b in batches:
            _, x = exact(b.column(0), size)
            n, top = n + len(x), max(top, int(np.abs(x).max(initial=0)))
            high, low = high + (x >> 26).sum(0), low + (x & (1 << 26) - 1).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(high), pa.array(low), pa.array([n] * size), pa.array([top] * size)], ["at", "high", "low", "n", "top"])

    found = rows.mapInArrow(run, "at int, high long, low long, n long, top long").groupBy("at").agg(*(F.sum(c).alias(c) for c in ("high", "low", "n")), F.max("top").alias("top"))
    by_place = sorted(found.collect())  # a row for each dimension
    return Whitening(by_place[0].n, tuple((r.high << 26) + r.low for r in by_place), by_place[0].top) if by_place else Whitening(0, (0,) * size, 0)


def totals(rows: DataFrame, size: int, shape: tuple[int, ...], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all fit vectors of ``of(integers of a batch)``, an array of ``shape``; tasks' sums are added as a tree."""

    def run(batches):
        total = np.zeros(shape)
        for b in batches:
            total += of(exact(b.column(0), size)[1])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = rows.mapInArrow(run, "part binary").rdd.map(lambda r: np.frombuffer(r[0]).reshape(shape))
    return parts.treeReduce(np.add)


def lobpcg(product: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, guard: int = 8, tol: float = 1e-13, rounds: int = 300, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors of the symmetric matrix that ``product`` multiplies blocks with.

    Residual norms are at most ``tol`` times the largest eigenvalue, by a product that is taken of the result itself.
    """
    width = min(size, wanted + guard)
    x = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, width)))[0]
    more = np.zeros((size, 0))
    for _ in range(rounds):
        basis = np.hstack([x, more])
        image = product(basis)
        small = basis.T @ image
        values, mix = np.linalg.eigh((small + small.T) / 2)
        values, mix = values[::-1][:width], mix[:, ::-1][:, :width]
        x, residual = basis @ mix, image @ mix - basis @ mix * values
        directions = basis[:, width:] @ mix[width:]
        norms = np.linalg.norm(residual, axis=0)
        if norms[:wanted].max() <= tol * abs(values[0]):
            x = np.linalg.qr(x[:, :wanted])[0]
            image = product(x)
            values = (x * image).sum(0)
            if np.linalg.norm(image - x * values, axis=0).max() <= 2 * tol * abs(values[0]):
                order = np.argsort(-values, kind="stable")
                return values[order], x[:, order]
            x = np.linalg.qr(np.hstack([x, basis @ mix[:, wanted:]]))[0]
        x = np.linalg.qr(x)[0]
        more = np.hstack([residual, directions])
        lengths = np.linalg.norm(more, axis=0)
        more = more[:, lengths > 0] / lengths[lengths > 0]
        for _ in range(2):
            more = more - x @ (x.T @ more)
        span, weight, _ = np.linalg.svd(more, full_matrices=False)
        more = span[:, weight > 1e-10][:, : size - width]
        more = np.linalg.qr(np.hstack([x, more]))[0][:, width:]
    raise ArithmeticError(f"residuals of {norms[:wanted].max()} after {rounds} rounds")


def fit(df: DataFrame, vec_col: str = "embedding", components: int = 8, **limits) -> Whitening:
    """Components of the covariance of all fit vectors."""
    rows = df.select(F.col(vec_col).cast("array<double>").alias("v"))
    common = rows.where(F.size("v") > 0).groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = common.size if common else 1
    model = summed(rows, size)
    if not model.n:
        return model

    def product(block: np.ndarray) -> np.ndarray:
        def of(x):
            c = model.centred(x)
            return c.T @ (c @ block)

        return totals(rows, size, block.shape, of) / model.n

    trace = float(totals(rows, size, (1,), lambda x: np.square(model.centred(x)).sum().reshape(1))[0]) / model.n
    wanted = min(components, size)
    if not trace:
        return replace(model, vectors=np.eye(size)[:, :wanted], values=np.full(wanted, np.nan))
    values, vectors = lobpcg(product, size, wanted, **limits)
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), range(wanted)])
    values = np.where(values > 1e-13 * values[0], values, np.nan)
    model = replace(model, vectors=vectors, values=values, trace=trace)
    known = int(np.isfinite(values).sum())

    def of(x):
        w = model.whitened(x)[:, :known]
        return np.vstack([w.T @ w, w.sum(0)])

    moments = totals(rows, size, (known + 1, known), of) / model.n
    error = np.abs(moments[:-1] - np.outer(moments[-1], moments[-1]) - np.eye(known)).max()
    return replace(model, error=float(error))


def whitened(df: DataFrame, model: Whitening, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error``, a row for each fit vector and component."""
    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    shared = df.sparkSession.sparkContext.broadcast(model)  # a few columns of a vector's length

    def run(batches):
        m = shared.value
        if not m.n:
            return
        size, k = m.vectors.shape
        share = np.nan_to_num(m.values / (m.trace or 1.0))
        for b in batches:
            rows, x = exact(b.column(1), size)
            w = m.whitened(x).ravel()
            columns = [
                b.column(0).take(pa.array(np.repeat(rows, k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                pa.array(np.full(len(rows) * k, m.n)),
                pa.array([d for d in m.deviations(x) for _ in range(k)], pa.int64()),
                pa.array(w, mask=np.isnan(w)),
                pa.array(np.tile(share, len(rows))),
                pa.array([m.error] * (len(rows) * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(run, schema)
