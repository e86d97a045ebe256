"""Whitening of embeddings, their covariance found from variances alone (polarisation).

For entries i and j, 2 cov(i, j) = var(i + j) - var(i) - var(j). Spark sums exact squares of centred
integers for each dimension and for each sum of two dimensions; the driver meets d (d + 1) / 2 numbers,
whatever the number of rows, takes the differences as whole numbers and rounds once, to a double.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, SHIFT = 64.0, 1_000_000
WIDEST = 1 << 44
BLOCK = 2048


@dataclass
class Whitening:
    """``n`` fitted vectors, their whole-number sums, and the components, each over the root of its eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return (self.values / self.trace).tolist()


def integers(vector: Column) -> Column:
    """Entries as whole numbers, floor(64 c) + 1000000."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)


def usable(vector: Column) -> Column:
    """Whether a vector has an entry and all are present, finite and in magnitude below 2**44 / 64."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < WIDEST / SCALE)
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(F.forall(vector, fine), F.lit(False))


def _matrices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _totals(rows: DataFrame, add: Callable[[np.ndarray], np.ndarray]) -> list[int]:
    """Exact sums over all rows of the numbers that ``add`` gives per block, by place."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _matrices(batches, "x"):
            got = add(x).astype(object)
            total = got if total is None else total + got
        if total is not None:
            whole = pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), whole], ["place", "total"])

    parts = rows.mapInArrow(partial, "place long, total decimal(38,0)")
    return [int(r["total"]) for r in parts.groupBy("place").agg(F.sum("total").alias("total")).orderBy("place").collect()]


def _squares(y: np.ndarray, pairs: bool) -> np.ndarray:
    """Sums of squares of the columns, or of the sums of two columns (i < j, by i, then j); exact."""
    top = int(np.abs(y).max(initial=0)) * 2
    y = y if top * top * len(y) < 2**63 else y.astype(object)
    if not pairs:
        return (y * y).sum(axis=0)
    out = [((both := y[:, i + 1 :] + y[:, i : i + 1]) * both).sum(axis=0) for i in range(y.shape[1] - 1)]
    return np.concatenate(out) if out else np.empty(0, np.int64)


def fit(rows: DataFrame) -> Whitening | None:
    """Fit on all rows of ``x`` (arrays of long, one length); None without rows or without variance.

    Entries are centred on the whole number nearest their mean before they are squared; what is left of the
    mean is taken off exactly, n sum(y^2) - (sum y)^2 over n^2. Components come by falling eigenvalue, signed so
    that their largest entry is positive; those within rounding of zero variance are left out.
    """
    n = rows.count()
    if not n:
        return None
    sums = _totals(rows, lambda x: x.sum(axis=0))
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    left = [s - n * int(m) for s, m in zip(sums, middle, strict=True)]
    d = len(sums)
    squares = _totals(rows, lambda x: np.concatenate([_squares(x - middle, False), _squares(x - middle, True)]))
    own = [n * q - t * t for q, t in zip(squares[:d], left, strict=True)]  # n^2 times the variance
    cov = np.diag([o / (n * n) for o in own])
    for (i, j), q in zip(((i, j) for i in range(d) for j in range(i + 1, d)), squares[d:], strict=True):
        cov[i, j] = cov[j, i] = (n * q - (left[i] + left[j]) ** 2 - own[i] - own[j]) / (2 * n * n)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = values > max(values[0], 0.0) * d * np.finfo(float).eps
    values, vectors = values[real], vectors[:, real]
    if not len(values):
        return None
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return Whitening(n, sums, values, vectors, sum(own) / (n * n))


def _projection(model: Whitening, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a task needs of the model: whole and left-over parts of the mean, and scaled components."""
    whole = np.array([s // model.n for s in model.sums], np.int64)
    rest = np.array([(s % model.n) / model.n for s in model.sums])
    return whole, rest, model.vectors[:, :components] / np.sqrt(model.values[:components])


def project(rows: DataFrame, model: Whitening, components: int = 32) -> DataFrame:
    """``rows`` with ``whitened`` (array of double) and ``deviation`` (decimal: sum over entries of (n x - S)^2, exact)."""
    whole, rest, scaled = _projection(model, components)
    n, remainder = model.n, [s % model.n for s in model.sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, "x"):
            y = x - whole
            w = (y - rest) @ scaled
            fits = (n * (int(np.abs(y).max(initial=0)) + 1)) ** 2 * y.shape[1] < 2**63
            u = (y if fits else y.astype(object)) * n - np.array(remainder, np.int64 if fits else object)
            far = pa.array([Decimal(int(v)) for v in (u * u).sum(axis=1)], pa.decimal128(38, 0))
            ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, pa.array(w.ravel())), far], [*part.schema.names, "whitened", "deviation"])

    schema = T.StructType([*rows.schema.fields, T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.DecimalType(38, 0))])
    return rows.mapInArrow(run, schema)


def identity_error(rows: DataFrame, model: Whitening, components: int = 32) -> float:
    """The largest absolute entry of the covariance of the whitened rows less the identity."""
    whole, rest, scaled = _projection(model, components)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for _, x in _matrices(batches, "x"):
            w = (x - whole - rest) @ scaled
            total = total + np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "total"])

    got = rows.mapInArrow(partial, "place long, total double").groupBy("place").agg(F.sum("total").alias("total")).orderBy("place").collect()
    k = scaled.shape[1]
    total = np.array([r["total"] for r in got]) / model.n
    return float(np.abs(total[k:].reshape(k, k) - np.outer(total[:k], total[:k]) - np.eye(k)).max())


def whiten(docs: DataFrame, *, vector: str = "embedding", components: int = 32) -> tuple[DataFrame, Whitening | None]:
    """The usable rows with ``whitened``, ``deviation`` and ``x`` in place of columns of those names, and the fitted model.

    Dropped are null and empty vectors, vectors with a null, infinite or not-a-number entry or one of 2**38 or more in
    magnitude, and vectors that are not of the commonest length (of the longer, where two are as common).
    Equal rows count each; a null key is a key. Without rows, or where no entry varies, the model is None and no row comes back.
    """
    kept = [c for c in docs.columns if c not in ("x", "whitened", "deviation")]
    fine = docs.where(usable(F.col(vector))).select(*kept, integers(F.col(vector)).alias("x"))
    lengths = fine.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = fine.where(F.size("x") == (lengths["d"] if lengths else 0))
    model = fit(rows.select("x"))
    if model is None:
        return rows.withColumns({"whitened": F.lit(None).cast("array<double>"), "deviation": F.lit(None).cast("decimal(38,0)")}).where("false"), None
    return project(rows, model, components), model
