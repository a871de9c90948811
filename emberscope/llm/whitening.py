"""Whitening of embeddings: principal components of their covariance, and vectors of unit variance along them.

Entries are put on a grid of whole numbers (64 steps to the unit), so sums and deviations are exact. The fit counts
each distinct vector once. Spark adds up what tasks return: sums of the dimensions, then products of centred
vectors, a table of d rows of d numbers for each task, which is all that the driver gets, added up.

Components start as the eigenvectors of the covariance in single precision. Steps of Ogita and Aishima's refinement, matrix
products in extended precision, double the number of right digits each time. Eigenvalues that lie closer together than a step
can tell apart form clusters; inside each, the covariance restricted to the cluster's vectors, less the cluster's mean, is solved again.

Vectors that are null, or hold null, NaN, infinite or absolute entries from 2**54 on (beyond the grid), take no part and have no rows; so do vectors of another
length than the most frequent one (of equally frequent lengths, the longest). Repeated rows have a row each. Directions in which the
vectors do not vary beyond rounding have no component, so that fewer than asked for may come, none at all
from one distinct vector. An empty table gives an empty one. A deviation beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscope.session import Scratch

from .common import free_name, ship

STEPS, SHIFT, LIMIT = 64, 1_000_000, 2.0**54
#: Rows multiplied at once.
BLOCK = 8192
ROUNDS = 12


# --- eigenvectors ------------------------------------------------------------


def _norm(a: np.ndarray) -> np.longdouble:
    """An upper bound of the spectral norm of a symmetric matrix."""
    return np.abs(a).sum(axis=1).max()


def _clusters(values: np.ndarray, width: np.longdouble) -> list[np.ndarray]:
    """Places of values that a chain of gaps up to ``width`` links."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > width) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    """One step: better eigenvectors of ``a`` than ``x``, and how far those were from orthogonal and diagonal."""
    one = np.eye(len(a), dtype=a.dtype)
    r = one - x.T @ x
    s = x.T @ a @ x
    s = (s + s.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    width = 2 * (_norm(s - np.diag(values)) + _norm(a) * _norm(r))
    gaps = values[None, :] - values[:, None]
    apart = np.abs(gaps) > width
    # half of the departure from orthogonality, and a turn that is antisymmetric to the last digit
    change = r / 2 + np.where(apart, s + (values[None, :] + values[:, None]) / 2 * r, 0) / np.where(apart, gaps, 1)
    x = x + x @ change
    for near in _clusters(values, width):
        own = x[:, near]
        inner = own.T @ (a - values[near].mean() * one) @ own
        size = np.abs(inner).max()
        if size > 0:
            turn = np.linalg.eigh(((inner + inner.T) / (2 * size)).astype(np.float64))[1].astype(a.dtype)
            x[:, near] = own @ turn
    return x, float(max(np.abs(r).max(), np.abs(s - np.diag(np.diag(s))).max()))


def eigenpairs(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, to double precision."""
    scale = np.abs(covariance).max(initial=0.0)
    if not scale > 0:
        return np.zeros(len(covariance)), np.eye(len(covariance))
    a = covariance.astype(np.longdouble) / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    for _ in range(ROUNDS):
        x, off = refine(a, x)
        if off < 1e-17:
            break
    values = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    x = x / np.sqrt((x * x).sum(axis=0))
    order = np.argsort(-values, kind="stable")
    return (values[order] * scale).astype(np.float64), x[:, order].astype(np.float64)


# --- the fit -----------------------------------------------------------------


@dataclass
class Whitener:
    """n distinct vectors, the sums of their dimensions, and for each component its eigenvalue and unit vector (a column)."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def __post_init__(self):
        self.base = np.array([s // self.n for s in self.sums], dtype=np.int64)
        self.rest = np.array([s % self.n for s in self.sums], dtype=np.int64)

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) for v in self.values]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the means, without loss: the whole part goes in whole numbers."""
        return (x - self.base).astype(np.float64) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums over the dimensions of (n * x - sum)**2."""
        part = x - self.base
        top = int(np.abs(part).max(initial=0)) + 1
        if (self.n * top) ** 2 * max(1, x.shape[1]) < 1 << 63:
            return ((self.n * part - self.rest) ** 2).sum(axis=1).tolist()
        rest = [int(r) for r in self.rest]
        exact = (sum((self.n * int(p) - r) ** 2 for p, r in zip(row, rest, strict=True)) for row in part)
        return [e if e < 1 << 63 else None for e in exact]


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


def on_grid(vector: Column) -> Column:
    """The vector in whole numbers; null where it takes no part."""

    def whole(c: Column) -> Column:
        return F.floor(c.cast("double") * STEPS) + SHIFT

    # NaN is larger than any number; the limit keeps the rest within 64 bits
    fits = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < LIMIT, F.lit(False)))
    return F.when(fits, F.transform(vector, whole))


def _added(rows: DataFrame, work, width: int) -> np.ndarray:
    """The sum of the matrices that ``work`` returns for the vectors, block by block and task by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch.column(0), width)
            for at in range(0, len(x), BLOCK):
                part = work(x[at : at + BLOCK])
                total = part if total is None else total + part
        if total is not None:
            names = pa.array(range(len(total)), pa.int32())
            yield pa.RecordBatch.from_arrays([names, pa.array([r.tolist() for r in total], pa.list_(pa.float64()))], names=["i", "v"])

    parts = rows.select("x").mapInArrow(run, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    found = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    if not found:
        return np.zeros((0, 0))
    out = np.zeros((1 + max(r.i for r in found), 1 + max(r.j for r in found)))
    for r in found:
        out[r.i, r.j] = r.v
    return out


def _sums(rows: DataFrame) -> list[int]:
    """Exact sums of the dimensions."""
    each = rows.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    return [int(r.v) for r in each.orderBy("j").collect()]


def fit(vectors: DataFrame, vector: str = "embedding", components: int = 16) -> Whitener | None:
    """The whitener of the distinct vectors on the grid; None without any."""
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    whole = vectors.select(on_grid(F.col(vector)).alias("x")).filter(F.size("x") > 0)
    distinct = scratch.put(whole.distinct(), "vectors")
    lengths = distinct.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if common is None:
        scratch.clear()
        return None
    d, n = common.d, common.n
    rows = distinct.filter(F.size("x") == d)
    start = Whitener(n, _sums(rows), np.zeros(0), np.zeros((d, 0)), 0.0)

    def products(x: np.ndarray) -> np.ndarray:
        c = start.centred(x)
        return c.T @ c

    covariance = _added(rows, products, d) / n
    values, directions = eigenpairs((covariance + covariance.T) / 2)
    trace = float(np.trace(covariance))
    real = int((values > values[0] * d * 2.0**-48).sum()) if values[0] > 0 else 0
    k = min(components, real)
    model = Whitener(n, start.sums, values[:k], directions[:, :k], trace)

    def checked(x: np.ndarray) -> np.ndarray:
        w = np.hstack([model.whitened(x), np.ones((len(x), 1))])
        return w.T @ w

    if k:
        moments = _added(rows, checked, d) / n
        means = moments[:k, k]
        model = replace(model, identity_error=float(np.abs(moments[:k, :k] - np.outer(means, means) - np.eye(k)).max()))
    scratch.clear()
    return model


def whiten(vectors: DataFrame, model: Whitener | None, vector: str = "embedding") -> DataFrame:
    """The rows that take part, with the columns deviation (long) and whitened (array of doubles), which replace those of that name."""
    made = ("deviation", "whitened")
    kept = [c for c in vectors.columns if c.lower() not in made]
    ship(vectors.sparkSession)
    x, out = free_name(vectors, "__x"), free_name(vectors, "__out")
    kind = "struct<deviation: bigint, whitened: array<double>>"
    if model is None:
        return vectors.filter(F.lit(False)).select(*kept, F.lit(None).cast("long").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened"))
    d = len(model.sums)

    @F.arrow_udf(kind)
    def project(batch: pa.Array) -> pa.Array:
        grid = _matrix(batch, d)
        deviations = pa.array(model.deviations(grid), pa.int64())
        white = model.whitened(grid)
        flat = pa.array(white.reshape(-1))
        offsets = pa.array(np.arange(len(white) + 1, dtype=np.int32) * white.shape[1])
        return pa.StructArray.from_arrays([deviations, pa.ListArray.from_arrays(offsets, flat)], names=["deviation", "whitened"])

    rows = vectors.withColumn(x, on_grid(F.col(vector))).filter(F.size(x) == d)
    return rows.withColumn(out, project(F.col(x))).select(*kept, *(F.col(f"{out}.{m}").alias(m) for m in made))
