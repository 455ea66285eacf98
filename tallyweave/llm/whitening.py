"""Embedding whitening: float32 eigenvectors of a distributed covariance, refined in higher precision.

Vectors become whole numbers x (`vectors`); each distinct x counts once in the fit list. A first pass takes its number n and
sums S, a second the products of x minus the rounded means, in exact whole numbers, so the covariance V (divisor n) is exact
but for one final rounding. On the driver, which sees only V (dimensions squared), eigenvectors are found in float32 and
corrected by Ogita-Aishima iterations: with R = I - X'X and S = X'VX each step X + XE moves towards V's eigenvectors with
quadratic convergence, in extended precision. Pairs of eigenvalues too close to tell apart at the step's accuracy are only
made orthogonal; each cluster of such is then solved by itself, in the space its vectors span and shifted by its mean, and
iterated on. The result is applied to all rows in one narrow pass.

Rows left out are those of `vectors`. Repeated vectors count once in the fit and get rows of their own. There are at most as
many components as dimensions. A component without variance (all eigenvalues of a single distinct vector) has a null
whitened value; identity_error covers the others, and is null without any. deviation is null where no long holds it. No
usable vector, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import small_batches, stored, table
from tallyweave.llm.vectors import integer_vectors

COMPONENTS = 4
HIGHER = np.longdouble
#: Eigenvalues below this part of the largest are rounding of the covariance, not variance.
RANK = 2.0**-48


def _symmetric(a: np.ndarray) -> float:
    """A bound of the spectral norm: the largest sum of a row's sizes."""
    return float(np.abs(a).sum(axis=1).max()) if a.size else 0.0


def _clusters(values: np.ndarray, width: float) -> list[np.ndarray]:
    """Places of eigenvalues within `width` of the next one, in groups of two and more."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > width) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def correct(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One Ogita-Aishima step for the symmetric matrix a and near eigenvectors x: (x, their eigenvalues, width, least).

    width: eigenvalues nearer than this to each other weren't told apart; least: what rounding leaves of it at best.
    """
    n = len(a)
    r = np.eye(n, dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    r, s = (r + r.T) / 2, (s + s.T) / 2  # halves of e cancel but for r, whatever the rounding
    values = np.diag(s) / (1 - np.diag(r))
    least = 16 * n * float(np.finfo(a.dtype).eps) * _symmetric(a)
    width = max(least, 2 * (_symmetric(s - np.diag(values)) + _symmetric(a) * _symmetric(r)))
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > width
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    return x + x @ e, values, width, least


def solve_cluster(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Eigenvectors of a within the space that x's columns span: a small problem, shifted so that its values are small."""
    space = np.linalg.qr(x.astype(np.float64))[0].astype(a.dtype)
    space = space + space @ ((np.eye(space.shape[1], dtype=a.dtype) - space.T @ space) / 2)  # orthonormal to a's precision
    t = space.T @ (a @ space)
    t = t - np.eye(len(t), dtype=a.dtype) * (np.trace(t) / len(t))
    size = float(np.abs(t).max())
    return x if size == 0 else space @ np.linalg.eigh((t / size).astype(np.float64))[1].astype(a.dtype)


def eigen(v: np.ndarray, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, eigenvectors as columns) of a symmetric matrix to double precision.

    From float32 vectors on; a step solves the clusters that its start left, so each is split as soon as its inner gaps show.
    """
    a = v.astype(HIGHER)
    scale = float(np.abs(v).max()) if v.size else 0.0
    if scale == 0:
        return np.zeros(len(v)), np.eye(len(v))
    a = (a + a.T) / (2 * scale)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(HIGHER)
    for _ in range(steps):
        x, values, width, least = correct(a, x)
        if width <= least:  # what is still together is equal
            break
        for group in _clusters(values, width):
            x[:, group] = solve_cluster(a, x[:, group])
    x, values, _, _ = correct(a, x)
    x = x + x @ ((np.eye(len(a), dtype=a.dtype) - x.T @ x) / 2)
    x /= np.sqrt((x * x).sum(axis=0))
    order = np.argsort(-values, kind="stable")
    return (values[order] * scale).astype(np.float64), x[:, order].astype(np.float64)


def _exact(limit: float) -> type:
    """Whole numbers up to the limit: long columns of numpy, or Python's."""
    return np.int64 if limit < 2**62 else object


def _rows(b: pa.RecordBatch, column: str, length: int) -> np.ndarray:
    return np.asarray(b.column(column).flatten()).reshape(-1, length).astype(np.int64)


def _emit(values: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """A row (place, value) for each place of the arrays, as exact decimals."""
    import decimal

    flat = values.ravel()
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array([decimal.Decimal(int(x)) for x in flat], pa.decimal128(38, 0))], names=names)


def sums(fit: DataFrame, length: int) -> tuple[int, list[int]]:
    """(n, S) of the fit list, exact."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length + 1, object)
        for b in batches:
            x = _rows(b, "x", length)
            total += np.array([*x.sum(axis=0).tolist(), len(x)], object)
        yield _emit(total, ["at", "v"])

    rows = fit.select("x").mapInArrow(add, "at long, v decimal(38,0)").groupBy("at").agg(F.sum("v").alias("v")).collect()  # a row a dimension
    found = {r["at"]: int(r["v"]) for r in rows}
    return found[length], [found[i] for i in range(length)]


def covariance(fit: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """V, centred before multiplying: by the rounded means in whole numbers, and by what they leave exactly afterwards."""
    length = len(total)
    middle = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)
    shared = fit.sparkSession.sparkContext.broadcast(middle)  # a number a dimension

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((length, length), object)
        for b in batches:
            y = _rows(b, "x", length) - shared.value
            largest = float(np.abs(y).max()) ** 2 * len(y) if len(y) else 0.0
            if largest < 2**53:  # exact in doubles, with their fast products
                d = y.astype(np.float64)
                out += (d.T @ d).astype(np.int64).astype(object)
            else:
                y = y.astype(_exact(largest))
                out += (y.T @ y).astype(object)
        yield _emit(out, ["at", "v"])

    rows = fit.select("x").mapInArrow(multiply, "at long, v decimal(38,0)").groupBy("at").agg(F.sum("v").alias("v")).collect()  # dimensions squared
    product = np.zeros(length * length, object)
    for r in rows:
        product[r["at"]] = int(r["v"])
    rest = [s - n * int(m) for s, m in zip(total, middle)]
    exact = product.reshape(length, length) * n - np.outer(np.array(rest, object), np.array(rest, object))
    return np.array([[HIGHER(p // n) / n + HIGHER(p % n) / (HIGHER(n) * n) for p in row] for row in exact.tolist()], HIGHER)


@dataclass(frozen=True)
class Whitening:
    n: int
    total: list[int]
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        """(rows, components); NaN where a component has no variance."""
        middle = np.array([s // self.n for s in self.total], np.int64)
        rest = np.array([(s - self.n * int(m)) / self.n for s, m in zip(self.total, middle)])
        live = self.values > 0
        out = ((x - middle).astype(np.float64) - rest) @ self.components
        return np.where(live, out / np.sqrt(np.where(live, self.values, 1)), np.nan)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        s = np.array(self.total, object)
        limit = (float(self.n) * float(np.abs(x).max(initial=0)) + max(map(abs, self.total))) ** 2 * len(self.total)
        kind = _exact(limit)
        d = ((x.astype(kind) * kind(self.n) if kind is np.int64 else x.astype(object) * self.n) - s.astype(kind)) ** 2
        return [int(v) if v < 2**63 else None for v in d.sum(axis=1).tolist()]


def fit_whitening(fit: DataFrame, length: int, components: int = COMPONENTS) -> Whitening:
    """fit(x): each distinct vector once, at least one."""
    n, total = sums(fit, length)
    v = covariance(fit, n, total)
    values, x = eigen(v)
    trace = float(np.trace(v))
    values = np.where(values > RANK * max(values.max(), 0), values, 0.0)
    share = values / trace if trace > 0 else np.zeros(length)
    k = min(components, length)
    return Whitening(n, total, values[:k], x[:, :k].copy(), share[:k])


def identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """The largest entry of |whitened's covariance over the fit list - identity|."""
    live = np.flatnonzero(model.values > 0)
    if not len(live):
        return None
    shared, length, k = fit.sparkSession.sparkContext.broadcast(model), len(model.total), len(live)  # fixed size

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((k + 1, k + 1))
        for b in batches:
            w = shared.value.apply(_rows(b, "x", length))[:, live]
            w = np.hstack([w, np.ones((len(w), 1))])
            out += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], names=["at", "v"])

    m = np.zeros((k + 1) ** 2)
    for r in fit.select("x").mapInArrow(add, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # components squared
        m[r["at"]] = r["v"]
    m = m.reshape(k + 1, k + 1) / model.n
    return float(np.abs(m[:k, :k] - np.outer(m[:k, k], m[:k, k]) - np.eye(k)).max())


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every usable row and component."""
    small_batches(rows.sparkSession)
    vectors, length = integer_vectors(rows, vector_col, {id_col: "id"})
    schema = f"id {vectors.schema['id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not length:
        return rows.sparkSession.createDataFrame([], schema)
    fit = stored(vectors.select("x").distinct(), "whitening-fit")
    model = fit_whitening(fit, length, components)
    error = identity_error(fit, model)
    shared = rows.sparkSession.sparkContext.broadcast(model)  # fixed size

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, k = shared.value, len(shared.value.values)
        for b in batches:
            x = _rows(b, "x", length)
            at, which = np.repeat(np.arange(len(x)), k), np.tile(np.arange(k), len(x))
            yield pa.RecordBatch.from_arrays([
                b.column("id").take(pa.array(at)), pa.array((which + 1).astype(np.int32)), pa.array(np.full(len(at), m.n)), pa.array(m.deviation(x), pa.int64()).take(pa.array(at)),
                pa.array(m.apply(x).ravel(), from_pandas=True), pa.array(m.explained[which]), pa.array([error] * len(at), pa.float64()),
            ], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select("id", "x").mapInArrow(project, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
