"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on
the triangular factor.

Entries become long x = floor(256 c). The fit list holds each distinct x vector once (a
``distinct`` with partial aggregation, so a vector held by a third of all rows costs one row
a task). Two passes over it, each reduced inside the tasks to one small row set, give the
per-dimension sums S (exact) and the scatter sum((x - S/n)(x - S/n)^T) / n, centred before
multiplying. What reaches the driver has a size fixed by the dimension d: d sums and
d (d + 1) / 2 scatter cells.

The covariance V = P L L^T P^T by Cholesky with diagonal pivoting; it stops at the numeric
rank. One-sided Jacobi rotates the columns of L until they are orthogonal: L R = U D, so the
rotated columns' squared norms are the eigenvalues of V and the normalised columns, rows put
back in order, its eigenvectors. The rotations of one round touch disjoint column pairs and
run as one array operation.

Defined cases: rows whose vector is null, broken or of another length than most take no part
and give no rows (vectors.usable). Repeated rows and null ids are kept, each with its own
output rows. Components exist up to the rank of V: with one distinct vector, equal vectors
or an empty table no row is returned. Tied eigenvalues: any orthonormal basis of their
space, the same for all rows. ``deviation`` is exact, null beyond long's range. Input columns
other than id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import vectors
from tidewell.llm.common import staged

LONG = 1 << 63


@dataclass(frozen=True)
class Whitening:
    """Fitted model: ``n`` fit vectors, exact sums, unit components as columns, eigenvalues,
    their share of the trace, and the measured error of the whitened covariance."""
    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with v[order][:, order] = L L^T; L has one column per pivot above rounding."""
    a = np.array(v, dtype=np.float64)
    d = len(a)
    order = np.arange(d)
    left = a.diagonal().copy()
    floor = d * np.finfo(float).eps * max(left.max(initial=0.0), 0.0)
    cols = np.zeros((d, d))
    for k in range(d):
        p = k + int(np.argmax(left[k:]))
        if left[p] <= floor:
            return cols[:, :k], order
        order[[k, p]] = order[[p, k]]
        left[[k, p]] = left[[p, k]]
        cols[[k, p]] = cols[[p, k]]
        cols[k, k] = np.sqrt(left[k])
        rest = order[k + 1:]
        cols[k + 1:, k] = (a[rest, order[k]] - cols[k + 1:, :k] @ cols[k, :k]) / cols[k, k]
        left[k + 1:] -= cols[k + 1:, k] ** 2
    return cols, order


def rotated_columns(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """One-sided Jacobi: the columns of ``factor`` rotated until every pair is orthogonal to
    rounding. A round-robin plan meets each pair once a sweep in rounds of disjoint pairs."""
    g = np.array(factor, dtype=np.float64)
    k = g.shape[1]
    if k < 2:
        return g
    seats = list(range(k + k % 2))                       # an odd count sits one out a round
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = [(i, j) for i, j in zip(seats[:half], reversed(seats[half:])) if i < k and j < k]
            i, j = (np.array(s) for s in zip(*pairs))
            a, b = g[:, i], g[:, j]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            size = np.sqrt(aa * bb)
            turn = np.abs(ab) > 1e-15 * size
            worst = max(worst, float(np.max(np.abs(ab) / np.where(size > 0, size, 1.0))))
            if turn.any():
                i, j, a, b = i[turn], j[turn], a[:, turn], b[:, turn]
                zeta = (bb[turn] - aa[turn]) / (2 * ab[turn])
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                g[:, i], g[:, j] = c * a - c * t * b, c * t * a + c * b
            seats = [seats[0], seats[-1], *seats[1:-1]]
        if worst <= 1e-14:
            break
    return g


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a covariance, falling, and unit eigenvectors as columns, up to its rank."""
    factor, order = pivoted_cholesky(v)
    g = rotated_columns(factor)
    norms = np.sqrt((g * g).sum(0))
    by_size = np.argsort(-norms, kind="stable")
    unit = np.zeros_like(g)
    unit[order] = g / np.where(norms > 0, norms, 1.0)
    return norms[by_size] ** 2, unit[:, by_size]


def _sums(fit: DataFrame, d: int) -> list[int]:
    """Exact sums per dimension: low and high 32 bits are summed apart, so no batch overflows."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for b in batches:
            x = vectors.matrix(b.column(0), d, np.int64)
            high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
            total = [t + (int(h) << 32) + int(s) for t, h, s in zip(total, high, low)]
        yield pa.record_batch({"i": pa.array(range(d), pa.int32()),
                               "s": pa.array([str(t) for t in total], pa.string())})
    parts = fit.mapInArrow(partial, "i int, s string").groupBy("i").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    got = {r["i"]: int(r["s"]) for r in parts.collect()}
    return [got.get(i, 0) for i in range(d)]


def _products(fit: DataFrame, column: str, width: int, of) -> np.ndarray:
    """sum(y y^T) over the rows y = of(batch), reduced inside each task, then by cell."""
    upper = np.triu_indices(width)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            y = of(b.column(0))
            total += y.T @ y
        yield pa.record_batch({"i": pa.array(upper[0], pa.int32()), "j": pa.array(upper[1], pa.int32()),
                               "s": pa.array(total[upper], pa.float64())})
    cells = (fit.select(column).mapInArrow(partial, "i int, j int, s double")
             .groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas())
    out = np.zeros((width, width))
    out[cells["i"], cells["j"]] = cells["s"]
    out[cells["j"], cells["i"]] = cells["s"]
    return out


def fit(rows: DataFrame, components: int = 4) -> Whitening | None:
    """Model of the distinct vectors in ``x`` (array<long> of one length); None without any."""
    distinct = staged(rows.select("x").distinct())
    n = distinct.count()
    if n == 0:
        return None
    d = len(distinct.first()["x"])
    sums = _sums(distinct, d)
    mean = np.array([s / n for s in sums])

    def centred(column):
        return vectors.matrix(column, d) - mean

    v = _products(distinct, "x", d, centred) / n
    values, unit = eigen(v)
    kept = min(components, len(values))
    values, unit = values[:kept], unit[:, :kept]
    error = 0.0
    if kept:
        scale = unit / np.sqrt(values)

        def whitened_and_one(column):
            y = centred(column) @ scale
            return np.column_stack([y, np.ones(len(y))])

        second = _products(distinct, "x", kept + 1, whitened_and_one) / n
        middle = second[kept, :kept]
        error = float(np.abs(second[:kept, :kept] - np.outer(middle, middle) - np.eye(kept)).max())
    trace = float(np.trace(v))
    return Whitening(n, tuple(sums), unit, values, values / trace if trace > 0 else values, error)


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """``id``, ``deviation`` (sum of (n x - S)^2) and ``whitened`` (array, a value per component)
    of each row of ``id, x``."""
    d, n, sums = len(model.sums), model.n, model.sums
    mean = np.array([s / n for s in sums])
    scale = model.components / np.sqrt(model.eigenvalues)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = [int(s) for s in sums]
        for b in batches:
            x = vectors.matrix(b.column(1), d, np.int64)
            reach = max((abs(int(x.min())), abs(int(x.max()))), default=0) if x.size else 0
            reach = n * reach + max((abs(s) for s in centre), default=0)
            if d * reach * reach < LONG:
                deviation = ((n * x - np.array(centre, np.int64)) ** 2).sum(1).tolist()
            else:                                        # beyond 64 bits: exact Python integers
                deviation = [sum((n * int(e) - s) ** 2 for e, s in zip(row, centre)) for row in x]
            y = (x - mean) @ scale
            yield pa.record_batch([
                b.column(0),
                pa.array([v if v < LONG else None for v in deviation], pa.int64()),
                pa.array(list(y), pa.list_(pa.float64()))], names=["id", "deviation", "whitened"])

    return rows.select("id", "x").mapInArrow(apply, f"id {rows.schema['id'].dataType.simpleString()}, "
                                                    "deviation long, whitened array<double>")


def whiten(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
           components: int = 4) -> DataFrame:
    """A row per usable input row and component: the id column, ``component`` (from 1), ``n``,
    ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    rows = vectors.usable(df, vector_column, id=F.col(f"`{id_column}`")).select(
        "id", vectors.quantised().alias("x"))
    model = fit(rows, components)
    if model is None or len(model.eigenvalues) == 0:
        return df.select(F.col(f"`{id_column}`"), F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"),
                         F.lit(0).cast("long").alias("deviation"), F.lit(0.0).alias("whitened"),
                         F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error")).where(F.lit(False))
    share = F.array(*[F.lit(float(e)) for e in model.explained])
    long = transform(rows, model).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select(F.col("id").alias(id_column), (F.col("at") + 1).alias("component"),
                       F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(share, F.col("at")).alias("explained"),
                       F.lit(model.identity_error).alias("identity_error"))
