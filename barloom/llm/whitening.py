"""Whitening of embeddings by a one-sided Jacobi singular value decomposition.

1. Vectors become whole numbers on a grid; the fit list holds each distinct one once, so copies weigh
   nothing, however many there are.
2. Blockwise TSQR: each task factors its centred rows block by block and keeps only the triangle R;
   the triangles of the tasks are merged in a tree.  Row counts never show in their size.
3. Plane rotations make R's columns orthogonal.  Their lengths are the standard deviations (times the
   root of the row count), the accumulated rotations the components.
4. One more pass over the fit list measures how far the whitened covariance is from the identity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import checkpoint, slices

#: Largest grid value; entries beyond it (about 7e13 at 64 steps) count as it.
LARGEST = float(1 << 52)
#: Triangles merged by one task.
FAN = 32


@dataclass
class Whitening:
    """What whitens a vector x: ``(n * x - sums) / n`` times ``components``, each divided by its standard deviation."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray
    identity_error: float


def on_grid(vector: Column, steps: int, offset: int) -> Column:
    """Each entry c as floor(steps * c) + offset; null for a vector that is null or holds a null or non-finite entry."""
    doubles = vector.cast("array<double>")
    sound = F.forall(doubles, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    cell = lambda c: F.floor(F.least(F.greatest(c * float(steps), F.lit(-LARGEST)), F.lit(LARGEST))) + F.lit(offset).cast("long")
    return F.when(F.coalesce(sound, F.lit(False)), F.transform(doubles, cell))


def jacobi(r: np.ndarray, tolerance: float = 1e-15, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns) of ``r``, by falling value.

    A sweep rotates every pair of columns once; the pairs of a round are disjoint and rotated together.
    """
    size = r.shape[1]
    even = size + size % 2
    a = np.zeros((r.shape[0], even))
    a[:, :size] = r
    v = np.eye(even)
    circle = np.arange(even)
    for _ in range(sweeps):
        rotated = False
        for _ in range(even - 1):
            p, q = circle[: even // 2], circle[even // 2 :][::-1]
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            turn = np.abs(gamma) > tolerance * np.sqrt(alpha * beta)
            turn &= gamma != 0
            if turn.any():
                rotated = True
                p, q, gamma = p[turn], q[turn], gamma[turn]
                zeta = (beta[turn] - alpha[turn]) / (2 * gamma)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                c = 1 / np.hypot(1, t)
                s = c * t
                for m in (a, v):
                    x, y = m[:, p].copy(), m[:, q].copy()
                    m[:, p], m[:, q] = c * x - s * y, s * x + c * y
            circle = np.concatenate([circle[:1], circle[-1:], circle[1:-1]])
        if not rotated:
            break
    lengths = np.sqrt((a * a).sum(axis=0))[:size]
    order = np.argsort(-lengths, kind="stable")
    return lengths[order], v[:size, :size][:, order]


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _scaled(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact: in Python's whole numbers where 64 bits don't hold it."""
    bound = n * int(np.abs(x).max(initial=0)) + max((abs(int(s)) for s in sums), default=0)
    return x * n - sums.astype(np.int64) if bound < 1 << 62 else x.astype(object) * n - sums


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (_scaled(x, n, sums) / n).astype(np.float64)


def triangle(points: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the centred rows of ``points`` (column ``_x``)."""
    size = len(sums)

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, size))
        for batch in slices(batches):
            r = np.linalg.qr(np.vstack([r, _centred(_rows(batch.column(0)), n, sums)]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, size))
        for batch in batches:
            for part in batch.column(0).to_pylist():
                r = np.linalg.qr(np.vstack([r, np.frombuffer(part).reshape(-1, size)]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    parts = checkpoint(points.select("_x").mapInArrow(factor, "r binary"))
    while (left := parts.count()) > 1:
        parts = checkpoint(parts.repartition(-(-left // FAN)).mapInArrow(merge, "r binary"))
    return np.frombuffer(parts.first()[0]).reshape(-1, size)


def _identity_error(points: DataFrame, found: Whitening) -> float:
    """Largest absolute entry of the whitened covariance of ``points`` less the identity."""
    size = found.components.shape[1]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros((size, size)), np.zeros(size)
        for batch in slices(batches):
            w = _centred(_rows(batch.column(0)), found.n, found.sums) @ found.components / found.deviations
            total, sums = total + w.T @ w, sums + w.sum(axis=0)
        at = np.arange(size * (size + 1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate([total.ravel(), sums]))], ["at", "value"])

    rows = points.select("_x").mapInArrow(products, "at long, value double").groupBy("at").agg(F.sum("value")).collect()  # components squared
    flat = np.zeros(size * (size + 1))
    for at, value in rows:
        flat[at] = value
    mean = flat[size * size :] / found.n
    return float(np.abs(flat[: size * size].reshape(size, size) / found.n - np.outer(mean, mean) - np.eye(size)).max(initial=0))


def fit(points: DataFrame, components: int, offset: int = 0) -> Whitening | None:
    """The whitening of ``points``, whose column ``_x`` holds distinct vectors of one length; None without vectors.

    Directions along which the points don't differ (a standard deviation that rounding alone explains)
    are no components.
    """
    size = points.agg(F.first(F.size("_x"))).first()[0]
    if not size:
        return None
    # sums of whole numbers without the offset, in decimals: exact for any number of rows
    entries = points.select(F.posexplode("_x").alias("_k", "_v"))
    found = entries.groupBy("_k").agg(F.sum((F.col("_v") - F.lit(offset)).cast("decimal(20,0)")).alias("s"), F.count(F.lit(1)).alias("n")).collect()
    n = found[0]["n"]
    sums = np.array([int(r["s"]) for r in sorted(found, key=lambda r: r["_k"])], object)
    shifted = points.select(F.transform("_x", lambda c: c - F.lit(offset).cast("long")).alias("_x"))
    lengths, axes = jacobi(triangle(shifted, n, sums))
    total = float((lengths**2).sum())
    real = lengths > lengths[:1].max(initial=0) * max(size, 1) * np.finfo(float).eps * 8
    keep = np.flatnonzero(real)[:components]
    axes, lengths = axes[:, keep], lengths[keep]
    if len(keep):
        axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(keep))] < 0, -1.0, 1.0)
    whole = Whitening(n, sums, axes, lengths / np.sqrt(n), lengths**2 / total if total else lengths, 0.0)
    whole.identity_error = _identity_error(shifted, whole) if len(keep) else 0.0
    return whole


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, steps: int = 64, offset: int = 1_000_000) -> DataFrame:
    """A row for each usable row of ``vectors`` and component: id, ``component`` (from 1), ``n``, ``deviation``,
    ``whitened``, ``explained``, ``identity_error``.

    Entries become floor(``steps`` * c) + ``offset``; the fit list holds each distinct vector of the grid once.
    ``deviation`` is the exact sum of (n * x - S) squared, a decimal of 38 digits (null beyond), S being the fit
    list's sums.  ``whitened`` is the centred vector along the component over its standard deviation,
    ``explained`` the component's share of all variance.

    Null vectors and vectors with a null or non-finite entry give no rows; nor do empty ones and those of another
    length than most of the distinct vectors have (of equally frequent lengths the longest counts).  Null and
    repeated ids are kept.  Where all vectors are equal there is no component and no row; there are fewer than
    ``components`` where the vectors don't differ in so many directions.  Other columns are ignored, and an empty
    table gives an empty result.  The driver holds a few matrices of the vectors' length, no rows.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    source = vectors.select(F.col(id_col).alias("_id"), on_grid(F.col(vector_col), steps, offset).alias("_x")).where("size(_x) > 0")
    points = checkpoint(source.select("_x").distinct())
    length = points.groupBy(F.size("_x").alias("_k")).count().orderBy(F.desc("count"), F.desc("_k")).first()
    if length is None:
        return vectors.sparkSession.createDataFrame([], schema)
    same = F.size("_x") == length[0]
    found = fit(points.where(same), components, offset)
    size = found.components.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scaled = _scaled(_rows(batch.column(1)) - offset, found.n, found.sums)
            w = (scaled / found.n).astype(np.float64) @ found.components / found.deviations
            if scaled.dtype != object and scaled.shape[1] * int(np.abs(scaled).max(initial=0)) ** 2 < 1 << 63:
                squares = pa.array((scaled * scaled).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                sums = (scaled.astype(object) ** 2).sum(axis=1)
                squares = pa.array([Decimal(int(x)) if abs(int(x)) < 10**38 else None for x in sums], pa.decimal128(38, 0))
            at = pa.array(np.repeat(np.arange(batch.num_rows), size))
            count = len(at)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at), pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), batch.num_rows)), pa.array(np.full(count, found.n)), squares.take(at),
                    pa.array(w.ravel()), pa.array(np.tile(found.explained, batch.num_rows)), pa.array(np.full(count, found.identity_error)),
                ],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return source.where(same).select("_id", "_x").mapInArrow(run, schema)
