"""Whitening of embeddings by a streaming covariance.

The entries of a vector become integers; each distinct integer vector counts once in the
fit.  A task streams over its share of the distinct vectors and updates number, mean and
scatter matrix row by row (Welford: one rank-one update a vector).  The states of the tasks,
one matrix each, are merged pairwise by the parallel update formula, in rounds of FAN
states a task, until one is left; only that one, whose size is the square of the number of
dimensions, reaches the driver.  There Householder reflections make it tridiagonal and the
QR algorithm with implicit shifts solves it.

Defined cases: a row whose vector is null, empty, holds a null or non-finite entry or one
whose integer does not fit in 64 bits gives no result; of the other rows those count whose
vectors have the most frequent length (the greater of equally frequent ones), the rest gives
no result.  Components whose eigenvalue is not above rounding noise are left out, so one
distinct vector gives no rows.  Rows that repeat, with the same or another id, repeat their
results; a null id stays null.  A deviation that does not fit in 64 bits is an error.  An
empty table gives an empty result; only the id and the vector are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import Scratch, bound_batches

#: An entry c counts as floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components that are reported at most.
COMPONENTS = 16
#: States that a task merges in a round.
FAN = 8

_STATE = "part long, n long, sums array<string>, mean array<double>, scatter array<double>"


# --------------------------------------------------------------------------- moments


class Moments:
    """Number, exact sums, mean and scatter matrix (sum of centred products) of some vectors."""

    def __init__(self, dims: int):
        self.n, self.sums = 0, [0] * dims
        self.mean, self.scatter = np.zeros(dims), np.zeros((dims, dims))

    def add(self, vectors: np.ndarray) -> None:
        """Welford's update, a vector at a time; int64 vectors have their sums kept exactly."""
        if vectors.dtype == np.int64:
            high, low = (vectors >> 32).sum(0), (vectors & 0xFFFFFFFF).sum(0)
            self.sums = [s + (int(h) << 32) + int(x) for s, h, x in zip(self.sums, high, low, strict=True)]
        for x in vectors.astype(np.float64):
            self.n += 1
            before = x - self.mean
            self.mean += before / self.n
            self.scatter += np.outer(before, x - self.mean)

    def merge(self, other: Moments) -> None:
        """The parallel update: the state of both sets of vectors together."""
        if not other.n:
            return
        n = self.n + other.n
        apart = other.mean - self.mean
        self.mean = self.mean + apart * (other.n / n)
        self.scatter = self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n)
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        self.n = n

    def covariance(self) -> np.ndarray:
        return (self.scatter + self.scatter.T) / (2 * self.n)

    def row(self, part: int) -> pa.RecordBatch:
        lists = (pa.array([x]) for x in ([str(s) for s in self.sums], self.mean.tolist(), self.scatter.ravel().tolist()))
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([self.n]), *lists], names=["part", "n", "sums", "mean", "scatter"])

    @staticmethod
    def of(row: dict) -> Moments:
        found = Moments(len(row["mean"]))
        found.n, found.sums = row["n"], [int(x) for x in row["sums"]]
        found.mean, found.scatter = np.array(row["mean"]), np.array(row["scatter"]).reshape(found.scatter.shape)
        return found


def _vectors(column: pa.Array, kind: type = np.int64) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), kind)


def _merged(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    total = Moments.of(rows[0])
    for row in rows[1:]:
        total.merge(Moments.of(row))
    return pa.Table.from_batches([total.row(rows[0]["part"] // FAN)])


def moments(vectors: DataFrame, dims: int, scratch: Scratch, name: str, project=None) -> Moments:
    """The moments of column ``x``, of ``dims`` entries, or of what ``project`` makes of a block of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state = None
        for batch in batches:
            if batch.num_rows:
                block = _vectors(batch.column(0)) - SHIFT
                block = project(block) if project else block
                state = state or Moments(block.shape[1])
                state.add(block)
        if state:
            yield state.row(TaskContext.get().partitionId())

    states = scratch.write(vectors.select("x").mapInArrow(run, _STATE), f"{name}_0")
    turn = 0
    while (left := states.count()) > 1:
        turn += 1
        # A merged state takes the number of its group, so that the next round groups anew.
        groups = states.groupBy((F.col("part") / FAN).cast("long").alias("group"))
        states = scratch.write(groups.applyInArrow(_merged, _STATE), f"{name}_{turn}")
        scratch.drop(f"{name}_{turn - 1}")
    found = states.first()
    return Moments.of(found.asDict()) if left else Moments(dims)


# --------------------------------------------------------------------------- eigenvectors


def _tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and the orthogonal q with q.T @ matrix @ q tridiagonal, by Householder reflections."""
    a, n = matrix.copy(), len(matrix)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if length == 0 or not np.any(v[1:]):
            continue
        v[0] += math.copysign(length, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, :] -= 2 * np.outer(v, v @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and the unit eigenvectors as columns, of a symmetric matrix.

    QR steps with Wilkinson's shift chase a bulge down the tridiagonal form; where an entry
    beside the diagonal vanishes, the matrix falls apart.
    """
    d, e, q = _tridiagonal(matrix)
    n = len(d)
    end = n - 1
    for _ in range(60 * n):
        tiny = np.finfo(float).eps * (np.abs(d[:-1]) + np.abs(d[1:]))
        e[np.abs(e) <= tiny] = 0.0
        while end > 0 and e[end - 1] == 0:
            end -= 1
        if end <= 0:
            break
        begin = end - 1
        while begin > 0 and e[begin - 1] != 0:
            begin -= 1
        half = (d[end - 1] - d[end]) / 2
        shift = d[end] - e[end - 1] ** 2 / (half + math.copysign(math.hypot(half, e[end - 1]), half))
        x, z = d[begin] - shift, e[begin]
        for k in range(begin, end):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > begin:
                e[k - 1] = r
            a, b, f = d[k], d[k + 1], e[k]
            d[k] = c * c * a + 2 * c * s * f + s * s * b
            d[k + 1] = s * s * a - 2 * c * s * f + c * c * b
            e[k] = c * s * (b - a) + (c * c - s * s) * f
            if k + 1 < end:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            left, right = q[:, k].copy(), q[:, k + 1]
            q[:, k], q[:, k + 1] = c * left + s * right, c * right - s * left
    order = np.argsort(-d, kind="stable")
    return d[order], q[:, order]


# --------------------------------------------------------------------------- whitening


@dataclass
class Whitening:
    """What a fit gives: sums and number of the fit list, components as columns, their eigenvalues and shares."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def project(self, vectors: np.ndarray) -> np.ndarray:
        """Whitened coordinates of integer vectors, from exact differences to the mean."""
        return self._deviations(vectors)[0] @ self.components / np.sqrt(self.values)

    def _deviations(self, vectors: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """x - S/n, and the sums over dimensions of (n*x - S)**2; vectors and S less the shift."""
        sums = [s - self.n * SHIFT for s in self.sums]
        most = max(int(np.abs(vectors).max(initial=0)), 1) * self.n + max(map(abs, sums), default=0)
        whole = vectors if len(sums) * most * most < 1 << 63 else vectors.astype(object)
        apart = whole * self.n - np.array(sums, whole.dtype)
        squares = (apart * apart).sum(1)
        return (apart / self.n).astype(np.float64), [int(x) for x in squares]


def _integers(vector: str) -> Column:
    limit = float(1 << 62)
    whole = F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(c * SCALE))
    fits = F.forall(F.col(vector).cast("array<double>"), lambda c: F.coalesce(c * SCALE > -limit, F.lit(False)) & (c * SCALE < limit))
    # NaN is greater than all else in Spark, so it fails the second comparison.
    return F.when(fits, F.transform(whole, lambda c: c.cast("long") + SHIFT))


def integer_vectors(table: DataFrame, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """row_id and x, the integers, of the rows that take part."""
    rows = table.select(F.col(row_id).cast("long").alias("vec_id"), _integers(vector).alias("x")).where("size(x) > 0")
    usual = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    return rows.where(F.size("x") == (usual["dims"] if usual else 0))


def fit(rows: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of integer_vectors(); none without rows."""
    scratch = Scratch(rows.sparkSession, "whitening")
    distinct = scratch.write(rows.select("x").distinct().sortWithinPartitions("x"), "distinct")
    first = distinct.first()
    if first is None:
        return None
    state = moments(distinct, len(first["x"]), scratch, "fit")
    values, vectors = symmetric_qr(state.covariance())
    trace = float(np.trace(state.covariance()))
    kept = np.flatnonzero(values > trace * len(values) * np.finfo(float).eps)[:most]
    vectors = vectors[:, kept] * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(values))] < 0, -1.0, 1.0)[kept]
    sums = [s + state.n * SHIFT for s in state.sums]
    found = Whitening(state.n, sums, vectors, values[kept], values[kept] / trace if len(kept) else values[kept])
    if len(kept):
        white = moments(distinct, len(kept), scratch, "white", found.project)
        found.identity_error = float(np.abs(white.covariance() - np.eye(len(kept))).max())
    return found


def whiten(table: DataFrame, row_id: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each row and component."""
    spark = table.sparkSession
    bound_batches(spark)
    rows = integer_vectors(table, row_id, vector)
    model = fit(rows, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = len(model.values) if model else 0
            if not batch.num_rows or not k:
                continue
            apart, squares = model._deviations(_vectors(batch.column(1)) - SHIFT)
            white = apart @ model.components / np.sqrt(model.values)
            n = batch.num_rows
            again = pa.array(np.repeat(np.arange(n), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(again),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * k, model.n)),
                    pa.array(squares, pa.int64()).take(again),
                    pa.array(white.ravel()),
                    pa.array(np.tile(model.explained, n)),
                    pa.array(np.full(n * k, model.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
