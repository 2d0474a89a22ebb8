"""Operator 13, embedding whitening by spectral divide and conquer with QDWH polar decompositions.

Entries c become integers x = floor(64 c) + 1000000. One pass sums them exactly, one pass sums the products
of the centred vectors: a task sends the upper triangle of its d x d matrix, so the number of rows
shuffled is tasks x d (d + 1) / 2 and nothing grows with the table on one machine. The d x d covariance is the
only thing that reaches the driver. It is split there: the unitary polar factor U of V - s I, found by dynamically
weighted Halley iterations (QDWH), gives the spectral projector (I + U) / 2 on the eigenvalues above s;
orthonormal bases of its range and of its complement turn V into two smaller blocks, which are split again
until a block is one number or diagonal. The whitening matrix (d x ``COMPONENTS``) is broadcast; one more
pass measures the covariance of the whitened rows, and the last one returns them.

Vectors are centred by the integer part of the mean first (exact), then by its fraction.

Defined results: vectors that are null or hold null or non-finite entries, or entries whose 64-fold reaches 2^62, take
no part; vectors shorter than the longest are padded with zeros (x = 1000000); a null id is returned as null; repeated rows are
separate rows; a component whose eigenvalue is zero to double precision has whitened null and does not enter
identity_error; explained is null where the trace is 0 and identity_error where no component is left; a deviation
beyond 2^63 - 1 is null; an empty table gives no rows. Only the id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
ROWS = 2048  # rows of a matrix in a task
EPS = float(np.finfo(np.float64).eps)
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# ------------------------------------------------------------------ spectral divide and conquer
def polar_factor(a: np.ndarray) -> np.ndarray:
    """The unitary polar factor of a symmetric matrix, by QDWH. Singular values below 1e-15 of the
    norm may not have converged; the caller checks."""
    n = len(a)
    x = a / max(np.abs(a).sum(axis=1).max(), np.finfo(np.float64).tiny)
    eye, low = np.eye(n), 1e-15
    for _ in range(20):
        sq = low * low
        d = np.cbrt(4 * (1 - sq) / (sq * sq))
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(8 - 4 * d + 8 * (2 - sq) / (sq * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:  # far from converged: the form that needs no inverse
            q, _ = np.linalg.qr(np.concatenate([np.sqrt(wc) * x, eye]))
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        else:
            z = np.linalg.solve(eye + wc * x.T @ x, x.T).T
            new = wb / wc * x + (wa - wb / wc) * z
        new = (new + new.T) / 2
        moved = np.abs(new - x).max()
        x, low = new, min(1.0, low * (wa + wb * sq) / (1 + wc * sq))
        if 1 - low < 10 * EPS and moved < 1e-10:
            break
    return x


def _bases(projector: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal columns, the first k spanning the projector's range."""
    n = len(projector)
    rest = np.eye(n) - projector
    q, _ = np.linalg.qr(projector @ rng.standard_normal((n, k)))
    q, _ = np.linalg.qr(projector @ q)
    p, _ = np.linalg.qr(rest @ rng.standard_normal((n, n - k)))
    p, _ = np.linalg.qr(rest @ p)
    both, r = np.linalg.qr(np.concatenate([q, p], axis=1))
    return both * np.where(np.diag(r) < 0, -1.0, 1.0)


def spectrum(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues from the largest, unit eigenvectors as columns) of a symmetric matrix."""
    rng = np.random.default_rng(20)
    size = np.linalg.norm(v)
    vectors = np.eye(len(v))
    open_ = [(0, len(v), v)]
    while open_:
        lo, hi, a = open_.pop()
        m = hi - lo
        middle = np.trace(a) / m
        spread = np.linalg.norm(a - middle * np.eye(m)) / np.sqrt(m)
        if np.linalg.norm(a - np.diag(np.diag(a))) <= EPS * size:
            continue  # the block's axes are its components
        best = None
        # the mean of the eigenvalues has some on both sides; other shifts where one lies on it
        for step in (0.0, 0.11, -0.17, 0.29, -0.41, 0.53, -0.67):
            projector = (np.eye(m) + polar_factor(a - (middle + step * spread) * np.eye(m))) / 2
            k = int(round(np.trace(projector)))
            if not 0 < k < m:
                continue
            q = _bases(projector, k, rng)
            b = q.T @ a @ q
            left = np.linalg.norm(b[:k, k:])
            if best is None or left < best[0]:
                best = left, k, q, b
            if left <= 4 * EPS * size:
                break
        if best is None:
            raise ArithmeticError("no shift separates the block's eigenvalues")
        _, k, q, b = best
        vectors[:, lo:hi] = vectors[:, lo:hi] @ q
        b = (b + b.T) / 2
        open_ += [(lo, lo + k, b[:k, :k]), (lo + k, hi, b[k:, k:])]
    values = ((v @ vectors) * vectors).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# ------------------------------------------------------------------ passes over the table
def usable(vec: Column) -> Column:
    return vec.isNotNull() & F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * SCALE < F.lit(2.0 ** 62)))


def _matrices(batches: Iterator[pa.RecordBatch], dims: int | None = None) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, x, sizes) of up to ROWS rows at a time; absent entries are those of c = 0."""
    for whole in batches:
        for lo in range(0, whole.num_rows, ROWS):
            batch = whole.slice(lo, ROWS)
            vec = batch.column("v")
            sizes = np.diff(vec.offsets.to_numpy())
            x = np.full((len(sizes), dims if dims is not None else int(sizes.max(initial=0))), OFFSET, np.int64)
            values = np.floor(vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).astype(np.int64) + OFFSET
            x[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
            yield batch.column("vec_id"), x, sizes


class Fit:
    """Exact sums of the fit list: ``n``, ``sums`` per dimension, the mean as ``whole`` + ``rest`` / n."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = [s % n for s in sums]

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - np.array([r / self.n for r in self.rest])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum over the dimensions of (n x - S)^2, exact; None beyond 2^63 - 1."""
        near = x - self.whole
        most = self.n * (int(np.abs(near).max(initial=0)) + 1)
        if most * most * max(1, x.shape[1]) < 1 << 63:
            return ((self.n * near - np.array(self.rest, np.int64)) ** 2).sum(axis=1).tolist()
        out = [sum((self.n * a - r) ** 2 for a, r in zip(row, self.rest)) for row in near.tolist()]
        return [t if t < 1 << 63 else None for t in out]


def fit(rows: DataFrame) -> Fit | None:
    """Sums over all vectors ``v``; None for an empty table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, have, sums = 0, [0], [0]
        for _, x, sizes in _matrices(batches):
            n += len(x)
            more = x.shape[1] - len(sums)
            have, sums = have + [0] * more, sums + [0] * more
            # 32-bit halves: no sum of a matrix can overflow
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            for j in range(x.shape[1]):
                absent = int((sizes <= j).sum())
                have[j] += len(x) - absent
                sums[j] += (high[j] << 32) + low[j] - absent * OFFSET
        at = [j for j in range(len(sums)) if have[j]]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int32()), pa.array([n, *[have[j] for j in at]], pa.int64()),
                                          pa.array(["0", *[str(sums[j]) for j in at]])], ["dim", "n", "total"])
    got = rows.mapInArrow(run, "dim int, n long, total string").groupBy("dim").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # a row per dimension
    by_dim = {r["dim"]: r for r in got}
    n = by_dim[-1]["n"] if -1 in by_dim else 0
    if not n:
        return None
    sums = [0] * (max(by_dim) + 1)
    for j in range(len(sums)):
        r = by_dim.get(j)
        sums[j] = (int(r["total"]) + (n - r["n"]) * OFFSET) if r else n * OFFSET
    return Fit(n, sums)


def second_moments(rows: DataFrame, dims: int, width: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of y y^T for y = of(x) with ``width`` entries."""
    i, j = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for _, x, _ in _matrices(batches, dims):
            y = of(x)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "s"])
    got = rows.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()  # width^2 / 2 rows
    out = np.zeros((width, width))
    a, b, s = (got.column(c).to_numpy() for c in ("i", "j", "s"))
    out[a, b] = out[b, a] = s
    return out


def whiten(table: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows of SCHEMA: every remaining row of ``table`` with each of its components, from the largest eigenvalue."""
    spark = table.sparkSession
    vec = F.col(f"`{vec_col}`")
    rows = table.where(usable(vec)).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vec.alias("v"))
    known = fit(rows)
    dims = len(known.sums) if known else 0
    if not dims:
        return spark.createDataFrame([], SCHEMA)
    v = second_moments(rows, dims, dims, known.centred) / known.n
    values, vectors = spectrum(v)
    width = min(components, dims)
    some = values[:width] > dims * EPS * max(values[0], 0.0)
    matrix = np.where(some, vectors[:, :width] / np.sqrt(np.where(some, values[:width], 1.0)), 0.0)
    shared = spark.sparkContext.broadcast((known, matrix))  # dims x components numbers

    def project(x: np.ndarray) -> np.ndarray:
        fitted, w = shared.value
        return fitted.centred(x) @ w
    error = np.abs(second_moments(rows, dims, width, project) / known.n - np.eye(width))[np.ix_(some, some)].max(initial=0.0)
    error = float(error) if some.any() else None
    trace = float(np.trace(v))
    explained = [float(e) / trace if trace > 0 else None for e in values[:width]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, _ in _matrices(batches, dims):
            n = len(x)
            y = project(x).reshape(-1)
            row = pa.array(np.repeat(np.arange(n), width))
            yield pa.RecordBatch.from_arrays([
                ids.take(row), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), n)), pa.array(np.full(n * width, known.n)),
                pa.array(known.deviations(x), pa.int64()).take(row), pa.array(y, mask=~np.tile(some, n)),
                pa.array(explained * n, pa.float64()), pa.array([error] * (n * width), pa.float64())],
                [f.split()[0] for f in SCHEMA.split(", ")])
    return rows.mapInArrow(run, SCHEMA)
