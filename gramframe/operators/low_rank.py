"""Low-rank factors of the kernel over all rows of a table: pivoted incomplete Cholesky, no pair formed.

K ~ L L^T with one row of L per table row. A step takes the row with the largest residual diagonal as pivot (ties:
the smallest key); the trace of the residual bounds the error of every entry of K. A row's factors follow from the pivots
alone (kernel values with them, one forward substitution), so nothing is stored per row between steps.

A pass over the table returns its ``WINDOW`` rows of largest residual. Residuals only fall, so a candidate whose updated
residual still exceeds the smallest one returned is the next pivot for certain; the driver takes pivots from the window
while that holds. The pivots are those of one pass a step, in fewer passes. Only the window and the pivots
(``MAX_RANK`` rows) reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

MAX_RANK = 1024
WINDOW = 64          # rows of largest residual that a pass returns
BLOCK = 2048         # rows of a product
TIE_DIGITS = 10      # residuals are ordered after rounding, so equal rows tie whatever their place in a product
FLOOR = 1e-9         # a residual at or below this is zero


@dataclass(frozen=True)
class SquaredProduct:
    """<u, v>^2"""

    def between(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return (u @ v.T) ** 2

    def diagonal(self, u: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", u, u) ** 2


@dataclass(frozen=True)
class Gaussian:
    """exp(-gamma |u - v|^2)"""

    gamma: float

    def between(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        apart = np.einsum("ij,ij->i", u, u)[:, None] + np.einsum("ij,ij->i", v, v)[None, :] - 2 * u @ v.T
        return np.exp(-self.gamma * np.maximum(apart, 0.0))

    def diagonal(self, u: np.ndarray) -> np.ndarray:
        return np.ones(len(u))


@dataclass
class LowRank:
    """Pivot rows in the order of their steps and ``lower``, their own factors (lower triangular)."""

    kernel: SquaredProduct | Gaussian
    dim: int
    keys: list = field(default_factory=list)
    residuals: list[float] = field(default_factory=list)  # of the pivots when they were taken
    vectors: np.ndarray = None
    lower: np.ndarray = None

    def __post_init__(self):
        if self.vectors is None:
            self.vectors, self.lower = np.zeros((0, self.dim)), np.zeros((0, 0))

    def factors(self, u: np.ndarray) -> np.ndarray:
        """Rows of L of the vectors, by forward substitution."""
        k = self.kernel.between(u, self.vectors)
        out = np.zeros_like(k)
        for j in range(k.shape[1]):
            out[:, j] = (k[:, j] - out[:, :j] @ self.lower[j, :j]) / self.lower[j, j]
        return out

    def residual(self, u: np.ndarray) -> np.ndarray:
        return np.maximum(self.kernel.diagonal(u) - (self.factors(u) ** 2).sum(axis=1), 0.0)

    def add(self, key, vector: np.ndarray, residual: float) -> None:
        row = self.factors(vector[None, :])[0]
        n = len(self.keys)
        lower = np.zeros((n + 1, n + 1))
        lower[:n, :n], lower[n, :n], lower[n, n] = self.lower, row, np.sqrt(residual)
        self.keys.append(key)
        self.residuals.append(residual)
        self.vectors, self.lower = np.vstack([self.vectors, vector]), lower


def _input(rows: DataFrame, key: str, vec: str, dim: int) -> DataFrame:
    whole = F.when((F.size(vec) == dim) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x)) & F.col(key).isNotNull(), F.col(vec))
    whole = whole.otherwise(F.raise_error(F.lit(f"a row needs a key and a vector of {dim} numbers")))
    return rows.select(F.col(key).alias("key"), whole.cast("array<double>").alias("vec"))


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _largest(table: pa.Table, n: int) -> pa.Table:
    return table.take(pc.sort_indices(table, sort_keys=[("rank", "descending"), ("key", "ascending")])[:n])


def _window(rows: DataFrame, model: LowRank, n: int) -> list:
    """The ``n`` rows of largest residual (rank, key, vec, d), largest first, ties by key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for whole in batches:
            for lo in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(lo, BLOCK)
                d = model.residual(_vectors(batch, model.dim))
                own = pa.table({"rank": np.round(d, TIE_DIGITS), "key": batch.column(0), "vec": batch.column(1), "d": d})
                best = _largest(own if best is None else pa.concat_tables([best, own.cast(best.schema)]), n)
        if best is not None:
            yield from best.combine_chunks().to_batches()
    kind = rows.schema["key"].dataType.simpleString()
    top = rows.mapInArrow(run, f"rank double, key {kind}, vec array<double>, d double")
    return top.orderBy(F.desc("rank"), "key").limit(n).collect()  # n rows


def fit(rows: DataFrame, key: str, vec: str, dim: int, kernel: SquaredProduct | Gaussian, rank: int, tolerance: float = 0.0) -> LowRank:
    """Pivots until ``rank`` steps are made or no residual exceeds ``tolerance``. ``rows`` is read once a pass. An empty
    table gives rank 0; a row without key or with a vector of another length, a null or NaN entry is an error."""
    if not 1 <= rank <= MAX_RANK:
        raise ValueError(f"rank 1 to {MAX_RANK}, got {rank}")
    rows, model = _input(rows, key, vec, dim), LowRank(kernel, dim)
    while len(model.keys) < rank:
        window = _window(rows, model, WINDOW)
        if not window or window[0]["rank"] <= max(tolerance, FLOOR):
            break
        vectors = np.array([r["vec"] for r in window])
        bound = window[-1]["rank"] if len(window) == WINDOW else -1.0  # of all rows outside the window
        first = True
        while len(model.keys) < rank:
            d = np.array([r["d"] for r in window]) if first else model.residual(vectors)
            ranked = np.round(d, TIE_DIGITS)
            at = min(range(len(window)), key=lambda i: (-ranked[i], window[i]["key"]))
            if ranked[at] <= max(tolerance, FLOOR) or not (first or ranked[at] > bound):
                break
            model.add(window[at]["key"], vectors[at], float(d[at]))
            first = False
    return model


def factors(rows: DataFrame, key: str, vec: str, model: LowRank) -> DataFrame:
    """(key, factors array<double>, residual): one row per row of ``rows``; K(x, y) is about the product of two rows'
    factors, off by at most the root of the product of their residuals."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(lo, BLOCK)
                u = _vectors(batch, model.dim)
                f = model.factors(u)
                flat = pa.ListArray.from_arrays(np.arange(len(f) + 1, dtype=np.int32) * f.shape[1], pa.array(f.reshape(-1)))
                left = np.maximum(model.kernel.diagonal(u) - (f ** 2).sum(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0), flat, pa.array(left)], ["key", "factors", "residual"])
    own = _input(rows, key, vec, model.dim)
    kind = own.schema["key"].dataType.simpleString()
    return own.mapInArrow(run, f"key {kind}, factors array<double>, residual double").withColumnRenamed("key", key)


def steps(rows: DataFrame, key: str, vec: str, model: LowRank) -> DataFrame:
    """(step, key, pivot_residual, trace, residual_trace): what every step leaves of the trace over all rows, from one pass."""
    spark = rows.sparkSession
    own = factors(rows, key, vec, model).select(F.posexplode(F.concat(F.col("factors"), F.array(F.sqrt("residual")))).alias("i", "v"))
    shares = cut_lineage(own.groupBy("i").agg(F.sum(F.col("v") * F.col("v")).alias("share")))  # rank + 1 rows
    trace = shares.agg(F.sum("share").alias("trace"))
    pivots = spark.createDataFrame([(i, k, d) for i, (k, d) in enumerate(zip(model.keys, model.residuals))],
                                   f"i int, `{key}` {rows.schema[key].dataType.simpleString()}, pivot_residual double")
    later = shares.select(F.col("i").alias("j"), "share")
    left = pivots.join(F.broadcast(later), F.col("j") > F.col("i")).groupBy("i", key, "pivot_residual").agg(F.sum("share").alias("residual_trace"))
    return left.crossJoin(F.broadcast(trace)).select((F.col("i") + 1).alias("step"), key, "pivot_residual", "trace", "residual_trace")  # trace: one row
