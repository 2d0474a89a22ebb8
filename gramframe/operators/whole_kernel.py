"""Statistics of the kernel <u, v>^2 over all pairs of a whole table, without forming a pair.

For a set of vectors with second moments M = sum u u^T, the sum of <u_i, v_j>^2 over all pairs of two sets is
the inner product of their moment matrices. For fourth powers the same holds for the moments of
the products s = (u_a u_b), so ||K||_F^2 is the squared norm of G = sum s s^T. One pass accumulates both in every
task; a task sends one packed row per matrix row, Spark adds them up row by row, and only scalars remain. The cost is
rows x d^4 / 8 multiplications in blocked products and d^4 / 4 numbers a task, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DIM = 96            # G of 96 dimensions holds 4,656 x 4,656 doubles, 173 MB in a task
BLOCK = 2048            # rows per product


def _products(u: np.ndarray) -> np.ndarray:
    """The entries of u u^T on and above the diagonal, weighted so that <s, t> = <u, v>^2."""
    a, b = np.triu_indices(u.shape[1])
    return u[:, a] * u[:, b] * np.where(a == b, 1.0, np.sqrt(2.0))


def _moments(rows: DataFrame, vec_col: str, label: str, dim: int) -> DataFrame:
    """(part, row, label, v): part 0 the rows of each class's M, part 1 the rows of G on and right of the diagonal."""
    width = dim * (dim + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_class: dict[int, np.ndarray] = {}
        fourth = np.zeros((width, width))
        for whole in batches:
            for lo in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(lo, BLOCK)
                u = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                y = batch.column(1).to_numpy(zero_copy_only=False)
                for c in np.unique(y).tolist():
                    own = u[y == c]
                    by_class[c] = by_class.get(c, 0.0) + own.T @ own
                s = _products(u)
                fourth += s.T @ s
        if by_class:
            part = [(0, i, c, m[i].tobytes()) for c, m in by_class.items() for i in range(dim)]
            part += [(1, i, 0, fourth[i, i:].tobytes()) for i in range(width)]
            for lo in range(0, len(part), 512):
                own = part[lo:lo + 512]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in own], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))],
                                                 ["part", "row", "label", "v"])
    vec = F.when(F.size(vec_col) == dim, F.col(vec_col)).otherwise(F.raise_error(F.lit(f"vector length differs from {dim}")))
    return rows.select(vec.cast("array<double>").alias("u"), F.col(label).cast("int").alias("y")).mapInArrow(run, "part int, row int, label int, v binary")


def _row_norms(key: tuple, table: pa.Table) -> pa.Table:
    """Of one matrix row summed over the tasks: sum over classes of its squared norm, squared norm of the sum."""
    labels, blobs = table.column("label").to_pylist(), table.column("v").to_pylist()
    sums: dict[int, np.ndarray] = {}
    for c, blob in sorted(zip(labels, blobs)):
        sums[c] = sums.get(c, 0.0) + np.frombuffer(blob)
    whole = sum(sums.values())
    if key[0].as_py() == 1:  # a row of a symmetric matrix from its diagonal entry on
        whole = whole * np.where(np.arange(len(whole)) == 0, 1.0, np.sqrt(2.0))
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "same": [float(sum(v @ v for v in sums.values()))], "all": [float(whole @ whole)]})


def vector_kernel_diagnostics(rows: DataFrame, vec_col: str, label: str, dim: int) -> DataFrame:
    """One row: n, within / between class means off the diagonal (0.0 for an empty set), separation, off-diagonal mean,
    alignment sum(K T) / (||K||_F n) with T = +-1, trace, ||K||_F^2 and participation ratio, of K = <u, v>^2 over all pairs
    of ``rows``. Rows without vector or label are an error."""
    if not 1 <= dim <= MAX_DIM:
        raise ValueError(f"vectors of 1 to {MAX_DIM} dimensions, got {dim}")
    norms = _moments(rows, vec_col, label, dim).groupBy("part", "row").applyInArrow(_row_norms, "part int, same double, all double")
    sums = norms.agg(F.sum(F.when(F.col("part") == 0, F.col("same"))).alias("same"), F.sum(F.when(F.col("part") == 0, F.col("all"))).alias("total"),
                     F.sum(F.when(F.col("part") == 1, F.col("all"))).alias("frobenius2"))
    square = F.aggregate(vec_col, F.lit(0.0), lambda t, x: t + x * x)
    per_class = rows.select(F.col(label).alias("c"), (square * square).alias("d")).groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("d"))
    sizes = per_class.agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), F.sum("d").alias("trace"))
    n = F.col("n").cast("double")
    within = F.coalesce(F.try_divide(F.col("same") - F.col("trace"), F.col("nn") - n), F.lit(0.0))
    between = F.coalesce(F.try_divide(F.col("total") - F.col("same"), n * n - F.col("nn")), F.lit(0.0))
    return sums.crossJoin(F.broadcast(sizes)).select(  # one row each
        "n", within.alias("within_class_mean"), between.alias("between_class_mean"), (within - between).alias("separation"),
        F.try_divide(F.col("total") - F.col("trace"), n * (n - 1)).alias("off_diagonal_mean"),
        F.try_divide(2 * F.col("same") - F.col("total"), F.sqrt("frobenius2") * n).alias("kernel_target_alignment"),
        "trace", "frobenius2", F.try_divide(F.col("trace") * F.col("trace"), F.col("frobenius2")).alias("participation_ratio"))
