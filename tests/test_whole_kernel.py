"""Kernel statistics from moments against the full matrix."""

from __future__ import annotations

import math

import numpy as np
import pytest


@pytest.mark.parametrize("classes", [1, 2, 3])
def test_diagnostics_equal_the_pair_definition(spark, classes):
    from gramframe.operators.whole_kernel import vector_kernel_diagnostics
    rng = np.random.default_rng(classes)
    u = rng.standard_normal((150, 5))
    u /= np.linalg.norm(u, axis=1)[:, None]
    u[:10] *= 1.5  # not all of unit length
    y = rng.integers(0, classes, 150)
    df = spark.createDataFrame([(u[i].tolist(), int(y[i])) for i in range(150)], "v array<double>, y int").repartition(6)
    k = (u @ u.T) ** 2
    off, same = ~np.eye(150, dtype=bool), y[:, None] == y[None, :]
    t = np.where(same, 1.0, -1.0)
    want = {"n": 150, "within_class_mean": k[off & same].mean(), "between_class_mean": k[~same].mean() if classes > 1 else 0.0,
            "off_diagonal_mean": k[off].mean(), "kernel_target_alignment": (k * t).sum() / (np.linalg.norm(k) * 150),
            "trace": np.trace(k), "frobenius2": (k * k).sum(), "participation_ratio": np.trace(k) ** 2 / (k * k).sum()}
    got = vector_kernel_diagnostics(df, "v", "y", 5).first().asDict()
    assert all(math.isclose(got[c], v, rel_tol=1e-10, abs_tol=1e-12) for c, v in want.items())
    assert math.isclose(got["separation"], want["within_class_mean"] - want["between_class_mean"], abs_tol=1e-12)


def test_wrong_lengths_are_refused(spark):
    from gramframe.operators.whole_kernel import vector_kernel_diagnostics
    with pytest.raises(ValueError):
        vector_kernel_diagnostics(spark.createDataFrame([([1.0], 0)], "v array<double>, y int"), "v", "y", 1000)
    with pytest.raises(Exception, match="vector length"):
        vector_kernel_diagnostics(spark.createDataFrame([([1.0], 0)], "v array<double>, y int"), "v", "y", 2).collect()
