"""Pivoted incomplete Cholesky against the full matrix."""

from __future__ import annotations

import numpy as np
import pytest

from gramframe.operators import low_rank
from gramframe.operators.low_rank import Gaussian, SquaredProduct


def _plain(k, keys, rank):
    """Pivots by the definition, on the whole matrix."""
    left, taken = k.copy(), []
    for _ in range(rank):
        d = np.round(np.diag(left), 10)
        p = min(range(len(d)), key=lambda i: (-d[i], keys[i]))
        if d[p] <= 1e-9:
            break
        taken.append((keys[p], left[p, p], np.trace(left) - (left[:, p] ** 2).sum() / left[p, p]))
        left = left - np.outer(left[:, p], left[:, p]) / left[p, p]
    return taken, left


@pytest.mark.parametrize("kernel", [SquaredProduct(), Gaussian(0.3)])
@pytest.mark.parametrize("window", [4, 64])
def test_pivots_and_factors_match_the_full_matrix(spark, monkeypatch, kernel, window):
    monkeypatch.setattr(low_rank, "WINDOW", window)
    rng = np.random.default_rng(4)
    u = rng.standard_normal((150, 4))
    u[100:] = u[rng.integers(0, 5, 50)]  # a third of the rows are copies of a few
    keys = [f"k{i:03d}" for i in rng.permutation(150)]
    rows = spark.createDataFrame([(keys[i], u[i].tolist(), 0) for i in range(150)], "id string, v array<double>, factors int").repartition(7)
    want, left = _plain(kernel.between(u, u), keys, 8)
    model = low_rank.fit(rows, "id", "v", 4, kernel, 8)
    assert model.keys == [w[0] for w in want]
    got = {r.id: r for r in low_rank.factors(rows, "id", "v", model).collect()}
    f = np.array([got[k].factors for k in keys])
    assert np.abs(kernel.between(u, u) - f @ f.T - left).max() < 1e-9
    residual = np.array([got[k].residual for k in keys])
    assert np.abs(residual - np.diag(left)).max() < 1e-9
    assert (np.abs(left) <= np.sqrt(np.outer(residual, residual)) + 1e-7).all()  # the stated bound
    for r, (key, d, trace) in zip(low_rank.steps(rows, "id", "v", model).orderBy("step").collect(), want, strict=True):
        assert r.id == key and np.allclose((r.pivot_residual, r.residual_trace), (d, trace), atol=1e-9)


def test_exact_rank_tolerance_and_edges(spark):
    u = np.random.default_rng(5).standard_normal((40, 2))
    rows = spark.createDataFrame([(i, u[i].tolist()) for i in range(40)], "id long, v array<double>")
    model = low_rank.fit(rows, "id", "v", 2, SquaredProduct(), 20)
    assert len(model.keys) == 3  # the squared product of two dimensions has rank 3
    assert len(low_rank.fit(rows, "id", "v", 2, SquaredProduct(), 20, tolerance=1e9).keys) == 0
    none = low_rank.fit(rows.limit(0), "id", "v", 2, SquaredProduct(), 3)
    assert none.keys == [] and low_rank.factors(rows, "id", "v", none).first().factors == []
    assert low_rank.steps(rows.limit(0), "id", "v", none).count() == 0
    with pytest.raises(ValueError):
        low_rank.fit(rows, "id", "v", 2, SquaredProduct(), 0)
    for bad in ([1.0], [1.0, None], [1.0, float("nan")], None):
        with pytest.raises(Exception, match="a row needs"):
            low_rank.fit(spark.createDataFrame([(1, bad)], "id long, v array<double>"), "id", "v", 2, SquaredProduct(), 1)
