"""Operator 13 against numpy's dense solver and exact integer sums."""

from __future__ import annotations

import math

import numpy as np
import pytest


def _same_up_to_sign(a, b):
    return min(np.abs(a - b).max(), np.abs(a + b).max())


@pytest.mark.parametrize("kind", ["spread", "clustered", "equal", "diagonal", "low rank", "one"])
def test_spectrum(kind):
    from gramframe.llm.whitening import spectrum
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.standard_normal((24, 24)))
    values = {"spread": np.logspace(6, -3, 24), "clustered": np.sort(np.concatenate([5 + np.arange(12) * 1e-7, np.arange(12)]))[::-1],
              "equal": np.repeat([4.0, 2.0], 12), "diagonal": np.arange(24.0)[::-1], "low rank": np.array([3.0, 1.0] + [0.0] * 22), "one": np.array([7.0])}[kind]
    if kind in ("diagonal", "one"):
        q = np.eye(len(values))
    v = q @ np.diag(values) @ q.T
    v = (v + v.T) / 2
    e, x = spectrum(v)
    assert np.abs(e - values).max() <= 1e-13 * values[0]
    assert np.abs(x.T @ x - np.eye(len(v))).max() < 1e-13
    assert np.abs(v @ x - x * e).max() <= 2e-14 * values[0]


def test_polar_factor():
    from gramframe.llm.whitening import polar_factor
    rng = np.random.default_rng(6)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    u, s, vt = np.linalg.svd(a)
    assert np.abs(polar_factor(a) - u @ vt).max() < 1e-10


def _rows(n=400, d=12):
    rng = np.random.default_rng(7)
    m = rng.standard_normal((n, d)) @ np.diag(np.linspace(3, 0.5, d)) @ np.linalg.qr(rng.standard_normal((d, d)))[0] + 2
    return [(i, [float(np.float32(c)) for c in m[i]]) for i in range(n)]


def test_whitened_rows(spark):
    from gramframe.llm.whitening import whiten
    good = _rows()
    good += [(5, good[5][1]), (None, good[6][1]), (901, good[7][1][:4]), (902, [])]
    bad = [(903, None), (904, [1.0, None]), (905, [float("nan")] * 12), (906, [float("inf")] * 12), (907, [1e30] * 12)]
    table = spark.createDataFrame([(i, v, 1, 2.0) for i, v in good + bad], "vec_id int, embedding array<float>, n int, v double").repartition(4)
    x = np.full((len(good), 12), 1000000, np.int64)
    for r, (_, v) in enumerate(good):
        x[r, :len(v)] = [math.floor(64 * float(np.float32(c))) + 1000000 for c in v]
    n, sums = len(x), x.sum(axis=0)
    mid = x - sums / n
    e, q = np.linalg.eigh(mid.T @ mid / n)
    e, q = e[::-1], q[:, ::-1]
    want = mid @ q / np.sqrt(e)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    got = whiten(table, components=9).collect()
    assert len(got) == n * 9 and {r.n for r in got} == {n}
    assert {r.vec_id for r in got} == {i for i, _ in good}
    error = {r.identity_error for r in got}
    assert len(error) == 1 and 0 <= error.pop() < 1e-9
    for c in range(9):
        own = sorted(((-1 if r.vec_id is None else r.vec_id, r.deviation, abs(r.whitened)) for r in got if r.component == c + 1))
        ref = sorted(((-1 if i is None else i, int(dv), abs(w)) for (i, _), dv, w in zip(good, deviation, want[:, c])))
        assert [o[:2] for o in own] == [o[:2] for o in ref]
        assert max(abs(o[2] - r[2]) for o, r in zip(own, ref)) < 1e-9
        assert math.isclose({r.explained for r in got if r.component == c + 1}.pop(), e[c] / e.sum(), rel_tol=1e-10)
    # one sign for all rows
    first = {r.vec_id: r.whitened for r in got if r.component == 1 and r.vec_id is not None and r.vec_id < 400}
    assert _same_up_to_sign(np.array([first[i] for i in range(400)]), want[:400, 0]) < 1e-9


def test_degenerate_tables(spark):
    from gramframe.llm.whitening import whiten
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whiten(empty).collect() == []
    one = spark.createDataFrame([(1, [0.5, -0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in whiten(one).collect()] == [(1, 1, 1, 0, None, None, None), (1, 2, 1, 0, None, None, None)]
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(5)], "vec_id long, embedding array<double>")
    got = whiten(flat).collect()
    assert {r.component for r in got if r.whitened is not None} == {1} and len(got) == 15
    assert {r.identity_error < 1e-12 for r in got} == {True}
    wide = spark.createDataFrame([(i, [2.0 ** 50 * i, 1.0]) for i in range(4)], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whiten(wide).collect()} == {None}


def test_exact_deviation_beyond_fast_path():
    from gramframe.llm.whitening import Fit
    x = np.array([[10 ** 9, 3], [10 ** 9 + 40000, 5], [10 ** 9 + 1, 9]], np.int64)
    n = 70_000
    fitted = Fit(n, [int(10 ** 9 * n + 12345), 5 * n + 1])
    want = [sum((n * int(a) - s) ** 2 for a, s in zip(row, fitted.sums)) for row in x]
    assert fitted.deviations(x) == want and fitted.deviations(x[2:]) == want[2:]
