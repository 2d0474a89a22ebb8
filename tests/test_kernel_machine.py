"""Kernel machines: optimality, gaps recomputed from coefficients, predictions against plain formulas."""

from __future__ import annotations

import numpy as np
import pytest

from gramframe.functions import recursions as rec
from gramframe.operators import kernel_machine as km
from gramframe.operators import prep, sampling
from gramframe.sources.fixtures import FEATURES
from test_models import planted


def _objectives(k, y, c, alpha, b):
    f = k @ (alpha * y)
    quad = alpha * y @ f
    return quad / 2 + c * np.maximum(0, 1 - y * (f + b)).sum(), alpha.sum() - quad / 2


@pytest.mark.parametrize("c", [0.1, 1.0, 10.0, 1000.0])
@pytest.mark.parametrize("kind", ["rbf", "linear", "repeated", "indefinite"])
def test_dual_is_optimal(kind, c):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((80, 5))
    if kind == "repeated":
        x[40:] = x[:40]
    y = np.where(x[:, 0] + 0.5 * rng.standard_normal(80) > 0, 1.0, -1.0)
    k = km.rbf_matrix(x, x, 0.3) if kind != "linear" else x @ x.T
    if kind == "indefinite":  # an estimated kernel need not be positive: the constraints still hold
        noise = rng.standard_normal((80, 80)) * 0.01
        k = k + noise + noise.T + 0.2 * np.eye(80)
    fit = km.solve_dual(k, y, c)
    assert (fit.alpha >= 0).all() and (fit.alpha <= c).all() and abs(fit.alpha @ y) < 1e-9 * c * 80
    primal, dual = _objectives(k, y, c, fit.alpha, fit.intercept)
    assert abs(primal - fit.objective) < 1e-9 * primal and primal - dual <= 2 * km.GAP * primal
    for _ in range(200):  # no feasible neighbour has a better dual
        d = rng.standard_normal(80) * rng.choice([1e-3, 1e-2, 0.1]) * c
        d -= y * (d @ y) / 80
        near = np.clip(fit.alpha + d, 0, c)
        near -= y * (near @ y) / 80
        if (near >= 0).all() and (near <= c).all():
            assert _objectives(k, y, c, near, 0.0)[1] <= dual + 2 * km.GAP * primal
    warm = km.solve_dual(k, y, 2 * c, fit.alpha)
    cold = km.solve_dual(k, y, 2 * c)
    assert abs(warm.objective - cold.objective) <= 4 * km.GAP * cold.objective


def test_single_class_and_empty():
    assert km.solve_dual(np.eye(3), np.ones(3), 1.0).intercept == 1.0
    assert km.solve_dual(np.eye(2), -np.ones(2), 1.0).intercept == -1.0
    assert km.solve_dual(np.zeros((0, 0)), np.zeros(0), 1.0).steps == 0


def test_separable_points_have_the_known_margin():
    x = np.array([[0.0], [1.0], [3.0], [4.0]])
    fit = km.solve_dual(x @ x.T, np.array([-1.0, -1.0, 1.0, 1.0]), 1e6)
    w = (fit.alpha * [-1, -1, 1, 1]) @ x
    assert np.isclose(w[0], 1.0, atol=1e-4) and np.isclose(fit.intercept, -2.0, atol=1e-4)
    assert np.allclose(fit.alpha, [0, 0.5, 0.5, 0], atol=1e-4)


def test_matrix_forms_equal_the_pair_forms():
    rng = np.random.default_rng(8)
    a, b = rng.uniform(-3, 3, (37, 9)), rng.uniform(-3, 3, (11, 9))
    for name, reps in (("pauli", 1), ("pauli", 2), ("custom", 1), ("custom", 2), ("zz", 1), ("zz", 2)):
        pair = rec.fidelity_kernel(name, reps)(a[:, None, :], b[None, :, :])
        assert np.allclose(rec.fidelity_matrix(name, reps, a, b), pair, atol=1e-12)
    assert rec.chunk_rows(64) * 64 * rec.PAIR_BYTES <= rec.WORK_BYTES and rec.chunk_rows(10 ** 9) == 1
    assert np.allclose(km.rbf_matrix(a, b, 0.2), np.exp(-0.2 * ((a[:, None] - b[None]) ** 2).sum(-1)), atol=1e-12)


MACHINES = [km.Machine("QSVM", "pauli", 1, (0.5, 5.0)), km.rbf_machine([0.5, 5.0], ["scale", 0.01])]


def test_grid_fits_predicts_and_counts(spark):
    """Folds, refit and the one-pass scorer against a plain numpy run of the same rules."""
    from pyspark.sql import functions as F
    df = planted(spark, 500, 3).withColumn("f2", F.when(F.col("f2") > 1, None).otherwise(F.col("f2")))
    split = sampling.stratified_split(df, "y", "row_key", 1, 0.4)
    train, test = split.where("split = 'train'").drop("split"), split.where("split = 'test'").drop("split")
    runs = sampling.comparison_runs([20, 40], 2, 11)
    subsets = sampling.balanced_subsets(train, "y", "row_key", runs)
    pre = prep.fit_preprocessor(subsets, FEATURES, ["run_id"], max_groups=4, rows_per_group=40)
    scaled = pre.transform(subsets).cache()
    validated = km.cross_validated(scaled, MACHINES, FEATURES, 4).cache()
    rows = validated.toPandas()
    assert len(rows) == (2 * 20 + 2 * 40) * (2 + 4)
    assert (rows["gap"] <= km.GAP * rows["objective"]).all()
    table = km.cv_table(validated, MACHINES).toPandas()
    for (run, model), own in table.groupby(["run_id", "model"]):
        f1 = {}
        for params, part in rows[(rows["run_id"] == run) & (rows["model"] == model)].groupby("params"):
            per = []
            for _, p in part.groupby("fold"):
                tp, wrong = ((p["pred"] == 1) & (p["y"] == 1)).sum(), (p["pred"] != p["y"]).sum()
                per.append(2 * tp / (2 * tp + wrong) if 2 * tp + wrong else 0.0)
            f1[params] = np.mean(per)
        machine = next(m for m in MACHINES if m.name == model)
        best = max(machine.order(), key=lambda p: (round(f1[p], 12), -machine.order().index(p)))
        assert own[own["rank"] == 1]["params"].item() == best
        assert np.allclose([f1[p] for p in own["params"]], own["mean_f1"])
    coefficients = km.refit(scaled, km.cv_table(validated, MACHINES), MACHINES, FEATURES).cache()
    co = coefficients.toPandas()
    sub = scaled.toPandas()
    stats = {r["run_id"]: r.asDict() for r in pre.stats.collect()}
    held = test.toPandas()
    raw = held[FEATURES].to_numpy(float)
    scorer = km.MultiRunScorer(coefficients, pre.stats, MACHINES, FEATURES)
    counted = {(r.run_id, r.model): r for r in scorer.metrics(test.repartition(3)).collect()}
    assert len(counted) == 8
    for (run, model), own in co.groupby(["run_id", "model"]):
        machine = next(m for m in MACHINES if m.name == model)
        x = sub[sub["run_id"] == run].sort_values("position")
        alpha = np.zeros(len(x))
        alpha[own["position"]] = own["coef"]
        y = 2.0 * x["y"].to_numpy() - 1
        gamma = None if model == "QSVM" else own["width"].iloc[0]
        k = machine.matrix(x[FEATURES].to_numpy(), x[FEATURES].to_numpy(), gamma)
        primal, dual = _objectives(k, y, own["C"].iloc[0], alpha * y, own["intercept"].iloc[0])
        assert primal - dual <= 2 * km.GAP * primal
        s = stats[run]
        z = np.stack([(np.where(np.isnan(raw[:, i]), s[f"med_{c}"], raw[:, i]) - s[f"mu_{c}"]) / s[f"sd_{c}"] for i, c in enumerate(FEATURES)], axis=1)
        score = machine.matrix(z, own[FEATURES].to_numpy(), gamma) @ own["coef"].to_numpy() + own["intercept"].iloc[0]
        assert np.allclose(scorer.scores(raw)[:, scorer.names.index((run, model))], score, atol=1e-9)
        r = counted[run, model]
        assert (r.tn, r.fp, r.fn, r.tp) == tuple(((held["y"] == t) & ((score > 0) == p)).sum() for t, p in ((0, 0), (0, 1), (1, 0), (1, 1)))
        assert r.balanced_accuracy > 0.6
    one = test.withColumn("s", scorer.score_column(test, 0, "QSVM")).select("row_key", "s").toPandas().set_index("row_key")["s"]
    assert np.allclose(one[held["row_key"]].to_numpy(), scorer.scores(raw)[:, scorer.names.index((0, "QSVM"))])
    plan = scorer.confusion(test)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize("feature_map, repetitions", [("pauli", 1), ("pauli", 2), ("custom", 1), ("custom", 2), ("zz", 1), ("zz", 2)])
@pytest.mark.parametrize("size", [1.0, 50.0])
def test_signs_of_single_precision_are_those_of_double(feature_map, repetitions, size, monkeypatch):
    """Also for rows whose decision value is zero to many digits; few rows need the second look."""
    rng = np.random.default_rng(11)
    machine = km.Machine("QSVM", feature_map, repetitions)
    x, vectors = rng.standard_normal((4000, 9)), rng.standard_normal((24, 9))
    weights = size * rng.standard_normal(24)
    plain = machine.matrix(x, vectors, None) @ weights
    twice = []
    full = km.Machine.matrix
    monkeypatch.setattr(km.Machine, "matrix", lambda self, a, b, g: twice.append(len(a)) or full(self, a, b, g))
    assert (machine.signs(x, vectors, weights, 0.0, None) == (plain > 0)).all()
    assert sum(twice) < len(x) / 4       # the rest is decided in single precision
    for at in (0, 17, 99):               # the intercept puts this row's value just above and just below zero
        for shift in (1e-9 * size, -1e-9 * size):
            assert (machine.signs(x, vectors, weights, shift - plain[at], None) == (plain + (shift - plain[at]) > 0)).all()


def test_single_precision_error_is_far_below_its_bound():
    rng = np.random.default_rng(12)
    a, b = (km.angles(2.0 * rng.standard_normal((n, 9))) for n in (600, 40))
    for feature_map, repetitions in [("custom", 2), ("zz", 1), ("zz", 2)]:
        k = rec.fidelity_matrix(feature_map, repetitions, a, b)
        single = rec.fidelity_matrix(feature_map, repetitions, a.astype(np.float32), b.astype(np.float32))
        assert single.dtype == np.float32
        assert np.abs(np.sqrt(single) - np.sqrt(k)).max() < km.SINGLE_ERROR * 9 * repetitions / 5
    for repetitions in (1, 2, 3):
        single = rec.fidelity_matrix("pauli", repetitions, a.astype(np.float32), b.astype(np.float32))
        assert single.dtype == np.float32
        assert np.abs(single - rec.fidelity_matrix("pauli", repetitions, a, b)).max() < km.SINGLE_ERROR * 9 * repetitions / 5
