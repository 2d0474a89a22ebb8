"""Quality floors and determinism of the classifiers (planted table and fixture D)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from gramframe.operators import metrics, models, sampling
from gramframe.operators import kernel_stats as ks
from gramframe.sources.fixtures import FEATURES, fixture_d


def planted(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 9))
    y = (x[:, 0] + x[:, 1] > 0).astype(int)
    rows = [(f"p{i}", *map(float, x[i]), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "row_key string, " + ", ".join(f"f{q} double" for q in range(9)) + ", y int")


def test_kernel_expansion_floor_planted(spark):
    df = planted(spark)
    split = sampling.stratified_split(df, "y", "row_key", 1, 0.2)
    runs = sampling.comparison_runs([64], 1, 11)
    data = models.prepare_runs(split.where("split = 'train'"), runs, FEATURES)
    out = {r["model"]: r for r in models.compare_models(data, split.where("split = 'test'"), runs, "pauli", 1, FEATURES).collect()}
    assert out["SVM-RBF"]["balanced_accuracy"] > 0.75
    assert out["QSVM"]["balanced_accuracy"] > 0.6


def test_margin_grid_floor_planted(spark):
    df = planted(spark, 600, 1)
    split = sampling.stratified_split(df, "y", "row_key", 1, 0.2)
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    cv = models.rbf_svm_cv(train, FEATURES, "row_key", "y", 3, 3, [1.0, 10.0], ["scale"], dim=64)
    assert cv.best["mean_f1"] > 0.75
    ev = models.rbf_svm_fit_evaluate(train, test, FEATURES, "row_key", "y", 3, cv, dim=64).first()
    assert ev["balanced_accuracy"] > 0.75 and ev["roc_auc"] > 0.8


def test_kernel_classifier_floor_documents(spark):
    d = fixture_d(spark, SF01)
    split = sampling.stratified_split(d, "y", "row_key", 2, 0.2)
    runs = sampling.comparison_runs([64], 1, 5)
    data = models.prepare_runs(split.where("split = 'train'"), runs, FEATURES)
    out = {r["model"]: r for r in models.compare_models(data, split.where("split = 'test'"), runs, "custom", 1, FEATURES).collect()}
    assert out["SVM-RBF"]["balanced_accuracy"] > 0.7
    assert out["QSVM"]["balanced_accuracy"] > 0.6


def test_margin_models_reach_the_optimum(spark):
    """No nearby weights have a lower objective, and the penalty acts: C = 10 fits the rows closer than 0.1."""
    from gramframe.operators import margin
    df = planted(spark, 300, 2).withColumn("grp", F.lit(0)).repartition(2).cache()
    rows = df.select("y", *FEATURES).toPandas()
    x, y = rows[FEATURES].to_numpy(), 2.0 * rows["y"].to_numpy() - 1
    z = margin.random_features(0.1, 32, 5, 9)(x)
    specs = [margin.ModelSpec(i, 0, 0.1, c) for i, c in enumerate([0.1, 10.0])]
    fits = margin.fit_grid(df, "grp", FEATURES, "y", specs, 5, 32)
    rng, hinge = np.random.default_rng(0), []
    for s in specs:
        def objective(w, b):
            return np.maximum(0, 1 - y * (z @ w + b)).mean() + w @ w / (2 * s.C * len(y))
        w, b = fits[s.model_id].coefficients.toArray(), fits[s.model_id].intercept
        best = objective(w, b)
        near = [objective(w + d[:-1], b + d[-1]) for size in (0.5, 0.1, 0.02) for d in rng.normal(size=(50, 33)) * size * max(np.abs(w).max(), 0.1)]
        assert best <= min(near) + 2e-3 * best
        hinge.append(np.maximum(0, 1 - y * (z @ w + b)).mean())
    assert hinge[1] < hinge[0] - 0.05
    scores = margin.score_grid(df, "grp", FEATURES, "y", "row_key", specs, fits, 5, 32)
    assert scores.count() == 600 and scores.where("pred = y").count() > 450


def test_random_feature_count_is_checked():
    from gramframe.operators import margin
    with pytest.raises(ValueError):
        margin.check_random_features(4)


def test_margin_passes_are_few_and_reach_the_optimum(spark, monkeypatch):
    """Groups too large for one task: all models of the grid share a handful of passes over the rows, and end at the
    objective that a solver holding all rows finds."""
    from gramframe.operators import margin
    df = planted(spark, 3000, 4).withColumn("grp", F.when(F.col("f2") > 1, 1).otherwise(0)).repartition(3).cache()
    rows = df.select("grp", "y", *FEATURES).toPandas()
    specs = [margin.ModelSpec(i, g, 0.1, c) for i, (g, c) in enumerate([(0, 0.1), (0, 1.0), (1, 0.1)])]
    passes = []
    one_pass = margin._pass
    monkeypatch.setattr(margin, "_pass", lambda *a: passes.append(1) or one_pass(*a))
    monkeypatch.setattr(margin, "START_ROWS", 300)
    fits = margin.fit_grid(df, "grp", FEATURES, "y", specs, 5, 32)
    assert 1 <= len(passes) <= 30
    for s in specs:
        own = rows[rows["grp"] == s.group]
        z = margin.random_features(0.1, 32, 5, 9)(own[FEATURES].to_numpy())
        sign, reg = 2.0 * own["y"].to_numpy() - 1, 1 / (s.C * len(own))
        w, b = fits[s.model_id].coefficients.toArray(), fits[s.model_id].intercept
        found = np.maximum(0, 1 - sign * (z @ w + b)).mean() + reg / 2 * (w @ w)
        _, best, gap = margin._solve_rows(z, sign, reg)
        assert gap <= 1e-5 and best - gap <= found <= best + 3e-4 * best
        assert abs(found - fits[s.model_id].objective) < 1e-5
    counts = {r["model_id"]: r for r in margin.confusion_grid(df, "grp", FEATURES, "y", specs, fits, 5, 32).collect()}
    scores = margin.score_grid(df, "grp", FEATURES, "y", "row_key", specs, fits, 5, 32)
    plain = metrics.confusion_counts(scores, "y", "pred", ["model_id"]).collect()
    assert {r["model_id"]: r.asDict() for r in plain} == {m: r.asDict() for m, r in counts.items()} and len(plain) == 3


def test_margin_models_of_one_class(spark):
    from gramframe.operators import margin
    df = planted(spark, 50, 1).where("y = 1").withColumn("grp", F.lit(0))
    fit = margin.fit_grid(df, "grp", FEATURES, "y", [margin.ModelSpec(0, 0, 0.1, 1.0)], 5, 16)[0]
    assert fit.intercept == 1.0 and not fit.coefficients.toArray().any()
