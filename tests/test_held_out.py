"""Cross-validation without copies: groups that are complements of folds, and margin models on rows that groups share."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramframe.operators import margin, models, prep, sampling, selection
from gramframe.sources.fixtures import FEATURES

HELD = selection.HeldOut("fold", "grp", 4)


def folded(spark, n=900, seed=0):
    """Rows with nulls, repeated values, one far value and folds of uneven size."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 9))
    x[:, 1], x[0, 2] = np.round(x[:, 1]), 1e6
    y = (x[:, 0] + 0.5 * x[:, 3] + rng.normal(size=n) > 0.5).astype(int)
    fold = rng.choice(4, size=n, p=[0.1, 0.2, 0.3, 0.4])
    rows = [(f"k{i}", *[None if rng.random() < 0.1 else float(v) for v in x[i]], int(y[i]), int(fold[i])) for i in range(n)]
    return spark.createDataFrame(rows, "row_key string, " + ", ".join(f"{c} double" for c in FEATURES) + ", y int, fold int").repartition(3).cache()


def copied(df):
    """One copy of a row per group that it trains."""
    return df.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(3)))).where("grp <> fold")


def test_statistics_of_held_out_groups(spark):
    df = folded(spark).withColumn("f5", F.when(F.col("fold") == 1, F.col("f5")))   # missing in all folds but one
    df = df.withColumn("f6", F.lit(2.5))
    want = {r["grp"]: r.asDict() for r in prep.fit_preprocessor(copied(df).where("grp <> 1"), FEATURES, ["grp"], max_groups=4).stats.collect()}
    got = {r["grp"]: r.asDict() for r in prep.fit_preprocessor(df, FEATURES, max_groups=4, held_out=HELD).stats.collect()}
    assert got[1]["med_f5"] is None and sorted(got) == [0, 1, 2, 3]
    for g, row in want.items():
        assert {k: v for k, v in row.items() if k.startswith("med")} == {k: v for k, v in got[g].items() if k.startswith("med")}
        assert all(row[k] == pytest.approx(got[g][k], rel=1e-9, abs=1e-9) for k in row)


@pytest.mark.parametrize("finish", [4096, 5])
def test_undersampling_of_held_out_groups(spark, monkeypatch, finish):
    monkeypatch.setattr(selection, "FINISH", finish)
    df = folded(spark)
    want = {(r["grp"], r["row_key"]) for r in sampling.undersample(copied(df), "y", "row_key", 7, ["grp"], max_groups=4).collect()}
    rows = sampling.undersample(df, "y", "row_key", 7, max_groups=4, held_out=HELD).collect()
    assert len({r["row_key"] for r in rows}) == len(rows) <= 900
    assert {(g, r["row_key"]) for r in rows for g in range(4) if r[sampling.member_column(g)]} == want


def test_shared_rows_train_the_models_of_copied_rows(spark, monkeypatch):
    """Flags and statistics instead of scaled copies; a sample first, then few passes over all rows, ended at the optimum."""
    df = folded(spark, 4000, 3)
    pre = prep.fit_preprocessor(df, FEATURES, max_groups=4, held_out=HELD)
    bal = sampling.undersample(df, "y", "row_key", 7, max_groups=4, held_out=HELD).cache()
    members = margin.Members({g: sampling.member_column(g) for g in range(4)}, pre.by_group())
    copies = sampling.undersample(pre.transform(copied(df)), "y", "row_key", 7, ["grp"], max_groups=4).cache()
    widths, plain = models._gammas(bal, "grp", FEATURES, ["scale"], members), models._gammas(copies, "grp", FEATURES, ["scale"])
    assert widths == {k: pytest.approx(v, rel=1e-9) for k, v in plain.items()}
    specs = [margin.ModelSpec(i, g, 0.1, c) for i, (g, c) in enumerate([(0, 0.1), (2, 0.1), (2, 1.0)])]
    read, one_pass = [], margin._pass
    monkeypatch.setattr(margin, "_pass", lambda rows, *a: read.append(rows.count()) or one_pass(rows, *a))
    for name, value in (("START_ROWS", 400), ("PART_ROWS", 200), ("SAMPLE_ROWS", 100), ("SAMPLE_SHARE", 0.25)):
        monkeypatch.setattr(margin, name, value)
    fits = margin.fit_grid(bal, "grp", FEATURES, "y", specs, 5, 32, members)
    assert 1 <= sum(n == bal.count() for n in read) <= 30 and min(read) < bal.count() / 2 and max(read) <= 4000
    rows = copies.toPandas()
    for s in specs:
        own = rows[rows["grp"] == s.group]
        z, sign = margin.random_features(0.1, 32, 5, 9)(own[FEATURES].to_numpy()), 2.0 * own["y"].to_numpy() - 1
        w, b = fits[s.model_id].coefficients.toArray(), fits[s.model_id].intercept
        reg = 1 / (s.C * len(own))
        found = np.maximum(0, 1 - sign * (z @ w + b)).mean() + reg / 2 * (w @ w)
        _, best, gap = margin._solve_rows(z, sign, reg)
        assert gap <= 1e-5 and best - gap <= found <= best + 3e-4 * best


def test_cross_validation_stores_a_row_once_per_step(spark, monkeypatch):
    """Before, the training parts were k - 1 copies of every row."""
    df, kept, store = folded(spark, 600, 1).drop("fold"), [], models.stored
    monkeypatch.setattr(models, "stored", lambda rows, *by: kept.append(store(rows, *by)) or kept[-1])
    cv = models.rbf_svm_cv(df, FEATURES, "row_key", "y", 3, 4, [1.0], ["scale", 0.01], dim=32)
    assert [t.count() <= 600 for t in kept] == [True] * len(kept) and cv.summary.count() == 2
    assert cv.best["mean_f1"] > 0.6


def test_signs_of_scored_rows_are_those_of_double_precision():
    """Single precision decides only rows that are clear of zero, far values included."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5000, 9)) * np.where(rng.random((5000, 1)) < 0.01, 1e5, 1.0)
    exact = margin.random_features(0.1, 64, 5, 9)
    w = rng.normal(size=(3, 64)) * np.array([[1.0], [30.0], [1e-3]])
    b = -np.median(exact(x) @ w.T, axis=0)      # many rows near zero
    b[2] = -(exact(x[7]) @ w[2])                # and one as near as can be
    hits = margin._hits(x, {0.1: (margin._map_of(0.1, 9, 64, 5), exact)}, 0.1, w, b)
    assert (hits == (exact(x) @ w.T + b > 0)).mean() > 0.9999 and (hits[:, :2] == (exact(x) @ w[:2].T + b[:2] > 0)).all()


def test_rounded_hinge():
    short = np.array([-1.0, -0.5, -0.25, 0.0, 0.25, 0.5, 2.0])
    assert np.allclose(margin._rounded(short, 0.5), [0, 0, 0.03125, 0.125, 0.28125, 0.5, 2.0])
