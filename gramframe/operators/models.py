"""Classifier training and evaluation over run grids.

Kernel-expansion classifier (deterministic): score(x) = sum_j c_j K(x, l_j), c = +1/n1 for
class-1 landmarks and -1/n0 for class 0; label = score > 0. Every run of a grid is one
group of the same Spark job (landmarks per run, broadcast; rows streamed).

Kernel machines (``kernel_machine``): support-vector machines on the subsets' kernels, for the feature-map study and the
comparison.

Margin classifiers (``margin``, hinge loss): the RBF baseline on random Fourier
features of the standardised rows of a whole training split. The penalty C maps to regParam = 1 / (C * n_train). Cross-validation stores every
row once: each training part is undersampled and scaled for itself, but by flags and statistics, not by copies.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import recursions as rec
from . import kernel_machine as km
from . import kernel_stats as ks
from . import metrics as met
from . import margin, prep, sampling
from .encode import encode_angles
from ..session import cut_lineage, stored
from .margin import RANDOM_FEATURES
from .ranking import bounded_broadcast
from .selection import HeldOut

# The compared metrics, in report order
SIX = ["accuracy", "balanced_accuracy", "precision", "recall", "f1", "false_positive_rate"]


def rbf_unit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """exp(-||a - b||^2); gamma is folded into the inputs (scaled by sqrt(gamma))."""
    return np.exp(-np.sum((a - b) ** 2, axis=-1))


rbf_unit = rec.with_matrix(rbf_unit, lambda x, lm: km.rbf_matrix(x, lm, 1.0))


# ---------------------------------------------------------------- run-grid preparation
@dataclass
class RunData:
    subsets: DataFrame     # run_id, size, seed, repeat, key, y, position, scaled features, angles a0..
    gammas: DataFrame      # run_id, gamma ('scale' rule on the scaled subset)
    stats: DataFrame       # run_id, fitted median, mean and spread of every feature


def prepare_runs(train: DataFrame, runs: list[sampling.Run], features: list[str],
                 key: str = "row_key", target: str = "y") -> RunData:
    """Subsets for every run, preprocessing fitted on each subset and applied to it, angles for the fidelity kernels.
    Other tables are prepared where they are scored (``kernel_machine.MultiRunScorer``)."""
    # small derived tables (sum of subset sizes rows, one stats row per run) are materialised
    # once: the fits, landmark collections and both models read them
    subsets = cut_lineage(sampling.balanced_subsets(train, target, key, runs))
    pre = prep.fit_preprocessor(subsets, features, ["run_id"], max_groups=len(runs),
                                rows_per_group=max(r.size for r in runs))
    pre.stats = cut_lineage(pre.stats)
    sub_s = pre.transform(subsets)
    n = len(features)
    pairs = ", ".join(f"`{c}`" for c in features)
    cells = sub_s.selectExpr("run_id", f"stack({n}, {pairs}) as (v)")
    gammas = cut_lineage(cells.groupBy("run_id").agg((F.lit(1.0) / (F.lit(float(n)) * F.var_pop("v"))).alias("gamma")))
    return RunData(cut_lineage(encode_angles(sub_s, features, keep=True)), gammas, pre.stats)


def kernel_expansion_predictions(rows: DataFrame, landmarks: DataFrame, kernel_fn, cols: list[str],
                                 group_col: str, key: str = "row_key", target: str = "y") -> DataFrame:
    """rows + score + pred for a grouped landmark table (class-mean coefficients per group)."""
    lm = ks.class_mean_coefficients(landmarks, target, [group_col])
    s = ks.kernel_scores(rows, lm, kernel_fn, cols, key=key, group_col=group_col)
    return s.withColumn("pred", (F.col("score") > 0).cast("int"))


# ---------------------------------------------------------------- M5: comparison grid
def class_mean_machines(data: RunData, feature_map: str, repetitions: int, features: list[str], n_runs: int, target: str = "y") -> tuple[DataFrame, list[km.Machine]]:
    """The coefficient table of the deterministic classifiers: every subset row with its class-mean weight."""
    machines = [km.Machine("QSVM", feature_map, repetitions), km.rbf_machine([1.0], ["scale"])]
    rows = ks.class_mean_coefficients(data.subsets, target, ["run_id"]).join(bounded_broadcast(data.gammas, n_runs), "run_id")
    rows = rows.select("run_id", "coef", F.lit(0.0).alias("intercept"), "gamma", *features)
    width = F.when(F.col("model") == "SVM-RBF", F.col("gamma"))
    both = rows.withColumn("model", F.explode(F.array(*[F.lit(m.name) for m in machines]))).withColumn("width", width).drop("gamma")
    return both, machines


def compare_models(data: RunData, test: DataFrame, runs: list[sampling.Run], feature_map: str, repetitions: int,
                   features: list[str], target: str = "y") -> DataFrame:
    """(model, subset_size, repeat, 6 metrics): kernel-expansion classifiers with class-mean weights on the map's fidelity and
    on RBF; all runs and both models score the whole test split in one pass over its rows."""
    table, machines = class_mean_machines(data, feature_map, repetitions, features, len(runs), target)
    m = km.MultiRunScorer(table, data.stats, machines, features).metrics(test, target)
    grid = test.sparkSession.createDataFrame([(x.run_id, x.size, x.repeat) for x in runs], "run_id int, subset_size int, repeat int")
    return m.join(F.broadcast(grid), "run_id").select("model", "subset_size", "repeat", *SIX)


# ---------------------------------------------------------------- M4: feature-map study
def fold_scores(data: RunData, feature_map: str, repetitions: int, n: int, k: int,
                key: str = "row_key", target: str = "y") -> DataFrame:
    """(run_id, fold, f1) of the kernel classifier under stratified k-fold CV on each subset."""
    sub = data.subsets
    counts = {}
    for row in sub.groupBy("run_id", target).count().collect():  # runs x 2 rows
        counts.setdefault(row["run_id"], {})[row[target]] = row["count"]
    for c in counts.values():
        sampling.check_folds(c, k)
    folded = sampling.stratified_folds(sub, target, key, 0, k, group_cols=["run_id"],
                                       max_groups=2 * max(1, len(counts)))
    val = folded.withColumn("gid", F.col("run_id") * k + F.col("fold"))
    train_parts = folded.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_f")) \
        .where(F.col("_f") != F.col("fold")).withColumn("gid", F.col("run_id") * k + F.col("_f"))
    angles = [f"a{q}" for q in range(n)]
    pred = kernel_expansion_predictions(val, train_parts, rec.fidelity_kernel(feature_map, repetitions),
                                        angles, "gid", key, target)
    m = met.threshold_metrics(pred, target, "pred", ["run_id", "fold"])
    return m.select("run_id", "fold", "f1")


def map_study(data: RunData, runs: list[sampling.Run], maps: list[str], repetitions: int, n: int, k: int,
              key: str = "row_key", target: str = "y") -> DataFrame:
    """(feature_map, repeat, cv_f1): mean validation F1 per map and subset (one subset per
    repeat, shared by all maps)."""
    rep = data.subsets.sparkSession.createDataFrame([(r.run_id, r.repeat) for r in runs], "run_id int, repeat int")
    out = None
    for name in maps:
        fs = fold_scores(data, name, repetitions, n, k, key, target)
        t = fs.groupBy("run_id").agg(F.avg("f1").alias("cv_f1")).withColumn("feature_map", F.lit(name))
        out = t if out is None else out.unionByName(t)
    return out.join(F.broadcast(rep), "run_id").select("feature_map", "repeat", "cv_f1")


# ---------------------------------------------------------------- M3 to M5 with trained kernel machines
@dataclass
class Trained:
    table: DataFrame         # cv_table: every parameter set of every run and machine
    coefficients: DataFrame  # support vectors of the refitted best models
    machines: list


def train_machines(data: RunData, machines: list[km.Machine], features: list[str], k: int, key: str = "row_key", target: str = "y") -> Trained:
    """Cross-validate every machine on every run's subset, refit the best parameters on the whole subset (M3)."""
    table = cut_lineage(km.cv_table(km.cross_validated(data.subsets, machines, features, k, key, target), machines, target))
    return Trained(table, cut_lineage(km.refit(data.subsets, table, machines, features, key, target)), machines)


def compare_trained(train: DataFrame, test: DataFrame, runs: list[sampling.Run], feature_map: str, repetitions: int, features: list[str],
                    k: int, c_grid: list[float], gamma_grid: list, key: str = "row_key", target: str = "y") -> DataFrame:
    """(model, subset_size, repeat, 6 metrics): kernel SVM on the map's fidelity and RBF SVM, both tuned by cross-validation
    on each run's subset; all runs and both models score the whole test split in one pass over it."""
    data = prepare_runs(train, runs, features, key, target)
    machines = [km.Machine("QSVM", feature_map, repetitions, tuple(c_grid)), km.rbf_machine(c_grid, gamma_grid)]
    fitted = train_machines(data, machines, features, k, key, target)
    m = km.MultiRunScorer(fitted.coefficients, data.stats, machines, features).metrics(test, target)
    grid = train.sparkSession.createDataFrame([(x.run_id, x.size, x.repeat) for x in runs], "run_id int, subset_size int, repeat int")
    return m.join(F.broadcast(grid), "run_id").select("model", "subset_size", "repeat", *SIX)


def trained_map_study(data: RunData, runs: list[sampling.Run], maps: list[str], repetitions: int, features: list[str], k: int,
                      c_grid: list[float], key: str = "row_key", target: str = "y") -> DataFrame:
    """(feature_map, repeat, C, cv_f1): best mean validation F1 of a kernel SVM per map and subset; every fold's task
    trains all maps on the same rows (M4)."""
    machines = [km.Machine(m, m, repetitions, tuple(c_grid)) for m in maps]
    table = km.cv_table(km.cross_validated(data.subsets, machines, features, k, key, target), machines, target)
    rep = data.subsets.sparkSession.createDataFrame([(r.run_id, r.repeat) for r in runs], "run_id int, repeat int")
    return table.where("rank = 1").join(F.broadcast(rep), "run_id").select(
        F.col("model").alias("feature_map"), "repeat", "C", F.col("mean_f1").alias("cv_f1"))


# ---------------------------------------------------------------- margin classifiers
def rff_kernel(gamma: float, dim: int, seed: int, n: int):
    """k(a, b) = z(a).z(b) with fixed random features (an unbiased estimate of
    exp(-gamma ||a - b||^2)), for Arrow-batch scoring."""
    z = margin.random_features(gamma, margin.check_random_features(dim), seed, n)
    return rec.with_matrix(lambda x, y: np.sum(z(x) * z(y), axis=-1), lambda x, lm: z(x) @ z(lm).T)


@dataclass
class CVResult:
    scores: DataFrame      # params, C, gamma, fold, f1
    summary: DataFrame     # params, mean_f1, std_f1 (population), rank
    best: dict


def _cv_result(spark, specs: list, names: dict, models: dict, valid: DataFrame, cols: list[str], target: str,
               seed: int, dim: int, order: list[str]) -> CVResult:
    """F1 of every model on its validation fold (models x folds rows), and the summary over folds."""
    from .report import cv_summary
    counts = margin.confusion_grid(valid, "grp", cols, target, specs, models, seed, dim)
    table = spark.createDataFrame([(m, *names[m]) for m in names], "model_id int, params string, C double, gamma string, fold int")
    f1 = counts.select("model_id", *met.metric_columns(*[F.col(c) for c in ("tn", "fp", "fn", "tp")])).select("model_id", "f1")
    scores = cut_lineage(table.join(f1, "model_id").select("params", "C", "gamma", "fold", "f1"))
    summary = cv_summary(scores, order)
    return CVResult(scores, summary, summary.where(F.col("rank") == 1).first().asDict())


def rbf_svm_cv(train: DataFrame, features: list[str], key: str, target: str, seed: int, k: int,
               c_grid: list[float], gamma_grid: list, dim: int = RANDOM_FEATURES) -> CVResult:
    """Baseline: impute -> scale -> undersample -> random Fourier features -> margin models, all fitted
    inside each fold's training part; scored by F1 on the untouched validation fold."""
    folded = stored(sampling.stratified_folds(train, target, key, seed, k))
    # every row trains the k - 1 folds it is not in: fit and undersampling count it once, by its fold
    training = HeldOut("fold", "grp", k)
    pre = prep.fit_preprocessor(folded, features, max_groups=k, held_out=training)
    pre.stats = cut_lineage(pre.stats)
    bal = sampling.undersample(folded, target, key, seed, max_groups=k, held_out=training)
    members = margin.Members({g: sampling.member_column(g) for g in range(k)}, pre.by_group())
    fitted = stored(bal.select(*members.columns.values(), target, *features))
    valid = pre.transform(folded.withColumn("grp", F.col("fold"))).select("grp", target, *features)
    gammas = _gammas(fitted, "grp", features, gamma_grid, members)
    grid = [(f, c, g) for f in range(k) for c in c_grid for g in gamma_grid]
    specs = [margin.ModelSpec(i, f, gammas[f, g], float(c)) for i, (f, c, g) in enumerate(grid)]
    names = {i: (f"C={c},gamma={g}", float(c), str(g), f) for i, (f, c, g) in enumerate(grid)}
    models = margin.fit_grid(fitted, "grp", features, target, specs, seed, dim, members)
    return _cv_result(train.sparkSession, specs, names, models, valid, features, target, seed, dim,
                      [f"C={c},gamma={g}" for c in c_grid for g in gamma_grid])


def _gammas(scaled: DataFrame, group_col: str, features: list[str], gamma_grid: list, members: margin.Members | None = None) -> dict:
    """(group, grid value) -> kernel width; 'scale' is 1 / (features x variance of all values), one pass. Rows shared by
    ``members`` are scaled by each group's statistics."""
    n = len(features)
    total = sum((F.col(c) for c in features), F.lit(0.0))
    squares = sum((F.col(c) * F.col(c) for c in features), F.lit(0.0))
    if members:
        moments = margin.scaled_sums(scaled, features, members)
        rows = [{group_col: g, "m": m / (size * n), "q": q / (size * n)} for g, (size, m, q) in moments.items()]
    else:
        rows = scaled.groupBy(group_col).agg((F.avg(total) / n).alias("m"), (F.avg(squares) / n).alias("q")).collect()
    out = {}
    for r in rows:      # one row per group
        variance = r["q"] - r["m"] ** 2
        named = {"auto": 1.0 / n, "scale": 1.0 / (n * variance) if variance > 0 else 1.0}
        out |= {(r[group_col], g): named[g] if g in named else float(g) for g in gamma_grid}
    return out


def rbf_svm_fit_evaluate(train: DataFrame, test: DataFrame, features: list[str], key: str, target: str,
                         seed: int, cv: CVResult, dim: int = RANDOM_FEATURES) -> DataFrame:
    """Refit the best parameters on the whole training split, score the test split: the metrics
    record with confusion matrix, AUC, AP, best parameters and the CV mean/std (M2)."""
    best = cv.best
    pre = prep.fit_preprocessor(train, features)
    bal = sampling.undersample(pre.transform(train), target, key, seed).select(F.lit(0).alias("grp"), key, target, *features)
    bal = stored(bal)
    gamma = _gammas(bal, "grp", features, [best["gamma"]])[0, best["gamma"]]
    spec = margin.ModelSpec(0, 0, gamma, float(best["C"]))
    model = margin.fit_grid(bal, "grp", features, target, [spec], seed, dim)[0]
    scored = margin.score(pre.transform(test).select(key, target, *features), features, gamma, model, dim, seed)
    pred = stored(scored.select(key, target, "score", "pred"))   # read by confusion, AUC and AP
    rec_ = met.metrics_record(pred, target, "pred", "score")
    return rec_.select("*", F.struct(F.lit(best["C"]).alias("C"), F.lit(best["gamma"]).alias("gamma"))
                       .alias("best_parameters"),
                       F.lit(best["mean_f1"]).alias("cv_f1_mean"), F.lit(best["std_f1"]).alias("cv_f1_std"))


def kernel_svm_evaluate(train: DataFrame, test: DataFrame, run: sampling.Run, machine: km.Machine, features: list[str], k: int,
                        key: str = "row_key", target: str = "y") -> DataFrame:
    """M3 with refit and prediction: the metrics record of the whole test split, the chosen C and the CV mean and std."""
    data = prepare_runs(train, [run], features, key, target)
    fitted = train_machines(data, [machine], features, k, key, target)
    best = fitted.table.where("rank = 1").first()
    scorer = km.MultiRunScorer(fitted.coefficients, data.stats, [machine], features)
    scored = test.select(key, target, scorer.score_column(test, run.run_id, machine.name).alias("score"))
    scored = cut_lineage(scored.withColumn("pred", (F.col("score") > 0).cast("int")))  # read by confusion, AUC and AP
    out = met.metrics_record(scored, target, "pred", "score")
    return out.select("*", F.lit(best["C"]).alias("C"), F.lit(best["mean_f1"]).alias("cv_f1_mean"), F.lit(best["std_f1"]).alias("cv_f1_std"))
