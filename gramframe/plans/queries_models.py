"""Phase 5/6 queries: run-grid studies, reports, margin classifiers, and the bench queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import recursions as rec
from ..functions.columns import r6
from ..operators import kernel_machine as km
from ..operators import kernel_stats as ks
from ..operators import kernels, metrics, models, prep, report, sampling
from ..operators.encode import encode_angles
from ..session import stored
from ..sources.fixtures import FEATURES, KEY, TARGET
from .params import (BASELINE_SEED, C_GRID, CIRCUIT_REPETITIONS, CV_FOLDS, FEATURE_MAPS, GAMMA_GRID,
                     MAP_REPEATS, MAP_STUDY_SEED_OFFSET, REPEATS, SEED, SUBSET_SIZES)
from .queries_kernels import N
from .queries_sampling import SUBSET, subset_w, test_w, train_w, whole_w
from .registry import query

ANGLES = [f"a{q}" for q in range(N)]


def comparison(spark, sf_dir, feature_map):
    runs = sampling.comparison_runs(SUBSET_SIZES, REPEATS, SEED)
    data = models.prepare_runs(train_w(spark, sf_dir), runs, FEATURES, KEY, TARGET)
    return models.compare_models(data, test_w(spark, sf_dir), runs, feature_map, CIRCUIT_REPETITIONS, FEATURES, TARGET)


@query("q_compare_models_pauli")
def q_compare_models_pauli(spark, sf_dir):
    """M5 (deterministic classifiers): 3 sizes x 5 repeats, every run scores the whole test split."""
    c = comparison(spark, sf_dir, "pauli")
    return c.select("model", "subset_size", "repeat", *[r6(m).alias(m) for m in models.SIX])


@query("q_compare_models_custom")
def q_compare_models_custom(spark, sf_dir):
    """Same grid with the custom map (two repetitions, Arrow recursion); rows-only check."""
    c = comparison(spark, sf_dir, "custom")
    return c.select("model", "subset_size", "repeat", *[r6(m).alias(m) for m in models.SIX])


@query("q_comparison_mean")
def q_comparison_mean(spark, sf_dir):
    m = report.comparison_mean(comparison(spark, sf_dir, "pauli"))
    return m.select("model", "subset_size", *[r6(c).alias(c) for c in report.MEAN_METRICS])


@query("q_comparison_spread")
def q_comparison_spread(spark, sf_dir):
    s = report.comparison_spread(comparison(spark, sf_dir, "pauli"))
    return s.select("model", "subset_size", r6("mean").alias("mean"), r6("std").alias("std"), "runs")


def _study_data(spark, sf_dir):
    runs = sampling.map_study_runs(SUBSET, MAP_REPEATS, SEED + MAP_STUDY_SEED_OFFSET)
    return runs, models.prepare_runs(train_w(spark, sf_dir), runs, FEATURES, KEY, TARGET)


@query("q_map_study")
def q_map_study(spark, sf_dir):
    """M4 (deterministic classifier): maps x repeats, mean 5-fold F1 on each 64-row subset."""
    runs, data = _study_data(spark, sf_dir)
    st = models.map_study(data, runs, FEATURE_MAPS, CIRCUIT_REPETITIONS, N, CV_FOLDS, KEY, TARGET)
    return st.select("feature_map", "repeat", r6("cv_f1").alias("cv_f1"))


@query("q_choose_map")
def q_choose_map(spark, sf_dir):
    """Mean CV F1 per map, rank 1 = chosen (ties: first name)."""
    runs, data = _study_data(spark, sf_dir)
    st = models.map_study(data, runs, FEATURE_MAPS, CIRCUIT_REPETITIONS, N, CV_FOLDS, KEY, TARGET)
    return report.choose_by_mean(st, "feature_map", "cv_f1").select("feature_map", r6("mean").alias("mean"), "rank")


@query("q_cv_summary")
def q_cv_summary(spark, sf_dir):
    """A20 over fold scores: each map is a parameter set; mean and population std across folds."""
    runs, data = _study_data(spark, sf_dir)
    tables = []
    for m in FEATURE_MAPS:
        fs = models.fold_scores(data, m, CIRCUIT_REPETITIONS, N, CV_FOLDS, KEY, TARGET)
        tables.append(fs.select(F.lit(m).alias("params"), F.lit(None).cast("double").alias("C"),
                                F.lit(None).cast("string").alias("gamma"), "fold", "f1"))
    allf = tables[0].unionByName(tables[1]).unionByName(tables[2])
    s = report.cv_summary(allf, FEATURE_MAPS)
    return s.select("params", r6("mean_f1").alias("mean_f1"), r6("std_f1").alias("std_f1"), "folds", "rank")


@query("q_rbf_svm_cv")
def q_rbf_svm_cv(spark, sf_dir):
    """M1: RBF baseline (random features + LinearSVC), 3 C x 3 gamma x 5 folds on the training split."""
    cv = models.rbf_svm_cv(train_w(spark, sf_dir), FEATURES, KEY, TARGET, BASELINE_SEED, CV_FOLDS,
                           C_GRID, GAMMA_GRID)
    return cv.summary


@query("q_rbf_svm_eval")
def q_rbf_svm_eval(spark, sf_dir):
    """M2: refit of the best parameters, test-split metrics record."""
    train = stored(train_w(spark, sf_dir))   # read by the passes of both
    cv = models.rbf_svm_cv(train, FEATURES, KEY, TARGET, BASELINE_SEED, CV_FOLDS, C_GRID, GAMMA_GRID)
    return models.rbf_svm_fit_evaluate(train, test_w(spark, sf_dir), FEATURES, KEY, TARGET, BASELINE_SEED, cv)


def _one_run(spark, sf_dir, feature_map):
    """The 64-row subset as a run of its own, with a kernel SVM for the map."""
    run = sampling.Run(0, SUBSET, SEED)
    return run, km.Machine("QSVM", feature_map, CIRCUIT_REPETITIONS, tuple(C_GRID))


@query("q_kernel_svm_cv")
def q_kernel_svm_cv(spark, sf_dir):
    """M3: kernel SVM on the custom map's Gram matrix, C grid x 5 folds on the 64-row subset."""
    run, machine = _one_run(spark, sf_dir, "custom")
    data = models.prepare_runs(train_w(spark, sf_dir), [run], FEATURES, KEY, TARGET)
    table = km.cv_table(km.cross_validated(data.subsets, [machine], FEATURES, CV_FOLDS, KEY, TARGET), [machine], TARGET)
    return table.select("params", "C", r6("mean_f1").alias("mean_f1"), r6("std_f1").alias("std_f1"), "folds", "rank")


@query("q_kernel_svm_coefficients")
def q_kernel_svm_coefficients(spark, sf_dir):
    """M3: the refitted model as a table, one row per support vector."""
    run, machine = _one_run(spark, sf_dir, "custom")
    data = models.prepare_runs(train_w(spark, sf_dir), [run], FEATURES, KEY, TARGET)
    c = models.train_machines(data, [machine], FEATURES, CV_FOLDS, KEY, TARGET).coefficients
    return c.select(KEY, TARGET, "C", *[(F.round(x, 5) + F.lit(0.0)).alias(x) for x in ("coef", "intercept", "objective")])


@query("q_kernel_svm_eval")
def q_kernel_svm_eval(spark, sf_dir):
    """The refitted kernel SVM (pauli map) on the whole test split."""
    run, machine = _one_run(spark, sf_dir, "pauli")
    m = models.kernel_svm_evaluate(train_w(spark, sf_dir), test_w(spark, sf_dir), run, machine, FEATURES, CV_FOLDS, KEY, TARGET)
    return m.select("tn", "fp", "fn", "tp", "C", *[r6(c).alias(c) for c in [*metrics.METRIC_NAMES, "roc_auc", "average_precision", "cv_f1_mean", "cv_f1_std"]])


@query("q_two_kernel_eval")
def q_two_kernel_eval(spark, sf_dir):
    """M6: one classifier on two kernels (exact RBF vs its random-feature estimate), scored on
    the whole test split; one metrics row per kernel."""
    sub = subset_w(spark, sf_dir)
    pre = prep.fit_preprocessor(sub, FEATURES, rows_per_group=SUBSET)
    sub_s, test_s = pre.transform(sub), pre.transform(test_w(spark, sf_dir))
    gamma = kernels.gamma_value(sub_s, FEATURES, "scale").first()["gamma"]
    g = gamma ** 0.5
    sub_g = sub_s.select(KEY, TARGET, "position", *[(F.col(c) * g).alias(c) for c in FEATURES])
    test_g = test_s.select(KEY, TARGET, *[(F.col(c) * g).alias(c) for c in FEATURES])
    lm = ks.class_mean_coefficients(sub_g, TARGET)
    exact = ks.kernel_scores(test_g, lm, models.rbf_unit, FEATURES)
    dim = 256
    approx = ks.kernel_scores(test_s, ks.class_mean_coefficients(sub_s, TARGET),
                              models.rff_kernel(gamma, dim, SEED, N), FEATURES)
    both = exact.select(TARGET, "score", F.lit("exact").alias("kernel")).unionByName(
        approx.select(TARGET, "score", F.lit("random_features").alias("kernel")))
    both = stored(both.withColumn("pred", (F.col("score") > 0).cast("int")))   # read by confusion, AUC and AP
    m = metrics.metrics_record(both, TARGET, "pred", "score", ["kernel"], max_groups=2)
    return m.select("kernel", "tn", "fp", "fn", "tp", *[r6(c).alias(c) for c in metrics.METRIC_NAMES],
                    r6("roc_auc").alias("roc_auc"), r6("average_precision").alias("average_precision"))


# ---------------------------------------------------------------- bench queries (whole W)
def _whole_w_encoded(spark, sf_dir):
    """All W rows scaled by the 64-row subset's fit, with angles; the subset as landmarks."""
    sub = subset_w(spark, sf_dir)
    pre = prep.fit_preprocessor(sub, FEATURES, rows_per_group=SUBSET)
    sub_e = encode_angles(pre.transform(sub), FEATURES)
    all_rows = whole_w(spark, sf_dir)      # every W row, stored once
    all_e = encode_angles(pre.transform(all_rows), FEATURES)
    return sub_e, all_e


@query("q_bench_preprocess")
def q_bench_preprocess(spark, sf_dir):
    """Fit on all W rows (distributed exact medians + moments), transform all W rows."""
    w = whole_w(spark, sf_dir)   # the five-way join stored once, read by every pass
    pre = prep.fit_preprocessor(w, FEATURES)
    t = pre.transform(w)
    pairs = ", ".join(f"'{c}', `{c}`" for c in FEATURES)
    long = t.selectExpr(f"stack({N}, {pairs}) as (feature, v)")
    return long.groupBy("feature").agg(r6(F.avg("v")).alias("mean"), r6(F.var_pop("v")).alias("var"),
                                       F.count(F.lit(1)).alias("rows"))


def _kernel_summary(k):
    return k.agg(F.count(F.lit(1)).alias("entries"), r6(F.avg("k")).alias("mean_k"),
                 r6(F.min("k")).alias("min_k"), r6(F.max("k")).alias("max_k"))


@query("q_bench_kernel_pauli")
def q_bench_kernel_pauli(spark, sf_dir):
    sub_e, all_e = _whole_w_encoded(spark, sf_dir)
    return _kernel_summary(kernels.fidelity_kernel(all_e, sub_e, "pauli", CIRCUIT_REPETITIONS, N))


@query("q_bench_kernel_custom_r2")
def q_bench_kernel_custom_r2(spark, sf_dir):
    sub_e, all_e = _whole_w_encoded(spark, sf_dir)
    return _kernel_summary(kernels.fidelity_kernel(all_e, sub_e, "custom", CIRCUIT_REPETITIONS, N))


@query("q_bench_ranking_metrics")
def q_bench_ranking_metrics(spark, sf_dir):
    sub_e, all_e = _whole_w_encoded(spark, sf_dir)
    lm = ks.class_mean_coefficients(sub_e, TARGET)
    s = ks.kernel_scores(all_e, lm, rec.fidelity_kernel("pauli", CIRCUIT_REPETITIONS), ANGLES)
    s = s
    r = metrics.ranking_metrics(s, TARGET, "score")
    return r.select(r6("roc_auc").alias("roc_auc"), r6("average_precision").alias("average_precision"))


@query("q_summary")
def q_summary(spark, sf_dir):
    """M7: the whole study (baseline, map study, comparison, kernel diagnostics) as one nested
    summary row."""
    from .study import run_study
    return run_study(spark, sf_dir)


def trained_study(spark, sf_dir):
    runs, data = _study_data(spark, sf_dir)
    return models.trained_map_study(data, runs, FEATURE_MAPS, CIRCUIT_REPETITIONS, FEATURES, CV_FOLDS, C_GRID, KEY, TARGET)


def trained_comparison(spark, sf_dir, feature_map):
    runs = sampling.comparison_runs(SUBSET_SIZES, REPEATS, SEED)
    return models.compare_trained(train_w(spark, sf_dir), test_w(spark, sf_dir), runs, feature_map, CIRCUIT_REPETITIONS, FEATURES,
                                  CV_FOLDS, C_GRID, GAMMA_GRID, KEY, TARGET)


@query("q_map_study_svm")
def q_map_study_svm(spark, sf_dir):
    """M4: maps x repeats, best mean 5-fold F1 of a kernel SVM over the C grid on each 64-row subset."""
    return trained_study(spark, sf_dir).select("feature_map", "repeat", "C", r6("cv_f1").alias("cv_f1"))


@query("q_compare_svm_pauli")
def q_compare_svm_pauli(spark, sf_dir):
    """M5 for one map: 3 sizes x 5 repeats, both SVMs tuned per run, all runs scoring the whole test split."""
    c = trained_comparison(spark, sf_dir, "pauli")
    return c.select("model", "subset_size", "repeat", *[r6(m).alias(m) for m in models.SIX])


@query("q_compare_models")
def q_compare_models(spark, sf_dir):
    """M5 as in the study: the feature map chosen by the trained map study (A19), then both tuned SVMs over
    sizes x repeats scoring the whole test split (rows-only; the pauli variant has an oracle)."""
    chosen = report.choose_by_mean(trained_study(spark, sf_dir), "feature_map", "cv_f1").where(F.col("rank") == 1).first()["feature_map"]
    c = trained_comparison(spark, sf_dir, chosen)
    return c.select(F.lit(chosen).alias("feature_map"), "model", "subset_size", "repeat",
                    *[r6(m).alias(m) for m in models.SIX])


@query("q_rbf_expansion_metrics")
def q_rbf_expansion_metrics(spark, sf_dir):
    """J5 + J12 + A13-A16: the whole test split scored by RBF kernel expansion ('scale' gamma)
    against the 64-row subset (class-mean weights), then the full metrics record."""
    sub = subset_w(spark, sf_dir)
    pre = prep.fit_preprocessor(sub, FEATURES, rows_per_group=SUBSET)
    sub_s, test_s = pre.transform(sub), pre.transform(test_w(spark, sf_dir))
    gamma = kernels.gamma_value(sub_s, FEATURES, "scale").first()["gamma"]
    g = gamma ** 0.5
    sub_g = sub_s.select(KEY, TARGET, "position", *[(F.col(c) * g).alias(c) for c in FEATURES])
    test_g = test_s.select(KEY, TARGET, *[(F.col(c) * g).alias(c) for c in FEATURES])
    s = ks.kernel_scores(test_g, ks.class_mean_coefficients(sub_g, TARGET), models.rbf_unit, FEATURES)
    s = s.withColumn("pred", (F.col("score") > 0).cast("int"))
    m = metrics.metrics_record(s, TARGET, "pred", "score")
    return m.select("tn", "fp", "fn", "tp", *[r6(c).alias(c) for c in metrics.METRIC_NAMES],
                    r6("roc_auc").alias("roc_auc"), r6("average_precision").alias("average_precision"))
