"""Phase 4 queries: outcome counts, matrix comparison, slicing, diagnostics, scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import recursions as rec
from ..functions.columns import r6
from ..operators import kernel_stats as ks
from ..operators import kernel_machine as km
from ..operators import kernels, low_rank, metrics, sampling, whole_kernel
from ..session import cut_lineage, stored
from ..sources.fixtures import KEY, TARGET, ZERO_OUTCOME, fixture_c, fixture_e
from .params import C_GRID, CIRCUIT_REPETITIONS, CV_FOLDS, REMOTE_SHOTS, SEED
from .queries_kernels import N, encoded
from .queries_sampling import SUBSET
from .registry import query


@query("q_outcome_probability")
def q_outcome_probability(spark, sf_dir):
    p = ks.outcome_probability(fixture_c(spark, sf_dir), ZERO_OUTCOME)
    return p.select("i", "j", r6("p").alias("p"), "shots")


@query("q_kernel_mirror")
def q_kernel_mirror(spark, sf_dir):
    p = ks.outcome_probability(ks.fold_cells(fixture_c(spark, sf_dir)), ZERO_OUTCOME)
    return ks.mirror_upper(p).select("i", "j", r6("k").alias("k"), "present")


def _full(spark, sf_dir, name, reps):
    sub_e, _ = encoded(spark, sf_dir)
    return sub_e, kernels.fidelity_kernel(sub_e, sub_e, name, reps, N)


@query("q_kernel_compare")
def q_kernel_compare(spark, sf_dir):
    """Two full subset matrices (pauli vs custom, one repetition each) entry by entry."""
    sub_e, a = _full(spark, sf_dir, "pauli", 1)
    b = kernels.fidelity_kernel(sub_e, sub_e, "custom", 1, N)
    c = ks.compare_kernels(a, b)
    return c.select("entries", *[r6(x).alias(x) for x in ("mean_abs_diff", "max_abs_diff", "diagonal_deviation")],
                    "only_first", "only_second")


def _estimates(spark, sf_dir):
    """The 64-row subset, 64 evaluation rows of the test split, and both of their kernels exact and from counts."""
    sub_e, test_e = encoded(spark, sf_dir)
    eval_e = cut_lineage(sampling.uniform_sample(test_e, KEY, SEED, SUBSET))
    upper = kernels.fidelity_kernel(sub_e, sub_e, "pauli", CIRCUIT_REPETITIONS, N, symmetric=True).select("i_key", "j_key", "k")
    cross = kernels.fidelity_kernel(eval_e, sub_e, "pauli", CIRCUIT_REPETITIONS, N)
    return sub_e, eval_e, {"exact": (ks.mirrored(upper), cross),
                           "counts": (ks.mirrored(ks.estimated_kernel(upper, REMOTE_SHOTS, SEED)), ks.estimated_kernel(cross, REMOTE_SHOTS, SEED))}


@query("q_kernel_compare_counts")
def q_kernel_compare_counts(spark, sf_dir):
    """The exact subset matrix against its estimate from outcome counts."""
    _, _, both = _estimates(spark, sf_dir)
    c = ks.compare_kernels(both["exact"][0], both["counts"][0])
    return c.select("entries", *[r6(x).alias(x) for x in ("mean_abs_diff", "max_abs_diff", "diagonal_deviation")], "only_first", "only_second")


@query("q_two_kernel_svm")
def q_two_kernel_svm(spark, sf_dir):
    """M6: kernel SVMs tuned and trained on the exact matrix and on its estimate from counts, each predicting with its own
    test matrix; one metrics row per kernel."""
    sub_e, eval_e, both = _estimates(spark, sf_dir)
    folds = cut_lineage(sampling.stratified_folds(sub_e.select(KEY, TARGET, "position"), TARGET, KEY, SEED, CV_FOLDS))
    train = rows = None
    for name, (gram, cross) in both.items():
        own = km.kernel_rows(gram, sub_e).withColumnRenamed("i_key", KEY).join(F.broadcast(folds), KEY).withColumn("model", F.lit(name))
        held = km.kernel_rows(cross, sub_e).withColumnRenamed("i_key", KEY).join(F.broadcast(eval_e.select(KEY, TARGET)), KEY).withColumn("model", F.lit(name))
        train, rows = (own, held) if train is None else (train.unionByName(own), rows.unionByName(held))
    pred = cut_lineage(km.precomputed_predictions(train, rows, CV_FOLDS, C_GRID, KEY, TARGET))
    m = metrics.metrics_record(pred, TARGET, "pred", "score", ["model", "C", "cv_f1"], max_groups=2)
    return m.select(F.col("model").alias("kernel"), "C", r6("cv_f1").alias("cv_f1"), "tn", "fp", "fn", "tp",
                    *[r6(c).alias(c) for c in metrics.METRIC_NAMES + ["roc_auc", "average_precision"]])


@query("q_kernel_fold_slice")
def q_kernel_fold_slice(spark, sf_dir):
    sub_e, k = _full(spark, sf_dir, "pauli", CIRCUIT_REPETITIONS)
    folds = sampling.stratified_folds(sub_e.select(KEY, TARGET), TARGET, KEY, SEED, CV_FOLDS)
    return ks.fold_slices(k, folds, KEY, k_folds=CV_FOLDS).withColumn("k", r6("k"))


def _diag(spark, sf_dir, name, reps):
    sub_e, _ = encoded(spark, sf_dir)
    k = kernels.fidelity_kernel(sub_e, sub_e, name, reps, N, symmetric=True)
    return ks.kernel_diagnostics(ks.attach_labels(k, sub_e.select(KEY, TARGET), KEY, TARGET))


@query("q_kernel_diagnostics")
def q_kernel_diagnostics(spark, sf_dir):
    d = _diag(spark, sf_dir, "custom", CIRCUIT_REPETITIONS)
    return d.select("n", *[r6(c).alias(c) for c in ("within_class_mean", "between_class_mean", "separation",
                                                    "off_diagonal_mean")])


@query("q_kernel_alignment")
def q_kernel_alignment(spark, sf_dir):
    d = _diag(spark, sf_dir, "pauli", CIRCUIT_REPETITIONS)
    return d.select(r6("kernel_target_alignment").alias("kernel_target_alignment"))


@query("q_kernel_spectrum")
def q_kernel_spectrum(spark, sf_dir):
    sub_e, _ = encoded(spark, sf_dir)
    k = kernels.fidelity_kernel(sub_e, sub_e, "custom", CIRCUIT_REPETITIONS, N, symmetric=True)
    return ks.kernel_spectrum(k)


@query("q_kernel_participation")
def q_kernel_participation(spark, sf_dir):
    sub_e, _ = encoded(spark, sf_dir)
    k = kernels.fidelity_kernel(sub_e, sub_e, "pauli", CIRCUIT_REPETITIONS, N, symmetric=True)
    p = ks.kernel_participation(k)
    return p.select(*[r6(c).alias(c) for c in ("trace", "frobenius2", "participation_ratio")])


@query("q_kernel_reorder")
def q_kernel_reorder(spark, sf_dir):
    sub_e, k = _full(spark, sf_dir, "pauli", CIRCUIT_REPETITIONS)
    return ks.reorder_by_class(k, sub_e, KEY, TARGET).withColumn("k", r6("k"))


def scored_test(spark, sf_dir, name="pauli", reps=CIRCUIT_REPETITIONS):
    """Whole test split scored against the 64 landmarks with class-mean weights."""
    sub_e, test_e = encoded(spark, sf_dir)
    lm = ks.class_mean_coefficients(sub_e, TARGET)
    s = ks.kernel_scores(test_e, lm, rec.fidelity_kernel(name, reps), [f"a{q}" for q in range(N)])
    return s.withColumn("pred", (F.col("score") > 0).cast("int"))


@query("q_kernel_score")
def q_kernel_score(spark, sf_dir):
    s = scored_test(spark, sf_dir)
    return s.select(KEY, TARGET, r6("score").alias("score"), "pred")


@query("q_kernel_score_metrics")
def q_kernel_score_metrics(spark, sf_dir):
    s = scored_test(spark, sf_dir)
    m = metrics.metrics_record(s, TARGET, "pred", "score")
    return m.select("tn", "fp", "fn", "tp", *[r6(c).alias(c) for c in metrics.METRIC_NAMES + ["roc_auc", "average_precision"]])


@query("q_vectors_diagnostics")
def q_vectors_diagnostics(spark, sf_dir):
    """A9, A10, A12 over all pairs of the whole embeddings table, from second and fourth moments (no pair is formed)."""
    d = whole_kernel.vector_kernel_diagnostics(fixture_e(spark, sf_dir), "vec", TARGET, 64)
    return d.select("n", *[r6(c).alias(c) for c in d.columns[1:]])


LOW_RANK = 24


def _low_rank(spark, sf_dir):
    rows = stored(fixture_e(spark, sf_dir).select(KEY, "vec"))  # read once a pass
    return rows, low_rank.fit(rows, KEY, "vec", 64, low_rank.SquaredProduct(), LOW_RANK)


@query("q_kernel_low_rank")
def q_kernel_low_rank(spark, sf_dir):
    """J9 re-aimed: pivots of the kernel over the whole embeddings table and the trace that each step leaves."""
    rows, model = _low_rank(spark, sf_dir)
    s = low_rank.steps(rows, KEY, "vec", model)
    return s.select("step", KEY, *[r6(c).alias(c) for c in ("pivot_residual", "trace", "residual_trace")])


@query("q_kernel_low_rank_factors")
def q_kernel_low_rank_factors(spark, sf_dir):
    """J9 re-aimed: the factors of every embeddings row, one row per table row."""
    rows, model = _low_rank(spark, sf_dir)
    f = low_rank.factors(rows, KEY, "vec", model)
    return f.select(KEY, F.posexplode("factors").alias("i", "v"), "residual").select(
        KEY, (F.col("i") + 1).alias("step"), (F.round("v", 5) + 0.0).alias("factor"), (F.round("residual", 5) + 0.0).alias("residual"))
