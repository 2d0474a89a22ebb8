"""Phase 2 queries: split, subsets, folds, samples, run grid, preprocessing fits, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import metrics as met
from ..operators import prep, sampling
from ..session import cut_lineage, stored
from ..sources.fixtures import FEATURES, KEY, TARGET, fixture_d, fixture_w
from .params import CV_FOLDS, REMOTE_SUBSET, REPEATS, SEED, SUBSET_SIZES, TEST_SIZE
from .registry import query

SUBSET = max(SUBSET_SIZES)


_MATERIALIZED: dict = {}


def whole_w(spark, sf_dir):
    """W, stored once: the split, the fits and the scoring jobs read columns of it, so the five-way join runs once."""
    key = (spark.sparkContext.applicationId, sf_dir, "W")
    if key not in _MATERIALIZED:
        _MATERIALIZED[key] = stored(fixture_w(spark, sf_dir))
    return _MATERIALIZED[key]


def split_w(spark, sf_dir):
    """W with its train/test split: a filter expression over the stored table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MATERIALIZED:
        _MATERIALIZED[key] = sampling.stratified_split(whole_w(spark, sf_dir), TARGET, KEY, SEED, TEST_SIZE)
    return _MATERIALIZED[key]


def clear_materialized() -> None:
    """Forget checkpointed inputs (the bench times every query from the parquet files)."""
    _MATERIALIZED.clear()


def train_w(spark, sf_dir):
    return split_w(spark, sf_dir).where(F.col("split") == "train").drop("split")


def test_w(spark, sf_dir):
    return split_w(spark, sf_dir).where(F.col("split") == "test").drop("split")


def subset_w(spark, sf_dir, size=SUBSET, seed=SEED):
    """Balanced subset of the training split, checkpointed (at most `size` rows): the fit, the
    landmark collection and the queries read it without re-running the window."""
    key = (spark.sparkContext.applicationId, sf_dir, "subset", size, seed)
    if key not in _MATERIALIZED:
        _MATERIALIZED[key] = cut_lineage(sampling.balanced_subset(train_w(spark, sf_dir), TARGET, KEY, size, seed))
    return _MATERIALIZED[key]


@query("q_stratified_split")
def q_stratified_split(spark, sf_dir):
    return split_w(spark, sf_dir).select(KEY, TARGET, "split")


@query("q_split_allocation")
def q_split_allocation(spark, sf_dir):
    counts = sampling.class_counts(fixture_w(spark, sf_dir), TARGET)
    return sampling.split_allocation(counts, TARGET, TEST_SIZE)


@query("q_balanced_subset")
def q_balanced_subset(spark, sf_dir):
    return subset_w(spark, sf_dir).select(KEY, TARGET, "position")


@query("q_balanced_subset_runs")
def q_balanced_subset_runs(spark, sf_dir):
    runs = sampling.comparison_runs(SUBSET_SIZES, REPEATS, SEED)
    subs = sampling.balanced_subsets(train_w(spark, sf_dir), TARGET, KEY, runs)
    return subs.select("run_id", "size", "seed", KEY, TARGET, "position")


@query("q_undersample")
def q_undersample(spark, sf_dir):
    d = sampling.stratified_split(fixture_d(spark, sf_dir), TARGET, KEY, SEED, TEST_SIZE)
    train = d.where(F.col("split") == "train")
    return sampling.undersample(train, TARGET, KEY, SEED).select(KEY, TARGET)


@query("q_stratified_folds")
def q_stratified_folds(spark, sf_dir):
    return sampling.stratified_folds(train_w(spark, sf_dir), TARGET, KEY, SEED, CV_FOLDS) \
        .select(KEY, TARGET, "fold")


@query("q_uniform_sample")
def q_uniform_sample(spark, sf_dir):
    return sampling.uniform_sample(test_w(spark, sf_dir), KEY, SEED, REMOTE_SUBSET).select(KEY, TARGET)


@query("q_run_grid")
def q_run_grid(spark, sf_dir):
    """Every run of the map study and the comparison, with its seed and whether the
    training split has enough rows per class for it."""
    from .params import FEATURE_MAPS, MAP_REPEATS, MAP_STUDY_SEED_OFFSET
    counts = train_w(spark, sf_dir).agg(
        F.count_if(F.col(TARGET) == 0).alias("n0"), F.count_if(F.col(TARGET) == 1).alias("n1"))
    grid = []
    rid = 0
    for m in FEATURE_MAPS:
        for r in range(MAP_REPEATS):
            grid.append(("map_study", m, SUBSET, r, SEED + MAP_STUDY_SEED_OFFSET + r))
    for s in SUBSET_SIZES:
        for r in range(REPEATS):
            grid.append(("compare", None, s, r, SEED + 100 * s + r))
    arr = F.array(*[F.struct(F.lit(i).alias("run_id"), F.lit(k).alias("kind"),
                             F.lit(m).cast("string").alias("feature_map"), F.lit(s).alias("subset_size"),
                             F.lit(r).alias("repeat"), F.lit(sd).alias("seed"))
                    for i, (k, m, s, r, sd) in enumerate(grid)])
    return counts.select(F.explode(arr).alias("g"), "n0", "n1").select(
        "g.*", ((F.col("n0") >= F.col("g.subset_size") / 2) & (F.col("n1") >= F.col("g.subset_size") / 2))
        .alias("feasible"))


@query("q_lookup_rows")
def q_lookup_rows(spark, sf_dir):
    w = fixture_w(spark, sf_dir)
    keys = subset_w(spark, sf_dir).select(KEY)
    return w.join(F.broadcast(keys), KEY, "left_semi").select(KEY, *FEATURES, TARGET)


@query("q_fit_median")
def q_fit_median(spark, sf_dir):
    """Whole-table exact medians of the training split (distributed path)."""
    med = prep.exact_medians_distributed(train_w(spark, sf_dir), FEATURES, [])
    return med.select("feature", r6("median").alias("median"))


@query("q_fit_scaler")
def q_fit_scaler(spark, sf_dir):
    """Median, mean and population sd after imputation, fitted on the whole training split.

    Mean and sd are raw magnitudes (up to ~1e6): at 6 decimals they would depend on the order
    of a floating sum, so they are reported at 4 decimals (the medians are exact data values).
    """
    p = prep.fit_preprocessor(train_w(spark, sf_dir), FEATURES)
    pairs = ", ".join(f"'{c}', med_{c}, mu_{c}, sd_{c}" for c in FEATURES)
    return p.stats.selectExpr(f"stack({len(FEATURES)}, {pairs}) as (feature, median, mean, sd)") \
        .select("feature", r6("median").alias("median"),
                (F.round("mean", 4) + 0.0).alias("mean"), (F.round("sd", 4) + 0.0).alias("sd"))


@query("q_preprocess_fit_self")
def q_preprocess_fit_self(spark, sf_dir):
    sub = subset_w(spark, sf_dir)
    p = prep.fit_preprocessor(sub, FEATURES, rows_per_group=SUBSET)
    out = p.transform(sub)
    return out.select(KEY, TARGET, "position", *[r6(c).alias(c) for c in FEATURES])


@query("q_preprocess_train_test")
def q_preprocess_train_test(spark, sf_dir):
    """Fit on the balanced subset, apply to the entire test split."""
    p = prep.fit_preprocessor(subset_w(spark, sf_dir), FEATURES, rows_per_group=SUBSET)
    out = p.transform(test_w(spark, sf_dir))
    return out.select(KEY, TARGET, *[r6(c).alias(c) for c in FEATURES])


def _scored_docs(spark, sf_dir):
    """Documents with a text-shape score: lower-case share minus upper-case and other shares."""
    d = fixture_d(spark, sf_dir)
    score = F.coalesce(F.col("f7"), F.lit(0.0)) - F.coalesce(F.col("f4"), F.lit(0.0)) \
        - F.coalesce(F.col("f6"), F.lit(0.0))
    return d.select(KEY, TARGET, score.alias("score")) \
        .withColumn("pred", (F.col("score") > 0.5).cast("int"))


def _scored_lines(spark, sf_dir):
    """Test split of W with a tied score (quantity) and a threshold prediction."""
    t = test_w(spark, sf_dir)
    return t.select(KEY, TARGET, F.col("f0").alias("score"), (F.col("f0") > 25).cast("int").alias("pred"))


@query("q_confusion")
def q_confusion(spark, sf_dir):
    return met.confusion_counts(_scored_docs(spark, sf_dir), TARGET, "pred")


@query("q_metrics")
def q_metrics(spark, sf_dir):
    m = met.threshold_metrics(_scored_docs(spark, sf_dir), TARGET, "pred")
    return m.select("tn", "fp", "fn", "tp", *[r6(c).alias(c) for c in met.METRIC_NAMES])


@query("q_roc_auc")
def q_roc_auc(spark, sf_dir):
    r = met.ranking_metrics(_scored_lines(spark, sf_dir), TARGET, "score")
    return r.select(r6("roc_auc").alias("roc_auc"))


@query("q_average_precision")
def q_average_precision(spark, sf_dir):
    r = met.ranking_metrics(_scored_lines(spark, sf_dir), TARGET, "score")
    return r.select(r6("average_precision").alias("average_precision"))


@query("q_ranking_metrics_docs")
def q_ranking_metrics_docs(spark, sf_dir):
    r = met.ranking_metrics(_scored_docs(spark, sf_dir), TARGET, "score")
    return r.select(r6("roc_auc").alias("roc_auc"), r6("average_precision").alias("average_precision"))
