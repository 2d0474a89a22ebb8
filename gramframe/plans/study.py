"""The whole study as Spark jobs: split -> baseline -> map study -> comparison -> kernel ->
diagnostics -> summary document (M7), with optional sinks (S4-S7).

Every step is a DataFrame job, over the fixture of the given tables or over a table of the user's own (a CSV or Parquet
path, or a DataFrame, with its contract). The summary is a join of one-row tables; the driver only learns the chosen map.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kernel_stats as ks
from ..operators import kernels, models, prep, profile, report, sampling
from ..operators.encode import encode_angles
from ..sources import sinks
from ..sources.config import StudyConfig
from ..sources.dataset import Contract, load
from ..sources.fixtures import FEATURES, KEY, TARGET, fixture_w
from ..sources.outputs import Outputs
from ..session import cut_lineage, stored
from .params import C_GRID, GAMMA_GRID

DIAGNOSTICS = ["within_class_mean", "between_class_mean", "separation", "kernel_target_alignment", "off_diagonal_mean"]


def _as_map(df: DataFrame, name: str, value: str, out: str) -> DataFrame:
    """One row with the (few) rows of ``df`` as a map."""
    entry = F.struct(F.col(name).cast("string").alias("key"), F.col(value).alias("value"))
    return df.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(out))


def _joined(tables: list[DataFrame]) -> DataFrame:
    """One-row tables side by side."""
    out = tables[0]
    for t in tables[1:]:
        out = out.crossJoin(F.broadcast(t))
    return out


def run_study(spark: SparkSession, data: str | DataFrame, cfg: StudyConfig | None = None, output_dir: str | None = None,
              contract: Contract | None = None, outputs: Outputs | None = None) -> DataFrame:
    """The summary row. ``data`` is a folder of the given tables or, with a ``contract``, the user's own table, of which
    rows that break the contract stay out (``sources.dataset.load`` returns them). ``output_dir`` gets plain
    files, ``outputs`` committed ones."""
    cfg = cfg or StudyConfig()
    if contract is None:
        w, features, target = fixture_w(spark, data), FEATURES, TARGET
    else:
        w, features, target = load(spark, data, contract).rows, list(contract.features), contract.target
        profile.validate_labels(w, target)
    w = stored(w)
    split = sampling.stratified_split(w, target, KEY, cfg.seed, cfg.test_size)
    train = stored(split.where(F.col("split") == "train").drop("split"))   # read by the passes of every step
    test = split.where(F.col("split") == "test").drop("split")
    n = len(features)

    # 1. baseline (impute -> scale -> undersample -> RBF margin model, CV inside the folds)
    cv = models.rbf_svm_cv(train, features, KEY, target, cfg.seed, cfg.cv_folds, C_GRID, GAMMA_GRID)
    classical = models.rbf_svm_fit_evaluate(train, test, features, KEY, target, cfg.seed, cv)

    # 2. feature-map study on the largest subset size, one subset per repeat
    size = max(cfg.subset_sizes)
    study_runs = sampling.map_study_runs(size, cfg.map_repeats, cfg.seed + 1000)
    study_data = models.prepare_runs(train, study_runs, features, KEY, target)
    study = models.trained_map_study(study_data, study_runs, list(cfg.feature_maps), cfg.circuit_repetitions, features,
                                     cfg.cv_folds, C_GRID, KEY, target)
    chosen = report.choose_by_mean(study, "feature_map", "cv_f1")
    selected = chosen.where(F.col("rank") == 1).first()["feature_map"]

    # 3. comparison of both models with the selected map over sizes x repeats
    runs = sampling.comparison_runs(list(cfg.subset_sizes), cfg.repeats, cfg.seed)
    comparison = models.compare_trained(train, test, runs, selected, cfg.circuit_repetitions, features, cfg.cv_folds,
                                        C_GRID, GAMMA_GRID, KEY, target)

    # 4. kernel of one more balanced subset, its diagnostics
    sub = cut_lineage(sampling.balanced_subset(train, target, KEY, size, cfg.seed))
    pre = prep.fit_preprocessor(sub, features, rows_per_group=size)
    sub_e = encode_angles(pre.transform(sub), features)
    kmat = kernels.fidelity_kernel(sub_e, sub_e, selected, cfg.circuit_repetitions, n, symmetric=True)
    diag = ks.kernel_diagnostics(ks.attach_labels(kmat, sub_e.select(KEY, target), KEY, target))
    spec = ks.kernel_spectrum(kmat)

    # 5. the summary document
    study, comparison, classical = cut_lineage(study), cut_lineage(comparison), cut_lineage(classical)   # read again below
    counts = _joined([
        profile.profile(w, features), _as_map(profile.class_counts(w, target), target, "n", "class_counts"),
        _as_map(profile.missing_counts(w, features), "feature", "n_missing", "missing_values"),
        profile.duplicate_rows(w, [*features, target]).select("duplicates")])
    diagnostics = _joined([diag.select(*DIAGNOSTICS), spec.select("min_eigenvalue", "effective_rank")])
    comparison_mean = report.comparison_mean(comparison)
    means = comparison_mean.agg(F.array_sort(F.collect_list(F.struct(*comparison_mean.columns))).alias("comparison_mean"))   # models x sizes
    doc = _joined([
        counts.select(F.struct("*").alias("data")), diagnostics.select(F.struct("*").alias("kernel_diagnostics")),
        classical.select(F.struct("*").alias("classical")), means]).select(
        "data", F.lit(selected).alias("selected_feature_map"), F.lit(n).alias("n_qubits"), "kernel_diagnostics", "classical", "comparison_mean")
    doc = cut_lineage(doc)

    if output_dir:
        sinks.write_json(classical, f"{output_dir}/classical_metrics")
        sinks.write_csv(study, f"{output_dir}/feature_map_results")
        sinks.write_csv(comparison, f"{output_dir}/model_comparison")
        sinks.write_kernel(kmat, f"{output_dir}/kernel_matrix")
        sinks.write_json(doc, f"{output_dir}/summary")
    if outputs:
        outputs.publish(classical, "classical_metrics", "json")
        outputs.publish(study, "feature_map_results", "csv")
        outputs.publish(comparison, "model_comparison", "csv")
        outputs.publish(cut_lineage(kmat), "kernel_matrix", "parquet")
        outputs.publish(doc.drop("data"), "summary", "json")
        outputs.publish(doc.select("data.*").select("rows", "features", "duplicates"), "data_summary", "json")
    return doc
