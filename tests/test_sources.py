"""Sinks, job parameters and report helpers."""

from pyspark.sql import functions as F

from gramframe.operators import report
from gramframe.sources import sinks
from gramframe.sources.config import StudyConfig, from_mapping


def test_config_precedence_and_quick():
    cfg = from_mapping({"seed": 5, "cv_folds": 3, "remote": {"subset_size": 12}}, cv_folds=4)
    assert cfg.seed == 5 and cfg.cv_folds == 4 and cfg.remote_subset_size == 12
    q = StudyConfig().quick()
    assert q.feature_maps == ("custom",) and q.subset_sizes == (16,) and q.repeats == 1
    assert q.map_repeats == 1 and q.cv_folds == 2 and q.output_dir == StudyConfig().output_dir
    assert from_mapping({"seed": 5}, seed=0).seed == 0 and from_mapping({}, seed=None).seed == StudyConfig().seed


def test_sinks_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(0, "a", 1.5), (1, "b", 2.5)], "run_id int, i_key string, k double")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    nested = df.select(F.struct("i_key", "k").alias("s"), F.array(F.array(F.lit(1), F.lit(2))).alias("cm"))
    sinks.write_json(nested, str(tmp_path / "json"))
    back = spark.read.json(str(tmp_path / "json")).first()
    assert back["cm"] == [[1, 2]]
    sinks.write_kernel(df, str(tmp_path / "kernel"))
    assert sorted(r["run_id"] for r in spark.read.parquet(str(tmp_path / "kernel")).collect()) == [0, 1]


def test_strip_prefix_and_spread(spark):
    p = spark.createDataFrame([("svm__C=1,svm__gamma=scale",)], "params string")
    assert report.strip_prefix(p).first()["params"] == "C=1,gamma=scale"
    res = spark.createDataFrame([("A", 16, 0.5), ("A", 32, 0.6), ("A", 32, 0.8)], "model string, subset_size int, f1 double")
    out = {(r["model"], r["subset_size"]): (r["mean"], r["std"]) for r in report.comparison_spread(res).collect()}
    assert out[("A", 16)] == (0.5, 0.0)
    assert abs(out[("A", 32)][1] - 0.1414213562) < 1e-9


def test_choose_by_mean_ties(spark):
    t = spark.createDataFrame([("zz", 0.5), ("custom", 0.5), ("pauli", 0.4)], "feature_map string, cv_f1 double")
    ranked = {r["feature_map"]: r["rank"] for r in report.choose_by_mean(t, "feature_map", "cv_f1").collect()}
    assert ranked["custom"] == 1 and ranked["zz"] == 2 and ranked["pauli"] == 3


def test_whole_study_quick_profile_with_sinks(spark, tmp_path):
    """M7 end to end with the quick profile: every sink is written and the summary is whole."""
    from conftest import SF001
    from gramframe.plans.study import run_study
    out = str(tmp_path / "results")
    doc = run_study(spark, SF001, StudyConfig().quick(), output_dir=out).first().asDict(recursive=True)
    assert doc["selected_feature_map"] == "custom" and doc["n_qubits"] == 9
    assert doc["data"]["rows"] == 6000 and doc["data"]["features"] == 9
    assert len(doc["comparison_mean"]) == 2            # two models x one size
    assert spark.read.json(f"{out}/summary").count() == 1
    assert spark.read.json(f"{out}/classical_metrics").count() == 1
    assert spark.read.option("header", True).csv(f"{out}/feature_map_results").count() == 1
    assert spark.read.option("header", True).csv(f"{out}/model_comparison").count() == 2
    assert spark.read.parquet(f"{out}/kernel_matrix").count() == 16 * 17 // 2
