"""Quarantine, committed outputs, job parameters, parameter names."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import kernels, metrics, models, profile, report, sampling
from ..session import ensure_checkpoint_dir, stored
from ..sources.config import from_mapping
from ..sources.csv_io import CONTRACT_FEATURES, CONTRACT_TARGET
from ..sources.dataset import Contract, load, rejection_counts
from ..sources.fixtures import FEATURES, KEY, TARGET
from ..sources.outputs import Outputs
from .params import CIRCUIT_REPETITIONS
from .queries_kernels import N, encoded
from .queries_models import comparison, q_kernel_svm_cv
from .queries_sampling import whole_w
from .queries_stats import scored_test
from .registry import query


def _outputs(spark) -> Outputs:
    run = uuid.uuid4().hex
    return Outputs(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/outputs-{run}", run)


@query("q_sink_csv")
def q_sink_csv(spark, sf_dir):
    """The comparison table published as CSV, as read back."""
    c = comparison(spark, sf_dir, "pauli")
    return _outputs(spark).publish(c.select("model", "subset_size", "repeat", *[r6(m).alias(m) for m in models.SIX]), "model_comparison", "csv")


@query("q_sink_json")
def q_sink_json(spark, sf_dir):
    """The nested metrics record of the whole test split published as JSON, read back and flattened."""
    scored = stored(scored_test(spark, sf_dir).select(TARGET, "score", "pred"))   # read by confusion, AUC and AP
    m = metrics.metrics_record(scored, TARGET, "pred", "score")
    back = _outputs(spark).publish(m.select("confusion_matrix", F.struct(*[r6(c).alias(c) for c in [*metrics.METRIC_NAMES, "roc_auc", "average_precision"]])
                                            .alias("metrics")), "metrics", "json")
    cell = F.col("confusion_matrix")
    return back.select(cell[0][0].alias("tn"), cell[0][1].alias("fp"), cell[1][0].alias("fn"), cell[1][1].alias("tp"), "metrics.*")


@query("q_sink_kernel")
def q_sink_kernel(spark, sf_dir):
    """A kernel matrix published by class of its row; publishing one class again replaces that partition only."""
    sub_e, _ = encoded(spark, sf_dir)
    k = kernels.fidelity_kernel(sub_e, sub_e, "pauli", CIRCUIT_REPETITIONS, N, symmetric=True)
    k = k.join(F.broadcast(sub_e.select(F.col(KEY).alias("i_key"), F.col(TARGET).alias("i_class"))), "i_key")   # the subset's labels
    k = k.select("i_key", "j_key", r6("k").alias("k"), "i_class")
    out = _outputs(spark)
    out.publish(k.withColumn("k", F.when(F.col("i_class") == 1, -1.0).otherwise(F.col("k"))), "kernel", "parquet", ["i_class"])
    out.publish(k.where("i_class = 1"), "kernel", "parquet", ["i_class"])
    return out.read("kernel")


@query("q_sink_manifest")
def q_sink_manifest(spark, sf_dir):
    """What a run's manifest holds after three outputs, one of them published twice."""
    w, out = whole_w(spark, sf_dir), _outputs(spark)
    out.publish(profile.class_counts(w, TARGET), "class_counts", "csv")
    out.publish(profile.missing_counts(w, FEATURES), "missing_values", "json")
    for part in (w, w.where(F.col(TARGET) == 1)):
        out.publish(part.select(KEY, *FEATURES, TARGET), "features", "parquet", [TARGET])
    return out.manifest().select("name", "format", "version", "rows")


@query("q_config_split")
def q_config_split(spark, sf_dir):
    """Explicit values win over the file's, which win over the defaults: split sizes under the merged parameters."""
    cfg = from_mapping({"test_size": 0.4, "seed": 7, "remote": {"subset_size": 12}}, test_size=0.25, cv_folds=None)
    split = sampling.stratified_split(whole_w(spark, sf_dir), TARGET, KEY, cfg.seed, cfg.test_size)
    hashed = F.sum(F.conv(F.substring(F.md5(KEY), 1, 8), 16, 10).cast("long"))
    return split.groupBy(TARGET, "split").agg(F.count(F.lit(1)).alias("n"), hashed.alias("key_sum")).select(
        TARGET, "split", "n", "key_sum", F.lit(cfg.seed).alias("seed"), F.lit(cfg.cv_folds).alias("cv_folds"), F.lit(cfg.remote_subset_size).alias("remote_subset_size"))


@query("q_strip_prefix")
def q_strip_prefix(spark, sf_dir):
    """Pipeline-step prefixes removed from the parameter names of the CV table."""
    t = q_kernel_svm_cv(spark, sf_dir).withColumn("params", F.concat(F.lit("svm__"), "params"))
    return report.strip_prefix(t).select("params", "mean_f1", "rank")


@query("q_quarantine")
def q_quarantine(spark, sf_dir):
    """S1-S3 on a foreign file: W as CSV text in which the key's hash decides which rows are damaged and how; rejected
    rows by reason, and the rows that passed."""
    w = whole_w(spark, sf_dir)
    digit = F.substring(F.md5(KEY), 1, 1)
    columns = [F.col(f).cast("string").alias(c) for f, c in zip(FEATURES, CONTRACT_FEATURES)]
    columns[0] = F.when(digit == "0", "n/a").otherwise(F.col(FEATURES[0]).cast("string")).alias(CONTRACT_FEATURES[0])
    columns[2] = F.when(digit.isin("0", "3"), "-inf").otherwise(F.col(FEATURES[2]).cast("string")).alias(CONTRACT_FEATURES[2])
    label = F.when(digit == "1", "2").when(digit == "2", None).otherwise(F.col(TARGET).cast("string")).alias(CONTRACT_TARGET)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    w.select(KEY, *columns, label).write.option("header", True).csv(path)
    data = load(spark, path, Contract(tuple(CONTRACT_FEATURES), CONTRACT_TARGET, KEY))
    passed = data.rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit("accepted").alias("reason"), "n")
    return rejection_counts(data).unionByName(passed)
