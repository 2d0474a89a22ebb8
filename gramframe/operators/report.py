"""Reports over run tables: comparison means and spreads, argmax choices, CV summaries,
and the one-row nested summary document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MEAN_METRICS = ["accuracy", "balanced_accuracy", "f1", "false_positive_rate"]


def comparison_mean(results: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Mean of the metrics by (model, subset_size)."""
    metrics = metrics or MEAN_METRICS
    return results.groupBy("model", "subset_size").agg(*[F.avg(m).alias(m) for m in metrics])


def comparison_spread(results: DataFrame, metric: str = "f1") -> DataFrame:
    """Mean and sample standard deviation of F1 by (model, subset_size); one run -> 0."""
    return results.groupBy("model", "subset_size").agg(
        F.avg(metric).alias("mean"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("std"),
        F.count(F.lit(1)).alias("runs"))


def choose_by_mean(table: DataFrame, name_col: str, value_col: str) -> DataFrame:
    """Mean per name, ranked by mean descending then name ascending; rank 1 is chosen."""
    means = table.groupBy(name_col).agg(F.avg(value_col).alias("mean"))
    w = Window.orderBy(F.desc("mean"), F.asc(name_col))  # over the few distinct names
    return means.withColumn("rank", F.row_number().over(w).cast("int"))


def cv_summary(fold_scores: DataFrame, grid_order: list[str]) -> DataFrame:
    """Per parameter set the mean and population std of the fold scores; rank by mean
    descending, ties broken by the position in the parameter grid (first wins)."""
    order = F.array_position(F.array(*[F.lit(p) for p in grid_order]), F.col("params"))
    agg = fold_scores.groupBy("params", "C", "gamma").agg(
        F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("std_f1"), F.count(F.lit(1)).alias("folds"))
    w = Window.orderBy(F.desc("mean_f1"), order)
    return agg.withColumn("rank", F.row_number().over(w).cast("int"))


def strip_prefix(params: DataFrame, col: str = "params", prefix: str = "svm__") -> DataFrame:
    """Parameter names without the pipeline-step prefix."""
    return params.withColumn(col, F.regexp_replace(F.col(col), f"(^|,){prefix}", "$1"))
