"""Classification metrics over (group..., y, pred[, score]) tables, all groups in one job.

Confusion counts are conditional counts (partial aggregation map-side). ROC AUC and average
precision are exact with ties: rows are first collapsed to one row per distinct score (with
positive/negative counts), then running counts in score order come from ``ordered_prefix``,
so no task holds a whole group's scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import safe_ratio
from .ranking import bounded_broadcast, ordered_prefix

METRIC_NAMES = ["accuracy", "balanced_accuracy", "precision", "recall", "f1",
                "specificity", "false_positive_rate"]


def confusion_counts(df: DataFrame, y: str = "y", pred: str = "pred",
                     group_cols: list[str] | None = None) -> DataFrame:
    """(group..., tn, fp, fn, tp) with label order [0, 1]."""
    group_cols = group_cols or []
    yc, pc = F.col(y), F.col(pred)
    return df.groupBy(*group_cols).agg(
        F.count_if((yc == 0) & (pc == 0)).alias("tn"),
        F.count_if((yc == 0) & (pc == 1)).alias("fp"),
        F.count_if((yc == 1) & (pc == 0)).alias("fn"),
        F.count_if((yc == 1) & (pc == 1)).alias("tp"),
    )


def metric_columns(tn: Column, fp: Column, fn: Column, tp: Column) -> list[Column]:
    """Threshold metrics from the four counts; a zero denominator gives 0.0.

    Balanced accuracy is the mean recall over the classes present among the true labels.
    """
    n = tn + fp + fn + tp
    pos, neg = tp + fn, tn + fp
    recall1 = F.try_divide(tp.cast("double"), pos.cast("double"))
    recall0 = F.try_divide(tn.cast("double"), neg.cast("double"))
    present = F.when(pos > 0, 1).otherwise(0) + F.when(neg > 0, 1).otherwise(0)
    balanced = F.coalesce(
        F.try_divide(F.coalesce(recall1, F.lit(0.0)) + F.coalesce(recall0, F.lit(0.0)), present.cast("double")),
        F.lit(0.0))
    return [
        safe_ratio(tp + tn, n).alias("accuracy"),
        balanced.alias("balanced_accuracy"),
        safe_ratio(tp, tp + fp).alias("precision"),
        safe_ratio(tp, pos).alias("recall"),
        safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        safe_ratio(tn, neg).alias("specificity"),
        safe_ratio(fp, neg).alias("false_positive_rate"),
    ]


def threshold_metrics(df: DataFrame, y: str = "y", pred: str = "pred",
                      group_cols: list[str] | None = None) -> DataFrame:
    """(group..., tn, fp, fn, tp, accuracy, ..., false_positive_rate)."""
    group_cols = group_cols or []
    cm = confusion_counts(df, y, pred, group_cols)
    return cm.select(*group_cols, "tn", "fp", "fn", "tp",
                     *metric_columns(F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp")))


def ranking_metrics(df: DataFrame, y: str = "y", score: str = "score",
                    group_cols: list[str] | None = None, *, max_groups: int = 1) -> DataFrame:
    """(group..., roc_auc, average_precision); both NULL unless the group has both classes.

    AUC  = sum_s pos(s) * (neg_below(s) + neg(s)/2) / (P * N)        (ties count one half)
    AP   = sum_s pos(s) * precision_at(s) / P, precision_at(s) = rows >= s that are positive
    """
    group_cols = group_cols or []
    per_score = df.groupBy(*group_cols, score).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    cum = ordered_prefix(per_score, group_cols, score, ["pos", "neg"], max_groups=max_groups)
    # totals from the running sums (read from the checkpoint: the scores are computed once)
    totals = cum.groupBy(*group_cols).agg(F.max("cum_pos").alias("P"), F.max("cum_neg").alias("N"))
    if group_cols:
        cum = cum.join(bounded_broadcast(totals, max_groups), group_cols)
    else:
        t = totals.first()
        cum = cum.withColumn("P", F.lit(t["P"]).cast("long")).withColumn("N", F.lit(t["N"]).cast("long"))
    neg_below = F.col("cum_neg") - F.col("neg")
    pos_at_or_above = F.col("P") - (F.col("cum_pos") - F.col("pos"))
    rows_at_or_above = pos_at_or_above + F.col("N") - neg_below
    agg = cum.groupBy(*group_cols).agg(
        F.sum(F.col("pos").cast("double") * (neg_below + F.col("neg") * 0.5)).alias("_auc_num"),
        F.sum(F.col("pos").cast("double") * pos_at_or_above / rows_at_or_above).alias("_ap_num"),
        F.first("P").alias("P"), F.first("N").alias("N"))
    both = (F.col("P") > 0) & (F.col("N") > 0)
    return agg.select(
        *group_cols,
        F.when(both, F.col("_auc_num") / (F.col("P").cast("double") * F.col("N").cast("double"))).alias("roc_auc"),
        F.when(both, F.col("_ap_num") / F.col("P").cast("double")).alias("average_precision"))


def metrics_record(df: DataFrame, y: str = "y", pred: str = "pred", score: str | None = "score",
                   group_cols: list[str] | None = None, *, max_groups: int = 1) -> DataFrame:
    """Threshold metrics, the nested confusion matrix, and (when scores are given) AUC and AP."""
    group_cols = group_cols or []
    out = threshold_metrics(df, y, pred, group_cols)
    out = out.withColumn("confusion_matrix", F.array(F.array("tn", "fp"), F.array("fn", "tp")))
    if score is not None:
        rk = ranking_metrics(df, y, score, group_cols, max_groups=max_groups)
        if group_cols:
            out = out.join(rk, group_cols)
        else:
            r = rk.first()
            out = out.withColumn("roc_auc", F.lit(r["roc_auc"]).cast("double")) \
                .withColumn("average_precision", F.lit(r["average_precision"]).cast("double"))
    return out
