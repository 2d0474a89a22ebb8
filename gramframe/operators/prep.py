"""Median imputation and standardisation: fit on one table, apply to others (no leakage).

Fit = one row of statistics per group (``group_cols``, e.g. run_id): median, mean and
population standard deviation (0 -> 1) of each feature, the moments taken *after* imputation.
The moments after imputation are merged algebraically from the non-missing moments and the
median (Chan et al. parallel variance), so a fit is one scan plus the median job.

Medians: groups of known small size (subsets) use Spark's exact ``median``; whole tables use
radix selection (``selection.radix_medians``), so no group of values is held by one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import bounded_broadcast
from .selection import HeldOut, radix_medians

# Groups with at most this many rows use the in-memory exact median aggregate.
SMALL_GROUP_ROWS = 100_000


def exact_medians_distributed(df: DataFrame, features: list[str], group_cols: list[str],
                              max_groups: int = 1, held_out: HeldOut | None = None) -> DataFrame:
    """(group..., feature, median) with the midpoint rule for even counts; nulls ignored. Radix selection over the
    values' bits: a few histogram passes over ``df``, nothing sorted or stored."""
    fields = [T.StructField(c, T.IntegerType()) if held_out and c == held_out.group else df.schema[c] for c in group_cols] + [T.StructField("feature", T.StringType()), T.StructField("median", T.DoubleType())]
    found = radix_medians(df, features, group_cols, held_out)
    if len(found) > max_groups * len(features):
        raise ValueError(f"more than {max_groups} groups")
    return df.sparkSession.createDataFrame(found, T.StructType(fields))


@dataclass
class Preprocessor:
    """Fitted statistics: ``stats`` has group_cols + med_<f>, mu_<f>, sd_<f> for each feature."""

    stats: DataFrame
    features: list[str]
    group_cols: list[str]
    max_groups: int

    def by_group(self) -> dict:
        """Group -> (medians, means, spreads) as arrays: the fitted groups (few, of one group column) for tasks that transform
        their batches themselves."""
        out = {}
        for r in self.stats.collect():
            empty = [c for c in self.features if r[f"med_{c}"] is None]
            if empty:
                raise ValueError(f"{empty}: no observed value in a group, cannot be imputed")
            out[r[self.group_cols[0]]] = tuple(np.array([r[f"{part}_{c}"] for c in self.features], float) for part in ("med", "mu", "sd"))
        return out

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """(coalesce(x, median) - mean) / sd for every feature; other columns kept."""
        def scaled(c: str, med: Column, mu: Column, sd: Column) -> Column:
            if self.group_cols:  # a feature that is missing throughout its group has no median
                med = F.coalesce(med, F.raise_error(F.lit(f"{c}: no observed value in a group, cannot be imputed")).cast("double"))
            return ((F.coalesce(F.col(c), med) - mu) / sd).alias(c + suffix)

        keep = [c for c in df.columns if c not in self.features or suffix]
        if self.group_cols:
            joined = df.join(bounded_broadcast(self.stats, self.max_groups), self.group_cols)
            cols = [scaled(c, F.col(f"med_{c}"), F.col(f"mu_{c}"), F.col(f"sd_{c}")) for c in self.features]
            return joined.select(*[F.col(c) for c in keep], *cols)
        # one group: the statistics are a handful of numbers, applied as literals (like a fitted model)
        if getattr(self, "_row", None) is None:
            self._row = self.stats.first().asDict()
            empty = [c for c in self.features if self._row[f"med_{c}"] is None]
            if empty:
                raise ValueError(f"features without any observed value cannot be imputed: {empty}")
        row = self._row
        cols = [scaled(c, F.lit(row[f"med_{c}"]), F.lit(row[f"mu_{c}"]), F.lit(row[f"sd_{c}"]))
                for c in self.features]
        return df.select(*[F.col(c) for c in keep], *cols)


def _of_other_folds(moments: DataFrame, features: list[str], held_out: HeldOut) -> DataFrame:
    """Per-fold moments (a row per fold) merged into those of every group, by the parallel formula."""
    of = Window.partitionBy(held_out.group)
    parts = moments.select("*", F.explode(F.sequence(F.lit(0), F.lit(held_out.k - 1))).alias(held_out.group)).where(F.col(held_out.fold) != F.col(held_out.group))
    for c in features:
        total = F.nullif(F.sum(f"_n_{c}").over(of), F.lit(0))   # no value in the group: no mean
        parts = parts.withColumn(f"_all_{c}", F.sum(F.col(f"_n_{c}") * F.col(f"_m_{c}")).over(of) / total)
    aggs = [F.sum("_rows").alias("_rows")]
    for c in features:
        n, off = F.col(f"_n_{c}"), F.col(f"_m_{c}") - F.col(f"_all_{c}")
        aggs += [F.sum(n).alias(f"_n_{c}"), F.first(f"_all_{c}").alias(f"_m_{c}"),
                 (F.sum(n * (F.col(f"_v_{c}") + off * off)) / F.nullif(F.sum(n), F.lit(0))).alias(f"_v_{c}")]
    return parts.groupBy(held_out.group).agg(*aggs)


def fit_preprocessor(df: DataFrame, features: list[str], group_cols: list[str] | None = None,
                     *, max_groups: int = 1, rows_per_group: int | None = None, held_out: HeldOut | None = None) -> Preprocessor:
    """Fit median imputation + standardisation per group.

    ``rows_per_group``: a proven bound on rows per group (e.g. the subset size); when small
    the exact in-memory median aggregate is used, else the distributed exact median.
    An all-missing feature is an error. ``held_out``: the groups are complements of folds, read once by fold.
    """
    group_cols = [held_out.group] if held_out else group_cols or []
    small = rows_per_group is not None and rows_per_group <= SMALL_GROUP_ROWS and not held_out
    moments = df.groupBy(*([held_out.fold] if held_out else group_cols)).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(c).alias(f"_n_{c}") for c in features],
        *[F.avg(c).alias(f"_m_{c}") for c in features],
        *[F.var_pop(c).alias(f"_v_{c}") for c in features],
        *([F.median(c).alias(f"med_{c}") for c in features] if small else []),
    )
    if held_out:
        moments = _of_other_folds(moments, features, held_out)
    if not small:
        med_long = exact_medians_distributed(df, features, group_cols, max_groups, held_out)
        med_wide = med_long.groupBy(*group_cols).pivot("feature", features).agg(F.first("median"))
        med_wide = med_wide.select(*group_cols, *[F.col(c).alias(f"med_{c}") for c in features])
        if group_cols:
            moments = moments.join(bounded_broadcast(med_wide, max_groups), group_cols)
        else:
            med_row = med_wide.first()  # one row of len(features) numbers
            moments = moments.select("*", *[F.lit(med_row[f"med_{c}"]).cast("double").alias(f"med_{c}")
                                            for c in features])
    out = [F.col(g) for g in group_cols]
    for c in features:
        n1 = F.col(f"_n_{c}").cast("double")
        miss = F.col("_rows").cast("double") - n1
        total = F.col("_rows").cast("double")
        med, m1, v1 = F.col(f"med_{c}"), F.col(f"_m_{c}"), F.col(f"_v_{c}")
        delta = med - m1
        mean = m1 + delta * miss / total
        var = (v1 * n1 + delta * delta * n1 * miss / total) / total
        sd = F.sqrt(F.greatest(var, F.lit(0.0)))
        out += [med.alias(f"med_{c}"), mean.alias(f"mu_{c}"),
                F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias(f"sd_{c}")]
    stats = moments.select(*out)
    return Preprocessor(stats, features, group_cols, max_groups)

