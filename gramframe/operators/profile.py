"""Profiling and validation of a feature table (row/feature counts, classes, missing, duplicates).

Every function is one aggregate job whose partial aggregation runs map-side, so a hot key
(a large group of identical rows, a dominant class) is collapsed before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col


def profile(df: DataFrame, features: list[str]) -> DataFrame:
    """A1: one row (rows, features)."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(features)).cast("int").alias("features"))


def class_counts(df: DataFrame, target: str = "y") -> DataFrame:
    """A2/O1: (target, n) for non-null labels, ordered by label."""
    return (df.where(col(target).isNotNull()).groupBy(target)
            .agg(F.count(F.lit(1)).alias("n")).orderBy(target))


def missing_counts(df: DataFrame, features: list[str]) -> DataFrame:
    """A3: (feature, position, n_missing), NULL or NaN counted as missing. One pass, then stack."""
    wide = df.agg(*[
        F.count_if(F.col(c).isNull() | F.isnan(F.col(c))).alias(c) for c in features])
    pairs = ", ".join(f"'{c}', {q}, `{c}`" for q, c in enumerate(features))
    return wide.selectExpr(f"stack({len(features)}, {pairs}) as (feature, position, n_missing)") \
        .select("feature", F.col("position").cast("int"), F.col("n_missing").cast("long"))


def digested(df: DataFrame, c: str) -> Column:
    """A column as group key: text and binary values as (length, 256-bit digest), null as null, others as given."""
    if not isinstance(df.schema[c].dataType, (T.StringType, T.BinaryType)):
        return F.col(f"`{c}`").alias(c)
    x = F.col(f"`{c}`")
    return F.when(x.isNotNull(), F.struct(F.octet_length(x).alias("n"), F.unhex(F.sha2(x.cast("binary"), 256)).alias("d"))).alias(c)


def duplicate_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """A4: rows that repeat an earlier row (missing equals missing): sum over groups of (count - 1).

    ``groupBy`` treats NULLs as equal, unlike a multi-column ``count(distinct ...)``. Long values never
    enter the shuffle: their digests are the keys. Equal digests are checked by a second one of 512 bits over
    all columns: a group with two of them is an error, not a wrong count.
    """
    texts = [c for c in columns if isinstance(df.schema[c].dataType, (T.StringType, T.BinaryType))]
    second = F.xxhash64(*[F.sha2(F.col(f"`{c}`").cast("binary"), 512) for c in texts]) if texts else F.lit(0).cast("long")
    keyed = df.select(*[digested(df, c) for c in columns], second.alias("_second"))
    groups = keyed.groupBy(*[f"`{c}`" for c in columns]).agg(F.count(F.lit(1)).alias("_c"), F.min("_second").alias("_lo"), F.max("_second").alias("_hi"))
    once = F.when(F.col("_lo") == F.col("_hi"), F.col("_c")).otherwise(F.raise_error(F.lit("two texts share a 256-bit digest")).cast("long"))
    return groups.agg(
        F.coalesce(F.sum(once - 1), F.lit(0)).cast("long").alias("duplicates"),
        F.count(F.lit(1)).alias("distinct_rows"))


def label_domain(df: DataFrame, target: str = "y") -> DataFrame:
    """One row describing the label column; ``valid`` is the contract (non-null set == {0,1})."""
    per_label = df.groupBy(target).agg(F.count(F.lit(1)).alias("_n"))
    return per_label.agg(
        F.count(col(target)).alias("n_labels"),
        F.min(col(target)).cast("int").alias("min_label"),
        F.max(col(target)).cast("int").alias("max_label"),
        F.coalesce(F.sum(F.when(col(target).isNull(), F.col("_n"))), F.lit(0)).cast("long").alias("null_labels"),
        # compared as given: 0.4 or 1.5 is no label, whatever it truncates to
        F.count(F.when(~col(target).isin(0, 1), F.lit(1))).alias("_other"),
    ).select(
        "n_labels", "min_label", "max_label", "null_labels",
        ((F.col("n_labels") == 2) & (F.col("_other") == 0)).alias("valid"),
    )


def validate_labels(df: DataFrame, target: str = "y") -> None:
    """Raise unless the non-null labels are exactly {0, 1} and no label is missing."""
    row = label_domain(df, target).first()
    if not row["valid"]:
        raise ValueError(f"{target} must contain exactly the values 0 and 1")
    if row["null_labels"]:
        raise ValueError(f"{target} has {row['null_labels']} missing labels; they cannot be cast to int")


def validate_columns(df: DataFrame, expected: list[str]) -> None:
    """Exact column list and order, checked before any job runs."""
    if list(df.columns) != list(expected):
        raise ValueError(f"expected columns {expected}, got {df.columns}")
