"""Exact ranks and running sums inside groups, without a window over a whole group.

A class label has two values, so ``row_number().over(partitionBy(y))`` would put the whole
table into two tasks. The two helpers below keep every task small:

``hash_rank``      rows ordered by a uniform hash: bucket = hash prefix; per-(group, bucket)
                   counts give running offsets (a small table, broadcast behind a size check);
                   ``row_number`` then runs inside (group, bucket).
``ordered_prefix`` rows ordered by a value (unique per group): range partitioning,
                   checkpointed so the partition ids are fixed, per-partition totals give the
                   offsets, and the running sum runs inside (group, partition).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# A broadcast side must stay below this many rows; beyond it the join is left to a shuffle.
BROADCAST_ROW_LIMIT = 2_000_000


def bounded_broadcast(df: DataFrame, row_bound: int) -> DataFrame:
    """Broadcast hint only when ``row_bound`` (a proven upper bound on the rows) is small enough."""
    return F.broadcast(df) if row_bound <= BROADCAST_ROW_LIMIT else df


def bucket_digits(df: DataFrame, minimum: int = 3) -> int:
    """Hex digits of the hash prefix: at least 4 buckets per shuffle partition (4096 minimum),
    so (group, bucket) windows stay small as the cluster and the data grow."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digits = minimum
    while 16 ** digits < 4 * parts and digits < 6:
        digits += 1
    return digits


def hash_rank(df: DataFrame, group_cols: list[str], hash_col: str, tie_col: str,
              *, max_groups: int, prefix_hex: int | None = None, rank_col: str = "rank",
              per_group: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Add ``rank_col``: exact 1-based rank of each row within ``group_cols`` ordered by (hash, tie).

    ``hash_col`` must be a lowercase hex digest (uniform). ``max_groups`` bounds the number of
    groups (e.g. classes x runs); the offsets table has at most max_groups * 16**prefix_hex rows.
    ``per_group`` maps (group_cols, n), the group sizes, to further columns per group; the sizes come
    from the bucket counts, so the rows are read for the counts and for the ranks, not a third time.
    """
    prefix_hex = prefix_hex or bucket_digits(df)
    n_buckets = 16 ** prefix_hex
    bucketed = df.withColumn(
        "_bucket", F.conv(F.substring(F.col(hash_col), 1, prefix_hex), 16, 10).cast("int"))
    counts = bucketed.groupBy(*group_cols, "_bucket").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*group_cols).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *group_cols, "_bucket", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_offset"))
    if per_group:
        sizes = counts.groupBy(*group_cols).agg(F.sum("_cnt").alias("n"))
        offsets = offsets.join(bounded_broadcast(per_group(sizes), max_groups), group_cols)
    joined = bucketed.join(bounded_broadcast(offsets, max_groups * n_buckets), [*group_cols, "_bucket"])
    inner = Window.partitionBy(*group_cols, "_bucket").orderBy(hash_col, tie_col)
    return joined.withColumn(rank_col, (F.col("_offset") + F.row_number().over(inner)).cast("long")) \
        .drop("_bucket", "_offset")


def ordered_prefix(df: DataFrame, group_cols: list[str], order_col: str, sum_cols: list[str],
                   *, max_groups: int, parts: int | None = None) -> DataFrame:
    """Add ``cum_<c>`` for each c in ``sum_cols``: inclusive running sum in ascending
    ``order_col`` within ``group_cols``. (group, order) must be unique (aggregate first).
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(
        df.repartitionByRange(parts, *[F.col(c) for c in group_cols], F.col(order_col))
        .withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy(*group_cols, "_part").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    before = Window.partitionBy(*group_cols).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group_cols, "_part",
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sum_cols])
    joined = ranged.join(bounded_broadcast(offsets, max_groups * parts), [*group_cols, "_part"])
    running = Window.partitionBy(*group_cols, "_part").orderBy(order_col) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = joined
    for c in sum_cols:
        out = out.withColumn(f"cum_{c}", F.col(f"_o_{c}") + F.sum(c).over(running))
    return out.drop("_part", *[f"_o_{c}" for c in sum_cols])


def first_k_by_hash(df: DataFrame, group_cols: list[str], hash_col: str, tie_col: str,
                    k_max: int, k_col: Column | None = None, rank_col: str = "rank") -> DataFrame:
    """Rows whose rank within the group is <= k (k_col per row, at most the literal k_max).

    The literal bound lets Spark plan a ``WindowGroupLimit``: each map task keeps only its
    first k_max rows per group before the shuffle, so the shuffle carries at most
    partitions x groups x k_max rows. Use for small k (subsets); use ``hash_rank`` for large k.
    """
    w = Window.partitionBy(*group_cols).orderBy(hash_col, tie_col)
    ranked = df.withColumn(rank_col, F.row_number().over(w))
    cond = F.col(rank_col) <= F.lit(k_max)
    if k_col is not None:
        cond = cond & (F.col(rank_col) <= k_col)
    return ranked.where(cond)
