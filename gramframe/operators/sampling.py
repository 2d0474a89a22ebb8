"""Exactly sized, reproducible sampling: stratified split, balanced subsets, undersampling,
stratified folds, uniform samples, and the run grid they are drawn for.

Randomness is an order by ``md5('seed~purpose~row_key')``; sizes and per-class counts follow
the studied method's rules exactly.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import order_hash
from ..session import cut_lineage
from .ranking import first_k_by_hash, hash_rank
from .selection import ALL_ROWS, MAX_LITERAL_GROUPS, HeldOut, hash_cuts, up_to_cut

MAX_CLASSES = 2
CANDIDATES = 4   # hits per wanted row that the first bound of a run grid aims at
MAX_FILTER_RUNS = 32   # runs whose hashes are compared in one filter


# ------------------------------------------------------------------ allocation rules
def split_allocation(counts: DataFrame, target: str, test_size: float) -> DataFrame:
    """Per-class test counts of a stratified split (input: (target, n) per class, tiny).

    n_test = ceil(test_size * n); the train share n - n_test is allocated per class by
    floor((c / n) * n_train) plus one for the largest remainders (ties: lower label first);
    test = c - train.
    """
    tot = Window.partitionBy()
    c = F.col("n").cast("double")
    n = F.sum("n").over(tot)
    n_test = F.ceil(F.lit(float(test_size)) * n.cast("double"))
    step = counts.select(
        target, "n",
        (n - n_test).alias("n_train_total"),
        (c / n.cast("double") * (n - n_test).cast("double")).alias("_cont"))
    step = step.withColumn("_floor", F.floor("_cont")).withColumn("_rem", F.col("_cont") - F.col("_floor"))
    step = step.withColumn("_need", F.col("n_train_total") - F.sum("_floor").over(tot))
    step = step.withColumn("_order", F.row_number().over(Window.orderBy(F.desc("_rem"), F.asc(target))))
    return step.select(
        target, F.col("n").alias("n_class"),
        (F.col("n") - (F.col("_floor") + F.when(F.col("_order") <= F.col("_need"), 1).otherwise(0)))
        .cast("long").alias("n_test"))


def class_counts(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ D1 stratified split
def stratified_split(df: DataFrame, target: str, key: str, seed: int, test_size: float,
                     split_col: str = "split") -> DataFrame:
    """Add ``split`` ('test' / 'train'): the first n_test[class] rows of each class in hash order. The cut of
    each class is selected from histograms of the hash (jobs that read target and key only); the split is a
    comparison with it, without window or shuffle."""
    h = df.withColumn("_h", order_hash(seed, "split", key))
    cuts = hash_cuts(h, [target], "_h", key, lambda sizes: split_allocation(sizes, target, test_size).select(target, F.col("n_test").alias("k")))
    flagged = up_to_cut(h, cuts, [target], "_h", key, "_first")
    return flagged.withColumn(split_col, F.when(F.col("_first"), "test").otherwise("train")).drop("_h", "_first")


# ------------------------------------------------------------------ D2 balanced subsets
def check_subset_size(size: int) -> int:
    if size <= 0 or size % 2:
        raise ValueError(f"subset size must be a positive even number, got {size}")
    return size // 2


def check_class_sizes(df: DataFrame, target: str, per_class: int) -> None:
    """A class with fewer rows than requested is an error (sampling is without replacement)."""
    _check_counts({r[target]: r["n"] for r in class_counts(df, target).collect()}, per_class)  # <= 2 rows


def _check_counts(counts: dict, per_class: int) -> None:
    for label in (0, 1):
        if counts.get(label, 0) < per_class:
            raise ValueError(f"class {label} has {counts.get(label, 0)} rows, {per_class} requested")


def balanced_subset(df: DataFrame, target: str, key: str, size: int, seed: int,
                    check: bool = True) -> DataFrame:
    """size/2 rows per class without replacement, then shuffled: adds ``position`` (0-based).

    Only rows below a bound of their class's hashes are ranked, about ``CANDIDATES`` times the wanted ones; their counts
    prove that the wanted rows are among them, else the bound is widened."""
    half = check_subset_size(size)
    counts = {r[target]: r["n"] for r in class_counts(df, target).collect()}  # classes
    if check:
        _check_counts(counts, half)
    h, factor = df.withColumn("_h", order_hash(seed, "subset", key)), CANDIDATES
    while True:
        below = F.lit(ALL_ROWS)
        if len(counts) <= MAX_LITERAL_GROUPS:
            for label, n in counts.items():
                below = F.when(F.col(target).eqNullSafe(F.lit(label)), F.lit(_hash_bound(factor, half, n))).otherwise(below)
        hits = cut_lineage(h.where(F.col("_h") < below))   # about factor x size rows
        found = {r[target]: r["n"] for r in class_counts(hits, target).collect()}
        if all(found.get(label, 0) >= min(half, n) for label, n in counts.items()):
            break
        factor *= 16
    picked = first_k_by_hash(hits, [target], "_h", key, half).drop("rank", "_h")
    shuffle = Window.orderBy(order_hash(seed, "shuffle", key), key)  # over `size` rows only
    return picked.withColumn("position", (F.row_number().over(shuffle) - 1).cast("int"))


def _hash_bound(factor: int, half: int, n: int) -> str:
    """A hash below which about ``factor`` times ``half`` of a class's n rows fall."""
    share = factor * (half + 16) / max(n, 1)
    return ALL_ROWS if share >= 1 else format(int(share * 16 ** 8), "08x")


@dataclass(frozen=True)
class Run:
    run_id: int
    size: int
    seed: int
    repeat: int = 0
    kind: str = "compare"


def comparison_runs(sizes: list[int], repeats: int, seed: int, size_factor: int = 100) -> list[Run]:
    """Comparison grid: subset seed = seed + factor * size + repeat."""
    out, rid = [], 0
    for size in sizes:
        for rep in range(repeats):
            out.append(Run(rid, size, seed + size_factor * size + rep, rep, "compare"))
            rid += 1
    return out


def map_study_runs(size: int, repeats: int, seed: int) -> list[Run]:
    """Map-study grid: one subset per repeat (shared by every feature map), seed = seed + repeat."""
    return [Run(rep, size, seed + rep, rep, "map_study") for rep in range(repeats)]


def _hit_by_any(runs: list[Run], bounds: list[tuple[str, str]], target: str, key: str) -> Column:
    """The row's hash for some run is below that run's bound for its class. Spark compiles this comparison, but not the array
    expression that names the runs, so that one sees the few hits only. Grids beyond ``MAX_FILTER_RUNS`` go without."""
    if len(runs) > MAX_FILTER_RUNS:
        return F.lit(True)
    out = F.lit(False)
    for r, (low, high) in zip(runs, bounds):
        out = out | (order_hash(r.seed, "subset", key) < F.when(F.col(target) == 1, high).otherwise(low))
    return out


def balanced_subsets(df: DataFrame, target: str, key: str, runs: list[Run], check: bool = True) -> DataFrame:
    """Balanced subset for every run in one job: adds (run_id, size, seed, repeat, position).

    A row is read once: its hashes for all runs are compared, in one compiled filter, with a bound below which
    about ``CANDIDATES`` times the wanted rows of its class fall, and only hits become rows, one per run hit. The counts
    of the hits prove that the wanted rows are among them; a (run, class) that fell short widens the bound."""
    halves = [check_subset_size(r.size) for r in runs]
    counts = {r[target]: r["n"] for r in class_counts(df, target).collect()}  # <= 2 rows
    for label in (0, 1):
        if check and counts.get(label, 0) < max(halves):
            raise ValueError(f"class {label} has {counts.get(label, 0)} rows, {max(halves)} requested")
    factor = CANDIDATES
    while True:
        grid = F.array(*[F.struct(
            F.lit(r.run_id).alias("run_id"), F.lit(r.size).alias("size"), F.lit(r.seed).alias("seed"), F.lit(r.repeat).alias("repeat"),
            F.lit(_hash_bound(factor, h, counts.get(0, 0))).alias("_b0"), F.lit(_hash_bound(factor, h, counts.get(1, 0))).alias("_b1")) for r, h in zip(runs, halves)])
        hashed = F.transform(grid, lambda r: F.struct(r["run_id"].alias("run_id"), r["size"].alias("size"), r["seed"].alias("seed"),
                                                      r["repeat"].alias("repeat"), order_hash(r["seed"], "subset", key).alias("_h"),
                                                      F.when(F.col(target) == 1, r["_b1"]).otherwise(r["_b0"]).alias("_b")))
        some = _hit_by_any(runs, [(_hash_bound(factor, h, counts.get(0, 0)), _hash_bound(factor, h, counts.get(1, 0))) for h in halves], target, key)
        hits = df.where(F.col(target).isin(0, 1)).where(some).select(*df.columns, F.inline(F.filter(hashed, lambda r: r["_h"] < r["_b"]))).drop("_b")
        hits = cut_lineage(hits)   # about factor x sum of sizes rows
        found = {(r["run_id"], r[target]): r["n"] for r in hits.groupBy("run_id", target).agg(F.count(F.lit(1)).alias("n")).collect()}  # runs x 2
        if all(found.get((r.run_id, c), 0) >= min(h, counts.get(c, 0)) for r, h in zip(runs, halves) for c in (0, 1)):
            break
        factor *= 16
    picked = first_k_by_hash(hits, ["run_id", target], "_h", key, max(halves),
                             k_col=F.col("size") / 2).drop("rank", "_h")
    shuffle = Window.partitionBy("run_id").orderBy(order_hash(F.col("seed"), "shuffle", key), key)
    return picked.withColumn("position", (F.row_number().over(shuffle) - 1).cast("int"))


# ------------------------------------------------------------------ D3 undersampling
def member_column(group: int) -> str:
    """The column of ``undersample`` that says whether a row is in a held-out group."""
    return f"__in_{group}"


def undersample(df: DataFrame, target: str, key: str, seed: int, group_cols: list[str] | None = None,
                max_groups: int = 1, held_out: HeldOut | None = None) -> DataFrame:
    """Every class down to the minority count (per group), without replacement: the rows up to the class's cut in
    hash order (exact; a filter, as in ``stratified_split``). With ``held_out``, rows that some group may take come once each, with
    a boolean ``member_column`` per group."""
    g = [held_out.group] if held_out else group_cols or []
    h = df.withColumn("_h", order_hash(seed, "undersample", key))
    minority = F.min("n").over(Window.partitionBy(*g))   # over classes x groups rows
    cuts = hash_cuts(h, [*g, target], "_h", key, lambda sizes: sizes.select(*g, target, minority.alias("k")), held_out)
    if len(cuts) > MAX_CLASSES * max_groups:
        raise ValueError(f"more than {max_groups} groups of {MAX_CLASSES} classes")
    if held_out:
        # first the rows up to the last cut of their class, then each group's
        last = {}
        for c in cuts:
            if c[target] not in last or (last[c[target]]["hash"], last[c[target]]["tie"] or "") < (c["hash"], c["tie"] or ""):
                last[c[target]] = c
        flagged = up_to_cut(h, list(last.values()), [target], "_h", key, "_first").where("_first")
        for group in range(held_out.k):
            own = up_to_cut(flagged, [c for c in cuts if c[held_out.group] == group], [target], "_h", key, "_first")
            flagged = own.withColumn(member_column(group), F.col("_first") & (F.col(held_out.fold) != group))
        return flagged.drop("_h", "_first")
    return up_to_cut(h, cuts, [*g, target], "_h", key, "_first").where("_first").drop("_h", "_first")


# ------------------------------------------------------------------ D4 stratified folds
def stratified_folds(df: DataFrame, target: str, key: str, seed: int, k: int,
                     group_cols: list[str] | None = None, max_groups: int = MAX_CLASSES) -> DataFrame:
    """Add ``fold`` in [0, k): rows of each class take folds (offset + rank - 1) % k, where
    offset is the number of rows in lower classes; per-fold class counts equal those of a
    shuffled stratified k-fold. ``group_cols`` (e.g. run_id) make independent fold sets.
    """
    if k < 2:
        raise ValueError("at least 2 folds are required")
    group_cols = group_cols or []
    low = Window.partitionBy(*group_cols).orderBy(target).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(low), F.lit(0)).alias("_off")   # over classes x groups rows
    seed_c = F.col("seed") if "seed" in df.columns else F.lit(seed)
    h = df.withColumn("_h", order_hash(seed_c, "folds", key))
    ranked = hash_rank(h, [*group_cols, target], "_h", key, max_groups=max_groups,
                       per_group=lambda sizes: sizes.select(*group_cols, target, before))
    return (ranked.withColumn("fold", F.pmod(F.col("_off") + F.col("rank") - 1, F.lit(k)).cast("int"))
            .drop("_h", "rank", "_off"))


def check_folds(counts: dict[int, int], k: int) -> None:
    """More folds than members of every class is an error (checked before any training)."""
    if counts and all(c < k for c in counts.values()):
        raise ValueError(f"{k} folds cannot be greater than the number of members in each class {counts}")
    if sum(counts.values()) < k:
        raise ValueError(f"{k} folds for {sum(counts.values())} rows")


# ------------------------------------------------------------------ D5 uniform sample
def uniform_sample(df: DataFrame, key: str, seed: int, size: int) -> DataFrame:
    """min(n, size) rows without replacement: the first rows in hash order (top-k, no full sort)."""
    h = df.withColumn("_h", order_hash(seed, "sample", key))
    return h.orderBy("_h", key).limit(size).drop("_h")


def n_test_rows(n: int, test_size: float) -> int:
    return int(math.ceil(test_size * n))
