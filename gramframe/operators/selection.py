"""Exact selection by bounded histograms: no window over rows, no shuffle of rows, no sort of values.

``hash_cuts``      the first k rows of every group in the order of a uniform hash, as one cut value per group. A pass
                   counts the rows of the open range by the next three hex digits (4,096 counters a group); the
                   counter that the k-th row falls into is the next range. When a range holds at most ``FINISH``
                   rows, these alone are ordered. Membership is then a comparison with the cut: a filter.
``radix_medians``  exact medians of many columns and groups at once. A double is read as a 64-bit integer that ascends
                   with it; a pass counts the next 12 bits of all columns' values inside the open ranges of the two
                   middle ranks, so six passes at most reach a single value, whatever the distribution.

A pass reads the needed columns of its input again: store derived inputs first (``session.stored``).

Both take groups that are complements of folds (``HeldOut``): rows are counted once, by fold, and a group's counters are the
sums over the other folds, so no row is copied per group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import bounded_broadcast

DIGITS, HASH_DIGITS = 3, 32      # hex digits of one pass and of the hash
FINISH = 4096                    # rows of a range that are ordered at once
ALL_ROWS = "g"                   # above every hex digit: the whole group is taken
MAX_LITERAL_GROUPS = 64          # cuts beyond this are joined instead of written into the plan
BITS = 12                        # of a double's image, per pass
RANGE = {"prefix": T.StringType(), "k": T.LongType()}


@dataclass(frozen=True)
class HeldOut:
    """Groups ``group`` = 0 .. k - 1 of a cross-validation: group g is every row whose ``fold`` is not g."""

    fold: str
    group: str
    k: int

    def groups_of(self, fold: int | None) -> list[int]:
        """The groups that a fold's rows belong to."""
        return [] if fold is None else [g for g in range(self.k) if g != fold]


def _same(cols: list[str]) -> Column:
    """Every group column equals the column of the same name with two underscores, nulls too."""
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return out


def _in_groups(rows: DataFrame, found: list[dict], group_cols: list[str], extra: dict[str, T.DataType]) -> DataFrame:
    """``rows`` joined with the driver's table of open groups (a row per group, broadcast)."""
    fields = [T.StructField(f"__{c}", rows.schema[c].dataType) for c in group_cols] + [T.StructField(c, t) for c, t in extra.items()]
    table = rows.sparkSession.createDataFrame([tuple(r[c] for c in [*group_cols, *extra]) for r in found], T.StructType(fields))
    return rows.join(F.broadcast(table), _same(group_cols)).drop(*[f"__{c}" for c in group_cols])


# ------------------------------------------------------------------ first k rows by hash
def hash_cuts(rows: DataFrame, group_cols: list[str], hash_col: str, tie_col: str, quota: Callable[[DataFrame], DataFrame],
              held_out: HeldOut | None = None) -> list[dict]:
    """Per group the (hash, tie) of its k-th row: dicts of ``group_cols``, ``hash``, ``tie``.

    With ``held_out`` its ``group``, one of ``group_cols``, is no column: rows have its ``fold`` instead.

    ``quota`` maps (group_cols, n), the group sizes, to (group_cols, k). Groups with k = 0 get no cut. Groups are few
    (classes x runs): their ranges live on the driver. (hash, tie) must be unique inside a group."""
    g = list(group_cols)
    rows = rows.select(*[held_out.fold if held_out and c == held_out.group else c for c in g], F.col(hash_col).alias("_h"), F.col(tie_col).alias("_t"))
    kinds = [T.StructField(c, T.IntegerType()) if held_out and c == held_out.group else rows.schema[c] for c in g]

    def counted(own: DataFrame, depth: int) -> dict[tuple, list[tuple[str, int]]]:
        """Rows per group and next digits, in digit order: 4,096 counters a group at most."""
        out: dict[tuple, list[tuple[str, int]]] = {}
        by_digit = own.groupBy(*g, F.substring("_h", depth + 1, DIGITS).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
        for r in by_digit.collect():
            out.setdefault(tuple(r[c] for c in g), []).append((r["_d"], r["_n"]))
        return {group: sorted(v) for group, v in out.items()}

    def counted_by_fold() -> dict[tuple, list[tuple[str, int]]]:
        """``counted(rows, 0)`` of the held-out groups: folds x 4,096 counters a class come to the driver."""
        sums: dict[tuple, dict[str, int]] = {}
        parts = [held_out.fold if c == held_out.group else c for c in g]
        for r in rows.groupBy(*parts, F.substring("_h", 1, DIGITS).alias("_d")).agg(F.count(F.lit(1)).alias("_n")).collect():
            for group in held_out.groups_of(r[held_out.fold]):
                own = sums.setdefault(tuple(group if c == held_out.group else r[c] for c in g), {})
                own[r["_d"]] = own.get(r["_d"], 0) + r["_n"]
        return {group: sorted(v.items()) for group, v in sums.items()}

    counts = counted_by_fold() if held_out else counted(rows, 0)
    sizes = [(*group, sum(n for _, n in v)) for group, v in counts.items()]
    if not sizes:
        return []
    table = rows.sparkSession.createDataFrame(sizes, T.StructType([*kinds, T.StructField("n", T.LongType())]))
    wanted = {tuple(r[c] for c in g): r["k"] for r in quota(table).collect()}   # a row per group
    state, done = [], []
    for *group, n in sizes:
        k = wanted.get(tuple(group)) or 0
        if k >= n:
            done.append(dict(zip(g, group)) | {"hash": ALL_ROWS, "tie": None})
        elif k > 0:
            state.append(dict(zip(g, group)) | {"prefix": "", "k": k, "count": n})

    def inside() -> DataFrame:
        if held_out:
            near = F.lit(len(state) > MAX_LITERAL_GROUPS)   # compiled: only rows of some open range meet the groups
            for prefix in sorted({r["prefix"] for r in state} if len(state) <= MAX_LITERAL_GROUPS else ()):
                near = near | F.col("_h").startswith(prefix)
            fields = [T.StructField(f"__{f.name}", f.dataType) for f in kinds] + [T.StructField(c, t) for c, t in RANGE.items()]
            open_ = rows.sparkSession.createDataFrame([tuple(r[c] for c in [*g, *RANGE]) for r in state], T.StructType(fields))
            of_group = F.col("_h").startswith(F.col("prefix")) & (F.col(held_out.fold) != F.col(f"__{held_out.group}")) & _same([c for c in g if c != held_out.group])
            met = rows.where(near).join(F.broadcast(open_), of_group)
            return met.select(*[F.col(f"__{c}").alias(c) for c in g], "_h", "_t", *RANGE)
        own = _in_groups(rows, state, g, RANGE)
        return own.where(F.col("_h").startswith(F.col("prefix")))

    depth = 0
    while state and (depth == 0 or max(r["count"] for r in state) > FINISH):
        if depth + DIGITS > HASH_DIGITS:
            raise ValueError(f"{tie_col} is not unique: more than {FINISH} rows share one order hash")
        if depth:
            counts = counted(inside().drop("prefix", "k"), depth)
        for r in state:   # the counter that holds the k-th row
            for digit, n in counts[tuple(r[c] for c in g)]:
                if r["k"] <= n:
                    r["prefix"], r["count"] = r["prefix"] + digit, n
                    break
                r["k"] -= n
        depth += DIGITS
    if state:
        order = Window.partitionBy(*g).orderBy("_h", "_t")
        ranked = inside().select(*g, "_h", "_t", "k", F.row_number().over(order).alias("_r"),
                                 F.lead(F.struct("_h", "_t")).over(order).eqNullSafe(F.struct("_h", "_t")).alias("_again"))
        for r in ranked.where(F.col("_r") == F.col("k")).collect():  # one row per group
            if r["_again"]:
                raise ValueError(f"{tie_col} is not unique: {r['_t']!r} occurs more than once")
            done.append({c: r[c] for c in g} | {"hash": r["_h"], "tie": r["_t"]})
    return done


def up_to_cut(df: DataFrame, cuts: list[dict], group_cols: list[str], hash_col: str, tie_col: str, flag: str) -> DataFrame:
    """``df`` with the boolean ``flag``: the row is among the first k of its group."""
    h, t = F.col(hash_col), F.col(tie_col)
    if len(cuts) > MAX_LITERAL_GROUPS:
        table = [tuple(c.values()) for c in cuts]
        fields = [T.StructField(f"__{c}", df.schema[c].dataType) for c in group_cols]
        schema = T.StructType([*fields, T.StructField("_ch", T.StringType()), T.StructField("_ct", df.schema[tie_col].dataType)])
        joined = df.join(bounded_broadcast(df.sparkSession.createDataFrame(table, schema), len(cuts)), _same(group_cols), "left")
        return joined.withColumn(flag, F.coalesce((h < F.col("_ch")) | ((h == F.col("_ch")) & (t <= F.col("_ct"))), F.lit(False))) \
            .drop("_ch", "_ct", *[f"__{c}" for c in group_cols])
    any_ = F.lit(False)
    for cut in cuts:
        here = F.lit(True)
        for c in group_cols:
            here = here & F.col(c).eqNullSafe(F.lit(cut[c]))
        first = h < F.lit(cut["hash"])
        any_ = any_ | (here & (first if cut["tie"] is None else first | ((h == F.lit(cut["hash"])) & (t <= F.lit(cut["tie"])))))
    return df.withColumn(flag, any_)


# ------------------------------------------------------------------ medians
def _image(values: np.ndarray) -> np.ndarray:
    """uint64 that ascends with the double; -0.0 counts as 0.0, NaN is above infinity."""
    bits = np.where(np.isnan(values), np.nan, values + 0.0).view(np.uint64)  # + 0.0: no negative zero, one NaN
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def _values(image: np.ndarray) -> np.ndarray:
    """The doubles of images."""
    return np.where(image >> np.uint64(63) == 1, image ^ np.uint64(1 << 63), ~image).view(np.float64)


class _Range:
    """One wanted rank: among the values whose image starts with ``prefix`` it has place ``k``."""

    def __init__(self, k: int) -> None:
        self.k, self.prefix = k, 0
        self.low = self.high = None  # smallest and largest value of the range, after a pass


def radix_medians(df: DataFrame, features: list[str], group_cols: list[str], held_out: HeldOut | None = None) -> list[tuple]:
    """(group values..., feature, median) for all groups (few) and features; nulls ignored, the midpoint of the two
    middle values for even counts, features without values left out. With ``held_out`` its groups are the only ones."""
    g, n = [held_out.fold] if held_out else list(group_cols), len(features)
    parts = df.groupBy(*g).agg(*[F.count(c).alias(f"_n{i}") for i, c in enumerate(features)]).collect()  # one row per group or fold
    if not parts:
        return []
    table = [{c: r[c] for c in g} | {"_g": i} for i, r in enumerate(parts)]
    rows = _in_groups(df, table, g, {"_g": T.IntegerType()}) if g else df.withColumn("_g", F.lit(0))
    rows = rows.select("_g", *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(features)])
    if held_out:
        names = [(i,) for i in range(held_out.k)]
        members = [[p for p, r in enumerate(parts) if i in held_out.groups_of(r[held_out.fold])] for i in range(held_out.k)]
    else:
        names, members = [tuple(r[c] for c in g) for r in parts], [[p] for p in range(len(parts))]
    ranges: dict[tuple[int, int, int], _Range] = {}
    for gi, own in enumerate(members):
        for f in range(n):
            size = sum(parts[p][f"_n{f}"] for p in own)
            if size:
                ranges[gi, f, 0] = _Range((size + 1) // 2)
                ranges[gi, f, 1] = _Range(size // 2 + 1)

    def slots() -> dict[tuple[int, int], dict[int, int]]:
        """Distinct open ranges of a feature and their places: those of one group, or of all groups that share the folds' rows."""
        out: dict[tuple[int, int], dict[int, int]] = {}
        for (gi, f, _), one in ranges.items():
            own = out.setdefault((0 if held_out else gi, f), {})
            own.setdefault(one.prefix, len(own))
        return out

    def counted(step: int, shift: int, places: dict) -> DataFrame:
        """(g, f, which, digit, n, low, high): rows, least and largest value by the next ``step`` bits inside the ranges."""
        bits, width = 64 - shift - step, max(len(own) for own in places.values())
        prefix = np.full((len(parts), n, width), np.uint64(0))
        open_ = np.zeros((len(parts), n, width), bool)
        for (scope, f), own in places.items():
            for value, w in own.items():
                at = slice(None) if held_out else scope
                prefix[at, f, w], open_[at, f, w] = value, True

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(parts) * n * width << step, np.int64)
            low, high = np.full(len(total), ~np.uint64(0)), np.zeros(len(total), np.uint64)
            for batch in batches:
                part = batch.column(0).to_numpy(zero_copy_only=False)
                for f in range(n):
                    column = batch.column(1 + f)
                    there = np.flatnonzero(pc.is_valid(column).to_numpy(zero_copy_only=False))
                    image = _image(column.drop_null().to_numpy(zero_copy_only=False))
                    own = part[there]
                    for w in np.flatnonzero(open_[:, f].any(axis=0)):
                        hit = open_[own, f, w]
                        if bits:
                            hit = hit & (image >> np.uint64(64 - bits) == prefix[own, f, w])
                        hits = image[hit]
                        digit = (hits >> np.uint64(shift) & np.uint64((1 << step) - 1)).astype(np.int64)
                        row = (own[hit].astype(np.int64) * n + f) * width + w
                        at = row << step | digit
                        np.add.at(total, at, 1)
                        np.minimum.at(low, at, hits)
                        np.maximum.at(high, at, hits)
            some = np.flatnonzero(total)
            at = some >> step
            yield pa.RecordBatch.from_arrays([
                pa.array((at // width // n).astype(np.int32)), pa.array((at // width % n).astype(np.int32)), pa.array((at % width).astype(np.int32)),
                pa.array((some & (1 << step) - 1).astype(np.int32)), pa.array(total[some]), pa.array(_values(low[some])), pa.array(_values(high[some]))],
                ["g", "f", "which", "digit", "n", "low", "high"])
        found = rows.mapInArrow(run, "g int, f int, which int, digit int, n long, low double, high double")

        def added(table: DataFrame) -> DataFrame:
            return table.groupBy("g", "f", "which", "digit").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        if not held_out:
            return added(found)
        pairs = df.sparkSession.createDataFrame([(p, gi) for gi, own in enumerate(members) for p in own], "g int, _group int")
        return added(added(found).join(F.broadcast(pairs), "g").drop("g").withColumnRenamed("_group", "g"))

    left = 64
    while left and any(r.low is None or r.low != r.high for r in ranges.values()):
        step = min(BITS, left)
        left -= step
        places = slots()
        run = Window.partitionBy("g", "f", "which").orderBy("digit")
        upto = counted(step, left, places).withColumn("upto", F.sum("n").over(run)).withColumn("before", F.col("upto") - F.col("n"))
        # the counters that hold a wanted rank: two per group and feature
        wanted = [(gi, f, places[0 if held_out else gi, f][r.prefix], w, r.k) for (gi, f, w), r in ranges.items()]
        asked = df.sparkSession.createDataFrame(wanted, "g int, f int, which int, w int, k long")
        hit = upto.join(F.broadcast(asked), ["g", "f", "which"]).where("before < k and k <= upto")
        for r in hit.select("g", "f", "w", "digit", "before", "low", "high").collect():
            one = ranges[r["g"], r["f"], r["w"]]
            one.prefix, one.k, one.low, one.high = one.prefix << step | r["digit"], one.k - r["before"], r["low"], r["high"]
    return [(*names[gi], features[f], (one.low + ranges[gi, f, 1].low) / 2) for (gi, f, w), one in ranges.items() if w == 0]
