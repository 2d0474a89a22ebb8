"""Linear margin classifiers for a parameter grid, all models of the grid fitted together, a few passes over the rows.

Objective: 1/n sum_i max(0, 1 - y_i (w . z_i + b)) + regParam/2 ||w||^2 with regParam = 1 / (C n), the
hinge-loss SVM with penalty C. z = phi(x) is a fixed feature map: random Fourier features for the
RBF baseline, given arrays for kernel-to-landmark features.

Solver: Newton steps on the hinge, its corner rounded over a width that falls from pass to pass. A pass is one Spark job over
all rows: a task maps a batch once per kernel width and adds up, for every model still open, losses at a few step lengths, the
gradient and the curvature (features x features numbers); executors add the tasks' sums by blocks of rows, and the driver gets
one sum per model. The features are never stored and the rows never shuffled. The first point comes from about ``START_ROWS`` rows a group, solved in one task: a group
of no more rows is done with them (certified by its duality gap). For others it only decides how many passes are needed, as do the passes over
a sample (``SAMPLE_SHARE`` of the rows) that large groups take next; neither decides the
result: a fit ends when, over all rows, its objective is within ``TOLERANCE`` of the optimum. The excess is the smaller of two bounds: the duality gap, and what
the next Newton step would gain plus what rounding the corner can hide. A fit that uses up ``MAX_PASSES`` is an error,
never a result.

Rows: a row trains the model group named by ``group_col``, or (``Members``) every group whose boolean column is true, prepared with each
group's statistics inside the task, so that the parts of a cross-validation share one stored copy.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

TOLERANCE = 1e-4          # excess over the objective
FLOOR = 1e-7              # excess that always ends a fit (an objective near zero)
MAX_PASSES = 100
STEPS = (1.0, 0.4, 0.1)   # step lengths whose losses a pass adds up
WIDTHS = (0.05, 0.02, 0.01, 0.005, 0.002, 0.0005, 0.0001)   # of the rounded corner
HIDDEN = 0.1              # of TOLERANCE: what rounding may hide at the width that a fit aims at
PLENTY = 50               # rows in the corner per feature: with fewer, widths fall one by one and only near the optimum
START_ROWS = 32_768
START_STEPS = 100         # interior-point steps on the first rows
PART_ROWS, PART_TOLERANCE = 8192, 2e-3    # first rows of a larger group, and the gap that is enough for a first point
SAMPLE_SHARE, SAMPLE_ROWS, SAMPLE_PASSES = 0.125, 65_536, 15   # passes over a share come first where it has so many rows
SAMPLE_TOLERANCE = 3e-4   # what a sample misses is more
NOISE = 5e-7              # of sums of single-precision losses
MAX_ANGLE = 128.0         # radians: larger angles are reduced in double precision
TASKS_PER_CORE = 3        # a task holds the sums of its models: their number follows the cores, not the files
BLOCK = 32                # rows of the curvature that are added up together
# Random features per model: the mean error of a kernel value falls as 1 / sqrt(features), about 0.1 at
# 64 and 0.046 at 256 (largest 0.25) on nine scaled columns.
RANDOM_FEATURES = 256
MIN_RANDOM_FEATURES, MAX_RANDOM_FEATURES = 16, 4096


@dataclass(frozen=True)
class ModelSpec:
    model_id: int
    group: int              # rows with this group value train the model
    gamma: float | None     # None: the features are given as an array column
    C: float


@dataclass(frozen=True)
class MarginModel:
    coefficients: DenseVector
    intercept: float
    objective: float        # primal over all rows of the group
    excess: float           # over the optimum, at most
    passes: int


def check_random_features(dim: int) -> int:
    if not MIN_RANDOM_FEATURES <= dim <= MAX_RANDOM_FEATURES:
        raise ValueError(f"random features must number {MIN_RANDOM_FEATURES} to {MAX_RANDOM_FEATURES}, got {dim}")
    return dim


def _draw(gamma: float, dim: int, seed: int, n_in: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(n_in, dim))
    return w, rng.uniform(0.0, 2 * math.pi, size=dim)


def random_features(gamma: float, dim: int, seed: int, n_in: int) -> Callable[[np.ndarray], np.ndarray]:
    """z with E[z(a) . z(b)] = exp(-gamma ||a - b||^2)."""
    w, shift = _draw(gamma, dim, seed, n_in)
    return lambda x: np.cos(x @ w + shift) * math.sqrt(2.0 / dim)


class _Cosines:
    """``random_features`` without their scale, in single precision (errors of some 1e-6): rows -> (rows, features) cosines."""

    def __init__(self, gamma: float, dim: int, seed: int, n_in: int) -> None:
        w, shift = _draw(gamma, dim, seed, n_in)
        self.map, self.scale = np.vstack([w, shift]), math.sqrt(2.0 / dim)
        self.single, self.reach = self.map.astype(np.float32), np.abs(w).sum(axis=0).max()

    def angle_bound(self, x: np.ndarray) -> np.ndarray:
        """Per row, no angle is larger."""
        return np.abs(x).max(axis=1) * self.reach + 2 * math.pi

    def __call__(self, x: np.ndarray) -> np.ndarray:
        rows = np.ones((len(x), len(self.map)))
        rows[:, :-1] = x
        if len(x) and self.angle_bound(x).max() <= MAX_ANGLE:
            angle = rows.astype(np.float32) @ self.single
        else:
            turns = rows @ (self.map / (2 * math.pi))
            turns -= np.rint(turns)
            angle = turns.astype(np.float32)
            angle *= np.float32(2 * math.pi)
        return np.cos(angle, out=angle)


class _Given:
    """Features that come as an array column."""

    scale = 1.0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x


def _map_of(gamma: float | None, n_in: int, dim: int, seed: int) -> _Cosines | _Given:
    return _Given() if gamma is None else _Cosines(gamma, check_random_features(dim), seed, n_in)


# ------------------------------------------------------------------ rows of a batch
@dataclass(frozen=True)
class Members:
    """Groups that share rows: ``columns`` has each group's boolean column, ``stats`` its (medians, means, spreads)."""

    columns: dict[int, str]
    stats: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _needed(group_col: str, label: str, cols: list[str], members: Members | None) -> list[str]:
    return [*(members.columns.values() if members else [group_col]), label, *cols]


def _own_rows(batch: pa.RecordBatch, group_col: str, cols: list[str], label: str, members: Members | None, groups, given: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(group, its rows' features, labels) of a batch, for the wanted groups."""
    y = _column(batch, label).astype(float)
    if given:
        x = np.stack(_column(batch, cols[0])) if batch.num_rows else np.zeros((0, 0))
    else:
        x = np.stack([_column(batch, c).astype(float) for c in cols], axis=1)
    if members is None:
        group = _column(batch, group_col)
        for g in groups:
            own = group == g
            if own.any():
                yield (g, x, y) if own.all() else (g, x[own], y[own])
        return
    missing = np.stack([batch.column(batch.schema.get_field_index(c)).is_null().to_numpy(zero_copy_only=False) for c in cols], axis=1)
    for g in groups:
        own = np.flatnonzero(_column(batch, members.columns[g]))
        if len(own):
            median, mean, spread = members.stats[g]
            yield g, (np.where(missing[own], median, x[own]) - mean) / spread, y[own]


def scaled_sums(rows: DataFrame, cols: list[str], members: Members) -> dict[int, tuple[int, float, float]]:
    """Group -> (rows, sum of all scaled values, sum of their squares)."""
    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {g: np.zeros(3) for g in members.columns}
        for batch in batches:
            for g, x, _ in _own_rows(batch, "", cols, cols[0], members, members.columns):
                total[g] += [len(x), x.sum(), (x * x).sum()]
        table = np.array(list(total.values()))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), *[pa.array(table[:, i]) for i in range(3)]], ["g", "n", "m", "q"])

    per_task = rows.select(*members.columns.values(), *cols).mapInArrow(added, "g int, n double, m double, q double")
    sums = per_task.groupBy("g").agg(*[F.sum(c).alias(c) for c in "nmq"]).collect()   # a row per group
    return {r["g"]: (int(r["n"]), r["m"], r["q"]) for r in sums if r["n"]}


# ------------------------------------------------------------------ sums over rows
def _sums(z: np.ndarray, scale: float, sign: np.ndarray, models: list[tuple], add: Callable[[int, np.ndarray, np.ndarray], None]) -> None:
    """For each model (id, points, width, following), over rows ``scale`` z with signs +-1: (losses at every point, loss at the first point with the ``following`` width, hinge,
    slopes, pull on the weights and on the intercept, features and number of the rows in the corner) and the features' products
    over the corner, all but the losses at the first point. Points are (weights, intercept)."""
    stacked = np.concatenate([points for _, points, _, _ in models])
    margins = (scale * stacked[:, :-1]).astype(z.dtype) @ z.T
    short = 1 - sign.astype(z.dtype) * (margins + stacked[:, -1:].astype(z.dtype))   # a row per point
    pulls, parts, at = np.empty((len(models), len(z)), z.dtype), [], 0
    for i, (_, points, width, following) in enumerate(models):
        own = short[at:at + len(points)]
        at += len(points)
        loss = _rounded(own, width).sum(axis=1, dtype=float)
        own = own[0]
        slope = np.clip((own + width) / (2 * width), 0, 1)
        np.multiply(slope, sign, out=pulls[i], casting="same_kind")
        corner = z[np.flatnonzero(np.abs(own) < width)]
        parts.append((np.append(loss, [_rounded(own, following).sum(dtype=float), np.maximum(own, 0).sum(dtype=float), slope.sum(dtype=float)]), corner))
    towards = scale * (pulls @ z).astype(float)
    for (m, *_), pull, row, (scalars, corner) in zip(models, pulls, towards, parts):
        add(m, np.concatenate([scalars, row, [pull.sum(dtype=float)], scale * corner.sum(axis=0, dtype=float), [len(corner)]]), corner.T @ corner)


def _rounded(short: np.ndarray, width: float) -> np.ndarray:
    """max(0, short) with its corner rounded: (short + width)^2 / (4 width) inside +-width."""
    bent = np.clip(short, -width, width)
    bent += width
    bent *= bent
    bent /= 4 * width
    bent += np.maximum(short - width, 0)
    return bent


@dataclass
class _Fit:
    """One model between passes: the point reached, the step to try, the width of the corner."""

    reg: float
    n: int
    point: np.ndarray               # weights and intercept
    at: int = 0                     # place in WIDTHS
    aim: int = 0                    # the place to go to, by the last pass
    hidden: float = math.inf        # what the rounding may hide, and rows in the corner
    corner: float = 0.0
    step: np.ndarray | None = None
    value: float = math.inf         # rounded objective at the point
    objective: float = 0.0
    excess: float = math.inf
    decrement: float = math.inf
    passes: int = 0

    @property
    def width(self) -> float:
        return WIDTHS[self.at]

    @property
    def following(self) -> float:
        return WIDTHS[max(self.aim, min(self.at + 1, len(WIDTHS) - 1))]

    def widest(self, more: float = 1.0) -> int:
        """The widest width that hides little enough and, with ``more`` times the rows, has plenty in its corner."""
        enough = HIDDEN * TOLERANCE * self.objective + FLOOR
        place = next((i for i, w in enumerate(WIDTHS) if self.hidden * (w / self.width) ** 2 <= enough), len(WIDTHS) - 1)
        while place and self.corner * more * WIDTHS[place] / self.width < PLENTY * len(self.point):
            place -= 1
        return place

    def points(self) -> np.ndarray:
        return self.point[None] if self.step is None else np.stack([self.point + t * self.step for t in STEPS])

    def _penalty(self, points: np.ndarray) -> np.ndarray:
        return self.reg / 2 * (points[..., :-1] ** 2).sum(axis=-1)

    def update(self, flat: np.ndarray, curvature: np.ndarray) -> None:
        """Take what a pass added up at ``points()``."""
        self.passes += 1
        points, d = self.points(), len(self.point) - 1
        t = len(points)
        values = flat[:t] / self.n + self._penalty(points)
        if self.step is not None and values[0] > self.value + NOISE * abs(self.value):
            best = int(np.argmin(values))
            if values[best] < self.value:   # the gradient there comes with the next pass
                self.point, self.value, self.step = points[best], values[best], None
            else:
                self.step = self.step * STEPS[-1] / 5
            return
        following, hinge, slopes = flat[t:t + 3] / self.n
        loss_gradient = -flat[t + 3:t + 4 + d] / self.n
        row, corner = flat[t + 4 + d:t + 4 + 2 * d], flat[-1]
        self.point, self.value = points[0], values[0]
        w = self.point[:-1]
        # the slopes are a dual point; an unbalanced sum of them costs at most the intercept's bound
        self.objective = hinge + float(self._penalty(self.point))
        dual = slopes - (loss_gradient[:-1] ** 2).sum() / (2 * self.reg) - (2 + 2 * abs(self.point[-1])) * abs(loss_gradient[-1])
        gradient = loss_gradient.copy()
        gradient[:-1] += self.reg * w
        h = np.zeros((d + 1, d + 1))
        h[:-1, :-1], h[:-1, -1], h[-1, :-1], h[-1, -1] = curvature, row, row, corner
        h /= 2 * self.width * self.n
        h[np.arange(d), np.arange(d)] += self.reg
        h[np.arange(d + 1), np.arange(d + 1)] += 1e-12 * max(h.trace() / (d + 1), 1e-12)
        self.step = -np.linalg.solve(h, gradient)
        self.decrement = float(-self.step @ gradient) / 2
        # the rounded loss is at most width / 4 above the hinge, on the rows of the corner
        self.hidden, self.corner = self.width / 4 * corner / self.n, corner
        self.excess = min(max(self.objective - dual, 0.0), self.decrement + self.hidden)
        near = max(TOLERANCE / 5 * self.value, self.hidden / 4 if corner >= PLENTY * (d + 1) else 0.0)
        if self.decrement <= near + FLOOR and self.at + 1 < len(WIDTHS):
            ratio = self.following / self.width     # as many rows per width
            self.hidden, self.corner = self.hidden * ratio ** 2, self.corner * ratio
            self.at = WIDTHS.index(self.following)
            self.value = following + float(self._penalty(self.point))
        self.aim = max(self.at, self.widest())

    def done(self, tolerance: float = TOLERANCE) -> bool:
        return self.excess <= tolerance * self.objective + FLOOR


def _solve_rows(z: np.ndarray, sign: np.ndarray, reg: float, tolerance: float = TOLERANCE / 100) -> tuple[np.ndarray, float, float]:
    """Point, objective and duality gap on rows in memory, by a primal-dual interior-point method: a are the dual
    values (0 to 1 a row), s and t the slacks of their bounds, and w follows from a."""
    n, d = z.shape
    if abs(sign.sum()) == n:     # one class: the intercept is that class
        return np.append(np.zeros(d), sign[0]), 0.0, 0.0
    x, a, s, t, b = z * sign[:, None], np.full(n, 0.5), np.ones(n), np.ones(n), 0.0
    best = (np.zeros(d + 1), math.inf, math.inf)
    for _ in range(START_STEPS):
        w = x.T @ a / (n * reg)
        margin = x @ w + sign * b
        objective = np.maximum(1.0 - margin, 0.0).mean() + reg / 2 * (w @ w)
        dual = a.mean() - reg / 2 * (w @ w) - (1 + abs(b)) * abs((sign * a).mean())
        if objective - dual < best[2]:
            best = (np.append(w, b), float(objective), float(max(objective - dual, 0.0)))
        if best[2] <= tolerance * best[1] + FLOOR:
            break
        room = 1.0 - a
        mu = 0.1 * (a @ s + room @ t) / (2 * n)
        weight = 1.0 / (s / a + t / room)
        rest = weight * (1.0 - margin + mu / a - mu / room)
        weighted = x * weight[:, None]
        h = np.empty((d + 1, d + 1))
        h[:-1, :-1] = weighted.T @ x
        h[np.arange(d), np.arange(d)] += n * reg
        h[:-1, -1] = h[-1, :-1] = weighted.T @ sign
        h[-1, -1] = weight.sum()
        move = np.linalg.solve(h, np.append(x.T @ rest, sign @ rest + sign @ a))
        da = rest - weight * (x @ move[:-1] + sign * move[-1])
        ds, dt = (mu - s * da) / a - s, (mu + t * da) / room - t
        step = min(1.0, 0.99 / max(np.max(-da / a), np.max(da / room), np.max(-ds / s), np.max(-dt / t), 1e-300))
        a, s, t, b = a + step * da, s + step * ds, t + step * dt, b + step * move[-1]
    return best


# ------------------------------------------------------------------ the grid
def _first_points(train: DataFrame, group_col: str, cols: list[str], label: str, specs: list[ModelSpec], sizes: dict, seed: int, dim: int,
                  members: Members | None = None) -> dict[int, tuple[np.ndarray, float, float]]:
    """(point, objective, gap) of every model on a few rows of its group, all of them in a small group: one task per model."""
    check_random_features(dim)
    groups = sorted({s.group for s in specs})
    by_id, given = {s.model_id: s for s in specs}, specs[0].gamma is None
    first = {g: sizes[g] if sizes[g] <= START_ROWS else min(PART_ROWS, START_ROWS) for g in groups}
    luck, trained = F.col("_luck"), []
    for g in groups:
        here = F.col(members.columns[g]) if members else F.col(group_col) == g
        here = here if first[g] == sizes[g] else here & (luck < F.lit(first[g] / sizes[g]))
        trained.append(F.when(here, F.array(*[F.lit(s.model_id) for s in specs if s.group == g])).otherwise(F.array().cast("array<int>")))
    names = _needed(group_col, label, cols, members)
    few = train.select(*names).withColumn("_luck", F.rand(seed)).withColumn("_models", F.concat(*trained)).where(F.size("_models") > 0)
    few = few.select(*names, F.explode("_models").alias("_model"))

    def solve(table: pa.Table) -> pa.Table:
        spec = by_id[table.column("_model")[0].as_py()]
        batch = table.combine_chunks().to_batches()[0]
        (_, x, y), = _own_rows(batch, group_col, cols, label, members, [spec.group], given)
        z = x if spec.gamma is None else random_features(spec.gamma, dim, seed, len(cols))(x)
        whole = first[spec.group] == sizes[spec.group]
        point, objective, gap = _solve_rows(z, 2.0 * y - 1.0, 1.0 / (spec.C * sizes[spec.group]), TOLERANCE / 100 if whole else PART_TOLERANCE)
        return pa.table({"model_id": pa.array([spec.model_id], pa.int32()), "point": pa.array([point], pa.list_(pa.float64())), "objective": [float(objective)], "gap": [float(gap)]})

    found = few.groupBy("_model").applyInArrow(solve, "model_id int, point array<double>, objective double, gap double")
    return {r["model_id"]: (np.array(r["point"]), r["objective"], r["gap"]) for r in found.collect()}   # a row per model


def _pass(train: DataFrame, group_col: str, cols: list[str], label: str, specs: list[ModelSpec], fits: dict[int, _Fit], seed: int, dim: int,
          members: Members | None = None) -> None:
    """One job over all rows of the open models' groups; every open model takes its sums."""
    shared = train.sparkSession.sparkContext.broadcast({
        s.model_id: (s.group, s.gamma, fits[s.model_id].points(), fits[s.model_id].width, fits[s.model_id].following) for s in specs})
    given = specs[0].gamma is None

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_group: dict = {}
        for m, (group, gamma, *rest) in shared.value.items():
            by_group.setdefault(group, {}).setdefault(gamma, []).append((m, *rest))
        maps, total = {}, {}

        def add(m: int, flat: np.ndarray, curvature: np.ndarray) -> None:
            if m in total:
                total[m][0] += flat
                total[m][1] += curvature
            else:
                total[m] = [flat, curvature.astype(float)]

        for batch in batches:
            for group, x, y in _own_rows(batch, group_col, cols, label, members, by_group, given):
                sign = 2.0 * y - 1.0
                for gamma, models in by_group[group].items():
                    if gamma not in maps:
                        maps[gamma] = _map_of(gamma, len(cols), dim, seed)
                    _sums(maps[gamma](x), maps[gamma].scale, sign, models, add)
        for m, (flat, curvature) in total.items():
            curvature *= maps[shared.value[m][1]].scale ** 2
            blocks = [flat, *(curvature[lo:lo + BLOCK].ravel() for lo in range(0, len(curvature), BLOCK))]
            yield pa.RecordBatch.from_arrays([pa.array([m] * len(blocks), pa.int32()), pa.array(range(len(blocks)), pa.int32()),
                                              pa.array(blocks, pa.list_(pa.float64()))], ["model_id", "block", "sums"])

    def together(table: pa.Table) -> pa.Table:
        sums = table.column("sums").combine_chunks()
        whole = sums.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1).sum(axis=0)
        return pa.table({"model_id": table.column("model_id")[:1], "block": table.column("block")[:1], "sums": pa.array([whole], pa.list_(pa.float64()))})

    groups = sorted({s.group for s in specs})
    tasks = TASKS_PER_CORE * train.sparkSession.sparkContext.defaultParallelism
    rows = train if members else train.where(F.col(group_col).isin(groups))
    rows = rows.select(*_needed(group_col, label, cols, members)).coalesce(tasks)
    schema = "model_id int, block int, sums array<double>"
    summed = rows.mapInArrow(added, schema).groupBy("model_id", "block").applyInArrow(together, schema).toPandas()
    for m, own in summed.sort_values("block").groupby("model_id"):
        flat, *blocks = own["sums"].to_list()
        fits[m].update(np.asarray(flat), np.concatenate(blocks).reshape(-1, len(fits[m].point) - 1))
    shared.unpersist()


def _group_sizes(train: DataFrame, group_col: str, members: Members | None) -> dict[int, int]:
    """Rows of every group that has some."""
    if members:
        r = train.agg(*[F.count_if(F.col(c)).alias(c) for c in members.columns.values()]).first()
        return {g: r[c] for g, c in members.columns.items() if r[c]}
    return {r[group_col]: r["n"] for r in train.groupBy(group_col).agg(F.count(F.lit(1)).alias("n")).collect()}


def _from_sample(train: DataFrame, group_col: str, cols: list[str], label: str, specs: list[ModelSpec], fits: dict[int, _Fit], seed: int, dim: int,
                 members: Members | None) -> None:
    """Passes over a share of the rows bring the points of large groups near the optimum; the passes over all rows go on from there."""
    few = stored(train.where(F.rand(seed + 1) < SAMPLE_SHARE).select(*_needed(group_col, label, cols, members)))
    sizes = _group_sizes(few, group_col, members)
    near = {s.model_id: _Fit(fits[s.model_id].reg, sizes[s.group], fits[s.model_id].point) for s in specs if sizes.get(s.group)}
    open_ = [s for s in specs if s.model_id in near]
    for _ in range(SAMPLE_PASSES):
        if not open_:
            break
        _pass(few, group_col, cols, label, open_, near, seed, dim, members)
        open_ = [s for s in open_ if not near[s.model_id].done(SAMPLE_TOLERANCE)]
    for m, fit in near.items():
        if math.isfinite(fit.value):
            fits[m].point, fits[m].at = fit.point, fit.widest(fits[m].n / fit.n)


def fit_grid(train: DataFrame, group_col: str, cols: list[str], label: str, specs: list[ModelSpec], seed: int,
             dim: int = RANDOM_FEATURES, members: Members | None = None) -> dict[int, MarginModel]:
    """One model per spec. ``train`` is read once per pass: store it first, by ``group_col`` if there are several groups
    without ``members``."""
    if len({s.gamma is None for s in specs}) > 1:
        raise ValueError("models on given features and on kernel widths are separate grids")
    sizes = _group_sizes(train, group_col, members)
    missing = sorted({s.group for s in specs if s.group not in sizes})
    if missing:
        raise ValueError(f"no rows to train on in groups {missing}")
    first = _first_points(train, group_col, cols, label, specs, sizes, seed, dim, members)
    given = len(train.select(cols[0]).first()[0]) if any(s.gamma is None for s in specs) else 0
    fits = {}
    for s in specs:
        point, objective, gap = first.get(s.model_id, (np.zeros((given if s.gamma is None else dim) + 1), 0.0, math.inf))
        fits[s.model_id] = _Fit(1.0 / (s.C * sizes[s.group]), sizes[s.group], point)
        if sizes[s.group] <= START_ROWS:   # these were all rows
            fits[s.model_id].objective, fits[s.model_id].excess = objective, gap
    open_ = [s for s in specs if not fits[s.model_id].done()]
    large = [s for s in open_ if sizes[s.group] * SAMPLE_SHARE >= SAMPLE_ROWS]
    if large:
        _from_sample(train, group_col, cols, label, large, fits, seed, dim, members)
    for _ in range(MAX_PASSES):
        if not open_:
            break
        _pass(train, group_col, cols, label, open_, fits, seed, dim, members)
        open_ = [s for s in open_ if not fits[s.model_id].done()]
    if open_:
        worst = max((fits[s.model_id] for s in open_), key=lambda f: f.excess)
        raise RuntimeError(f"{len(open_)} margin models did not reach tolerance {TOLERANCE} in {MAX_PASSES} passes (excess {worst.excess}, objective {worst.objective})")
    return {m: MarginModel(Vectors.dense(f.point[:-1]), float(f.point[-1]), f.objective, f.excess, f.passes) for m, f in fits.items()}


def score(data: DataFrame, cols: list[str], gamma: float | None, model: MarginModel, dim: int, seed: int) -> DataFrame:
    """``score`` (signed margin) and ``pred`` per row."""
    w, b = model.coefficients.toArray(), model.intercept
    z = None if gamma is None else random_features(gamma, check_random_features(dim), seed, len(cols))

    @F.pandas_udf("double")
    def margins(x: pd.DataFrame) -> pd.Series:
        return pd.Series((np.stack(x[cols[0]].to_numpy()) if z is None else z(x.to_numpy(dtype=float))) @ w + b)

    return data.withColumn("score", margins(F.struct(*cols))).withColumn("pred", (F.col("score") > 0).cast("int"))


def _margins(rows: pd.DataFrame, group_col: str, cols: list[str], by_group: dict, weights: dict, maps: dict):
    """(model_id, rows, margins) of a batch, every group's rows by the group's models."""
    for group, own in rows.groupby(group_col):
        models = by_group.get(group, [])
        z = {g: np.stack(own[cols[0]].to_numpy()) if g is None else maps[g](own[cols].to_numpy(dtype=float)) for g in {s.gamma for s in models}}
        for s in models:
            w, b = weights[s.model_id]
            yield s.model_id, own, z[s.gamma] @ w + b


def _model_tables(specs: list[ModelSpec], models: dict[int, MarginModel]) -> tuple[dict, dict]:
    by_group: dict[int, list[ModelSpec]] = {}
    for s in specs:
        by_group.setdefault(s.group, []).append(s)
    return by_group, {s.model_id: (models[s.model_id].coefficients.toArray(), models[s.model_id].intercept) for s in specs}


def score_grid(data: DataFrame, group_col: str, cols: list[str], label: str, key: str, specs: list[ModelSpec],
               models: dict[int, MarginModel], seed: int, dim: int = RANDOM_FEATURES) -> DataFrame:
    """(model_id, key, y, score, pred): every row of a group scored by the group's models in one pass.

    The weights of a group's models form one bounded matrix (models x features) inside the closure."""
    by_group, weights = _model_tables(specs, models)

    def scored(batches):
        maps = {s.gamma: random_features(s.gamma, dim, seed, len(cols)) for s in specs if s.gamma is not None}
        for batch in batches:
            for m, rows, margin in _margins(batch, group_col, cols, by_group, weights, maps):
                yield pd.DataFrame({"model_id": m, key: rows[key], label: rows[label], "score": margin, "pred": (margin > 0).astype("int32")})

    return data.select(group_col, key, label, *cols).mapInPandas(
        scored, f"model_id int, {key} string, {label} int, score double, pred int")


def _hits(x: np.ndarray, maps: dict, gamma: float | None, weights: np.ndarray, intercepts: np.ndarray) -> np.ndarray:
    """(rows, models): margin > 0, as in double precision. Margins come from single precision; rows nearer to zero than a
    bound of the error are taken again in double."""
    if gamma is None:
        return x @ weights.T + intercepts > 0
    cosines, exact = maps[gamma]
    total = cosines.scale * np.abs(weights).sum(axis=1)
    margin = (cosines(x) @ (cosines.scale * weights).T.astype(np.float32)).astype(float) + intercepts
    # rounded inputs, products and sums of an angle below the bound, the cosine, and the sum over the features
    error = 2.0 ** -24 * ((x.shape[1] + 4) * np.minimum(cosines.angle_bound(x), MAX_ANGLE)[:, None] + weights.shape[1] + 8) * total
    hit = margin > 0
    near = np.flatnonzero(~(np.abs(margin) > error).all(axis=1))
    if len(near):
        hit[near] = exact(x[near]) @ weights.T + intercepts > 0
    return hit


def confusion_grid(data: DataFrame, group_col: str, cols: list[str], label: str, specs: list[ModelSpec],
                   models: dict[int, MarginModel], seed: int, dim: int = RANDOM_FEATURES) -> DataFrame:
    """(model_id, tn, fp, fn, tp) of ``score_grid``'s predictions, added up inside the tasks: no row per row and model."""
    by_group, weights = _model_tables(specs, models)
    given = specs[0].gamma is None

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = {s.gamma: (_map_of(s.gamma, len(cols), dim, seed), random_features(s.gamma, dim, seed, len(cols))) for s in specs if s.gamma is not None}
        stacks: dict = {}
        for group, own in by_group.items():
            for gamma in {s.gamma for s in own}:
                ids = [s.model_id for s in own if s.gamma == gamma]
                stacks.setdefault(group, []).append((gamma, ids, np.stack([weights[m][0] for m in ids]), np.array([weights[m][1] for m in ids])))
        total = {s.model_id: np.zeros(4, np.int64) for s in specs}
        for batch in batches:
            for group, x, y in _own_rows(batch, group_col, cols, label, None, stacks, given):
                no, yes = y == 0, y == 1   # a missing label is in no cell
                for gamma, ids, w, b in stacks[group]:
                    hit = _hits(x, maps, gamma, w, b)
                    for i, m in enumerate(ids):
                        fp, tp = int((hit[:, i] & no).sum()), int((hit[:, i] & yes).sum())
                        total[m] += [int(no.sum()) - fp, fp, int(yes.sum()) - tp, tp]
        table = np.array(list(total.values())).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), *[pa.array(table[:, i]) for i in range(4)]], ["model_id", "tn", "fp", "fn", "tp"])

    per_task = data.select(group_col, label, *cols).mapInArrow(counted, "model_id int, tn long, fp long, fn long, tp long")
    return per_task.groupBy("model_id").agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")])
