"""Kernel support-vector machines on bounded subsets, trained over whole run grids, and their one-pass scorer.

Training. A (run, fold) group holds one balanced subset (at most ``MAX_LANDMARKS`` rows): the task computes the Gram
matrix of every kernel once and solves the dual for all penalties C, each warm-started from the one before (a feasible
point, as bounds only widen). The dual is climbed by exact two-coordinate steps on the pair that gains most by a
second-order estimate; a fit ends when no pair of slopes violates the optimality conditions by more than
``VIOLATION``, and its duality gap, returned with it, must then be below ``GAP`` of the objective: a result never
depends on a step limit. Folds of all runs are dealt over the tasks; validation
predictions come back as rows and are scored, averaged and ranked by Spark.

Prediction. The refit returns a coefficient table: one row per support vector with its dual weight, the model's
intercept and gap. ``MultiRunScorer`` reads that table (with a check of its bytes) and scores un-copied raw rows: a
task holds a batch once, prepares it with every run's statistics in turn and multiplies its kernel block with the
weights, in row chunks of a fixed number of bytes. Confusion counts of all runs and models come
out of the same pass, a row per task and model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import recursions as rec
from ..functions.columns import ANGLE_CLIP
from . import metrics as met
from . import sampling
from .kernels import MAX_LANDMARKS, MAX_RUNS

SINGLE_ERROR = 1.5e-6          # of a kernel's amplitude in single precision, per feature and repetition (measured: 4e-8)
VIOLATION = 1e-9               # of the optimality conditions, in units of the margin
GAP = 1e-6                     # duality gap over objective that a fit must reach
MAX_STEPS_PER_ROW = 20_000     # beyond this a fit is an error
MODEL_BYTES = 256 << 20        # support vectors of all models that a scorer may hold


@dataclass(frozen=True)
class Machine:
    """One kernel with its parameter grid: a feature map's fidelity on angles, or RBF on scaled features."""

    name: str
    feature_map: str | None = None
    repetitions: int = 1
    c_grid: tuple[float, ...] = (0.1, 1.0, 10.0)
    gamma_grid: tuple = (None,)

    def __post_init__(self) -> None:
        if self.feature_map is not None:
            rec.check_map(self.feature_map, self.repetitions)
        elif None in self.gamma_grid:
            raise ValueError(f"{self.name}: an RBF kernel needs widths")

    def params(self, c: float, gamma) -> str:
        return f"C={c}" if gamma is None else f"C={c},gamma={gamma}"

    def order(self) -> list[str]:
        return [self.params(c, g) for c in self.c_grid for g in self.gamma_grid]

    def matrix(self, scaled_a: np.ndarray, scaled_b: np.ndarray, gamma: float | None) -> np.ndarray:
        if self.feature_map is None:
            return rbf_matrix(scaled_a, scaled_b, gamma)
        return rec.fidelity_matrix(self.feature_map, self.repetitions, angles(scaled_a), angles(scaled_b))

    def signs(self, scaled: np.ndarray, vectors: np.ndarray, weights: np.ndarray, intercept: float, gamma: float | None) -> np.ndarray:
        """Whether each row's decision value is positive. Fidelities are taken in single precision first: where the value is
        clear of zero by more than the weights can make of their error, its sign is that of double precision;
        the other rows are computed in double precision."""
        if self.feature_map is None or not 2 <= scaled.shape[1] <= 2 * rec.MAX_HALF:
            return self.matrix(scaled, vectors, gamma) @ weights + intercept > 0
        near = rec.fidelity_matrix(self.feature_map, self.repetitions, angles(scaled).astype(np.float32), angles(vectors).astype(np.float32))
        both = near @ np.stack([weights, np.abs(weights)], axis=1).astype(np.float32)
        value, size = both[:, 0] + intercept, np.abs(weights).sum()
        error = SINGLE_ERROR * scaled.shape[1] * self.repetitions
        # K = |A|^2 is off by 2 |A| error, and sum |c| sqrt(K) <= sqrt(sum |c| * sum |c| K); a product over features has no A
        product = self.feature_map == "pauli" or (self.feature_map, self.repetitions) == ("custom", 1)
        slack = error * size if product else 2.0 * error * np.sqrt(size * (both[:, 1] + error * size))
        # rounding of the sums
        slack = slack + np.finfo(np.float32).eps * (len(weights) + 2) * (both[:, 1] + abs(intercept))
        out = value > 0
        unsure = np.flatnonzero(~(np.abs(value) > slack))
        if len(unsure):
            out[unsure] = self.matrix(scaled[unsure], vectors, gamma) @ weights + intercept > 0
        return out


def rbf_machine(c_grid, gamma_grid, name: str = "SVM-RBF") -> Machine:
    return Machine(name, None, 1, tuple(float(c) for c in c_grid), tuple(gamma_grid))


def angles(scaled: np.ndarray) -> np.ndarray:
    """Clip to [-3, 3] and scale to [-pi, pi]."""
    return np.clip(scaled, -ANGLE_CLIP, ANGLE_CLIP) / ANGLE_CLIP * np.pi


def rbf_matrix(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma |a - b|^2) from norms and one product; the block is worked on in place."""
    d = (a * (2.0 * gamma)) @ b.T
    d -= gamma * (a * a).sum(axis=1)[:, None]
    d -= gamma * (b * b).sum(axis=1)[None, :]
    np.minimum(d, 0.0, out=d)
    return np.exp(d, out=d)


def width(gamma, rows: np.ndarray) -> float | None:
    """'scale': 1 / (features x variance of all values); 'auto': 1 / features; or the number itself."""
    if gamma is None or not isinstance(gamma, str):
        return gamma
    spread = rows.var() if gamma == "scale" else 1.0
    return 1.0 / (rows.shape[1] * spread) if spread > 0 else 1.0


# ------------------------------------------------------------------ the dual
@dataclass
class Dual:
    alpha: np.ndarray
    intercept: float
    gap: float          # primal minus dual objective
    objective: float    # primal
    steps: int = 0


def solve_dual(k: np.ndarray, y: np.ndarray, c: float, start: np.ndarray | None = None) -> Dual:
    """Hinge-loss SVM with intercept on a Gram matrix; y in {-1, 1}, 0 <= alpha <= c, y' alpha = 0.

    Rows of a single class have no separating direction: the intercept is that class."""
    n = len(y)
    if not n or abs(y.sum()) == n:
        return Dual(np.zeros(n), float(y[0]) if n else 0.0, 0.0, 0.0)
    alpha = np.zeros(n) if start is None else np.clip(start, 0.0, c)
    grad, exact = y * (k @ (alpha * y)) - 1.0, True
    diag = np.diag(k)
    for step in range(MAX_STEPS_PER_ROW * n + 1):
        slope = -y * grad
        up = ((y > 0) & (alpha < c)) | ((y < 0) & (alpha > 0))
        down = ((y > 0) & (alpha > 0)) | ((y < 0) & (alpha < c))
        i = int(np.argmax(np.where(up, slope, -np.inf)))
        high, low = slope[i], slope[down].min()
        if high - low <= VIOLATION:
            if not exact:  # once more without accumulated rounding
                grad, exact = y * (k @ (alpha * y)) - 1.0, True
                continue
            quad, b = alpha @ (grad + 1.0), (high + low) / 2
            primal = quad / 2 + c * np.maximum(0.0, -grad - y * b).sum()
            gap = max(primal - alpha.sum() + quad / 2, 0.0)
            if gap > GAP * primal:
                raise RuntimeError(f"duality gap {gap} of a kernel machine with C={c} at objective {primal}")
            return Dual(alpha, b, gap, primal, step)
        gain = slope[i] - slope
        curve = np.maximum(diag[i] + diag - 2.0 * k[i], 1e-12)
        j = int(np.argmax(np.where(down & (gain > 0), gain * gain / curve, -np.inf)))
        # along y_i alpha_i + y_j alpha_j = constant
        room_i = c - alpha[i] if y[i] > 0 else alpha[i]
        room_j = alpha[j] if y[j] > 0 else c - alpha[j]
        move = min(gain[j] / curve[j], room_i, room_j)
        alpha[i] = min(max(alpha[i] + y[i] * move, 0.0), c)
        alpha[j] = min(max(alpha[j] - y[j] * move, 0.0), c)
        grad += y * move * (k[:, i] - k[:, j])
        exact = False
    raise RuntimeError(f"a kernel machine with C={c} did not reach {VIOLATION} in {step} steps")


def _path(k: np.ndarray, y: np.ndarray, c_grid: tuple[float, ...]) -> Iterator[tuple[float, Dual]]:
    """Fits along ascending C, each started from the last."""
    start = None
    for c in sorted(c_grid):
        fit = solve_dual(k, y, c, start)
        start = fit.alpha.copy()
        yield c, fit


# ------------------------------------------------------------------ cross-validation and refit
CV_ROWS = "run_id int, model string, params string, C double, gamma string, fold int, {key} string, {y} int, score double, pred int, gap double, objective double"


def _checked(rows: pd.DataFrame) -> pd.DataFrame:
    if len(rows) > MAX_LANDMARKS:
        raise ValueError(f"{len(rows)} rows: kernel machines are trained on subsets of at most {MAX_LANDMARKS}")
    return rows.sort_values("position", kind="stable")


def cross_validated(subsets: DataFrame, machines: list[Machine], features: list[str], k: int, key: str = "row_key", target: str = "y") -> DataFrame:
    """Rows of CV_ROWS: every subset row's score by the model that did not see its fold, for every run, machine and parameter set.

    ``subsets``: run_id, seed, position, key, target and scaled features; folds are stratified in each run by its own seed."""
    counts: dict[int, dict] = {}
    for row in subsets.groupBy("run_id", target).count().collect():  # runs x 2 rows
        counts.setdefault(row["run_id"], {})[row[target]] = row["count"]
    for c in counts.values():
        sampling.check_folds(c, k)
    rows = subsets.select("run_id", "seed", "position", key, target, *features)
    folded = sampling.stratified_folds(rows, target, key, 0, k, group_cols=["run_id"], max_groups=2 * max(1, len(counts)))
    dealt = folded.withColumnRenamed("fold", "_own").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))  # runs x folds subsets

    def fold_fits(group: pd.DataFrame) -> pd.DataFrame:
        group = _checked(group)
        run, fold = int(group["run_id"].iloc[0]), int(group["fold"].iloc[0])
        x, sign = group[features].to_numpy(float), 2.0 * group[target].to_numpy(float) - 1.0
        held = group["_own"].to_numpy() == fold
        out = []
        for machine in machines:
            for gamma in machine.gamma_grid:
                gram = machine.matrix(x, x, width(gamma, x[~held]))
                for c, fit in _path(gram[np.ix_(~held, ~held)], sign[~held], machine.c_grid):
                    score = gram[np.ix_(held, ~held)] @ (fit.alpha * sign[~held]) + fit.intercept
                    out.append(pd.DataFrame({
                        "run_id": run, "model": machine.name, "params": machine.params(c, gamma), "C": c, "gamma": None if gamma is None else str(gamma),
                        "fold": fold, key: group[key].to_numpy()[held], target: group[target].to_numpy()[held], "score": score,
                        "pred": (score > 0).astype("int32"), "gap": fit.gap, "objective": fit.objective}))
        return pd.concat(out)
    return dealt.groupBy("run_id", "fold").applyInPandas(fold_fits, CV_ROWS.format(key=key, y=target))


def cv_table(validated: DataFrame, machines: list[Machine], target: str = "y") -> DataFrame:
    """(run_id, model, params, C, gamma, mean_f1, std_f1, folds, rank): fold F1 averaged, the first of the grid on ties."""
    grid = ["run_id", "model", "params", "C", "gamma"]
    f1 = met.threshold_metrics(validated, target, "pred", [*grid, "fold"])
    mean = f1.groupBy(*grid).agg(F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("std_f1"), F.count(F.lit(1)).alias("folds"))
    place = F.lit(0)
    for m in machines:
        place = F.when(F.col("model") == m.name, F.array_position(F.array(*[F.lit(p) for p in m.order()]), F.col("params"))).otherwise(place)
    best = Window.partitionBy("run_id", "model").orderBy(F.desc(F.round("mean_f1", 12)), place)  # over the grid
    return mean.withColumn("rank", F.row_number().over(best).cast("int"))


def refit(subsets: DataFrame, best: DataFrame, machines: list[Machine], features: list[str], key: str = "row_key", target: str = "y") -> DataFrame:
    """The coefficient table of every (run, machine) with its chosen C and gamma (``best``: rank 1 of ``cv_table``):
    run_id, model, C, width, key, target, position, coef (alpha y), intercept, gap, objective, features; support vectors only."""
    by_name = {m.name: m for m in machines}
    rows = subsets.select("run_id", "position", key, target, *features).join(
        F.broadcast(best.where("rank = 1").select("run_id", "model", "C", "gamma")), "run_id")  # a row per run and machine
    schema = f"run_id int, model string, C double, width double, {key} string, {target} int, position int, coef double, intercept double, gap double, objective double"
    schema += "".join(f", `{c}` double" for c in features)

    def whole_fit(group: pd.DataFrame) -> pd.DataFrame:
        group = _checked(group)
        first = group.iloc[0]
        machine = by_name[first["model"]]
        x, sign = group[features].to_numpy(float), 2.0 * group[target].to_numpy(float) - 1.0
        named = {None if g is None else str(g): g for g in machine.gamma_grid}
        gamma = width(named[first["gamma"] if isinstance(first["gamma"], str) else None], x)
        *_, (_, fit) = _path(machine.matrix(x, x, gamma), sign, tuple(c for c in machine.c_grid if c <= first["C"]))
        kept = fit.alpha > 0
        if not kept.any():
            kept[0] = True  # a constant model still needs its intercept
        out = group.loc[kept, ["run_id", key, target, "position", *features]].copy()
        out["model"], out["C"], out["width"] = machine.name, float(first["C"]), np.nan if gamma is None else float(gamma)
        out["coef"], out["intercept"], out["gap"], out["objective"] = (fit.alpha * sign)[kept], fit.intercept, fit.gap, fit.objective
        return out[["run_id", "model", "C", "width", key, target, "position", "coef", "intercept", "gap", "objective", *features]]
    return rows.groupBy("run_id", "model").applyInPandas(whole_fit, schema)


# ------------------------------------------------------------------ given matrices
def kernel_rows(kernel: DataFrame, landmarks: DataFrame, key: str = "row_key") -> DataFrame:
    """(i_key, row): each row's kernel values against all landmarks by their position (MAX_LANDMARKS values at most)."""
    at = landmarks.select(F.col(key).alias("j_key"), F.col("position").alias("_p"))
    cells = kernel.join(F.broadcast(at), "j_key")   # a subset
    return cells.groupBy("i_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "k"))), lambda s: s["k"]).alias("row"))


def precomputed_predictions(train: DataFrame, rows: DataFrame, k: int, c_grid: list[float], key: str = "row_key", target: str = "y") -> DataFrame:
    """(model, C, cv_f1, key, target, score, pred) of ``rows`` by a kernel SVM on given matrices (M6), one task per matrix.

    ``train``: model, position, fold, key, target, row (the Gram row by position); ``rows``: model, key, target, row."""
    grid = tuple(float(c) for c in c_grid)

    def fit_predict(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = _checked(left)
        gram, sign = np.stack(left["row"].to_numpy()), 2.0 * left[target].to_numpy(float) - 1.0
        fold = left["fold"].to_numpy()
        f1 = {c: [] for c in grid}
        for f in range(k):
            held = fold == f
            for c, fit in _path(gram[np.ix_(~held, ~held)], sign[~held], grid):
                yes = gram[np.ix_(held, ~held)] @ (fit.alpha * sign[~held]) + fit.intercept > 0
                both, either = (yes & (sign[held] > 0)).sum(), yes.sum() + (sign[held] > 0).sum()
                f1[c].append(2.0 * both / either if either else 0.0)
        mean = {c: float(np.mean(v)) for c, v in f1.items()}
        best = max(grid, key=lambda c: (round(mean[c], 12), -grid.index(c)))
        fit = solve_dual(gram, sign, best)
        score = np.stack(right["row"].to_numpy()) @ (fit.alpha * sign) + fit.intercept if len(right) else np.zeros(0)
        return pd.DataFrame({"model": left["model"].iloc[0], "C": best, "cv_f1": mean[best], key: right[key], target: right[target],
                             "score": score, "pred": (score > 0).astype("int32")})
    return train.groupBy("model").cogroup(rows.groupBy("model")).applyInPandas(
        fit_predict, f"model string, C double, cv_f1 double, {key} string, {target} int, score double, pred int")


# ------------------------------------------------------------------ one pass over all runs
@dataclass
class _Run:
    median: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    models: list = field(default_factory=list)  # (number, machine, support vectors, weights, intercept, width)


class MultiRunScorer:
    """All refitted models of a run grid, applied to raw rows that are read once and never copied per run."""

    def __init__(self, coefficients: DataFrame, stats: DataFrame, machines: list[Machine], features: list[str]) -> None:
        """``stats``: med_<f>, mu_<f>, sd_<f> per run_id (``prep.Preprocessor.stats``)."""
        by_name = {m.name: m for m in machines}
        bound = MAX_LANDMARKS * MAX_RUNS
        sums = coefficients.agg(F.count(F.lit(1)).alias("n")).first()["n"]
        if sums > bound or sums * 8 * (len(features) + 1) > MODEL_BYTES:
            raise ValueError(f"{sums} support vectors: a scorer holds at most {MODEL_BYTES >> 20} MB of them")
        table = coefficients.toPandas()
        self.features = list(features)
        self.names = sorted({(int(r), m) for r, m in zip(table["run_id"], table["model"])})
        runs = {r["run_id"]: _Run(*(np.array([r[f"{part}_{c}"] for c in features], float) for part in ("med", "mu", "sd"))) for r in stats.collect()}
        for number, (run, name) in enumerate(self.names):
            own = table[(table["run_id"] == run) & (table["model"] == name)]
            runs[run].models.append((number, by_name[name], own[features].to_numpy(float), own["coef"].to_numpy(float),
                                     float(own["intercept"].iloc[0]), None if np.isnan(own["width"].iloc[0]) else float(own["width"].iloc[0])))
        empty = [c for r in runs.values() if r.models for c, m in zip(features, r.median) if np.isnan(m)]
        if empty:
            raise ValueError(f"features without any observed value in a run: {sorted(set(empty))}")
        self.runs = {r: v for r, v in runs.items() if v.models}

    def _each(self, raw: np.ndarray, out: np.ndarray, value) -> np.ndarray:
        """``value`` of every model for the raw rows, in chunks of bounded work arrays; NaN is a missing value."""
        for run in self.runs.values():
            x = (np.where(np.isnan(raw), run.median, raw) - run.mean) / run.spread
            for number, machine, vectors, weights, intercept, gamma in run.models:
                step = rec.chunk_rows(len(vectors))
                for lo in range(0, len(x), step):
                    out[lo:lo + step, number] = value(machine, x[lo:lo + step], vectors, weights, intercept, gamma)
        return out

    def scores(self, raw: np.ndarray) -> np.ndarray:
        """(rows, models) decision values of raw rows."""
        return self._each(raw, np.empty((len(raw), len(self.names))),
                          lambda machine, x, vectors, weights, intercept, gamma: machine.matrix(x, vectors, gamma) @ weights + intercept)

    def signs(self, raw: np.ndarray) -> np.ndarray:
        """(rows, models): ``scores(raw) > 0``."""
        return self._each(raw, np.empty((len(raw), len(self.names)), bool), Machine.signs)

    def _raw(self, batch: pa.RecordBatch) -> np.ndarray:
        columns = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in self.features]
        return np.stack(columns, axis=1) if batch.num_rows else np.zeros((0, len(self.features)))

    def confusion(self, rows: DataFrame, target: str = "y") -> DataFrame:
        """(run_id, model, tn, fp, fn, tp) over all rows with a label, in one pass."""
        shared = rows.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = shared.value
            total = np.zeros((len(scorer.names), 4), np.int64)
            for batch in batches:
                y = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                cell = 2 * y[:, None] + scorer.signs(scorer._raw(batch))
                for code in range(4):
                    total[:, code] += (cell == code).sum(axis=0)
            yield pa.RecordBatch.from_arrays([
                pa.array([r for r, _ in scorer.names], pa.int32()), pa.array([m for _, m in scorer.names], pa.string()), *[pa.array(total[:, i]) for i in range(4)]],
                ["run_id", "model", "tn", "fp", "fn", "tp"])
        per_task = rows.where(F.col(target).isNotNull()).select(F.col(target).cast("int").alias(target), *self.features).mapInArrow(
            run, "run_id int, model string, tn long, fp long, fn long, tp long")
        return per_task.groupBy("run_id", "model").agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")])

    def metrics(self, rows: DataFrame, target: str = "y") -> DataFrame:
        """Threshold metrics of every run and model on ``rows``."""
        counts = self.confusion(rows, target)
        return counts.select("run_id", "model", "tn", "fp", "fn", "tp", *met.metric_columns(*[F.col(c) for c in ("tn", "fp", "fn", "tp")]))

    def score_column(self, rows: DataFrame, run_id: int, model: str) -> Column:
        """Decision value of one model as a column over the raw features."""
        number = self.names.index((run_id, model))
        shared = rows.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def score(x: pd.DataFrame) -> pd.Series:
            return pd.Series(shared.value.scores(x.to_numpy(dtype=float))[:, number])
        return score(F.struct(*self.features))
