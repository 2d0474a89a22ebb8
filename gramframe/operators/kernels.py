"""Kernel matrices as long tables (group..., i_key, j_key, k).

A kernel here is always "rows x landmarks": the landmarks are a balanced subset (at most
``MAX_LANDMARKS`` rows per run, checked when they are collected), i.e. a small fitted model,
and the rows side is any table (the subset itself for the training kernel, the whole test
split for the test kernel). Each row is scored against all landmarks of its run in one
projection, so the rows side is streamed, never shuffled, and no join pairs rows with rows.

Kernel families
  fidelity  |<phi(x)|phi(y)>|^2 for the maps zz / pauli / custom (see functions.recursions)
  rbf       exp(-gamma * ||x - y||^2) on standardised features
  vectors   <u, v>^2 on given unit vectors
Product forms (pauli, custom with 1 repetition, rbf, vectors) are native column expressions
over the landmark terms, which are joined as one array row per run; recursions (custom 2, zz 1/2) run in Arrow batches
(pandas UDF), landmarks broadcast once per executor.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import recursions as rec
from ..functions.columns import r6
from .ranking import bounded_broadcast

MAX_LANDMARKS = 4096   # per run; larger landmark sets are refused (use blocks of runs instead)
MAX_RUNS = 1024
MODEL_BYTES = 256 << 20   # landmark model of all runs that may be sent to every task
NATIVE = {("pauli", 1), ("pauli", 2), ("pauli", 3), ("custom", 1)}


@dataclass
class LandmarkSet:
    keys: list[str]
    positions: list[int]
    values: np.ndarray          # (L, n) angles or features, or (L, d) vectors
    labels: list[int] | None


def collect_landmarks(landmarks: DataFrame, key: str, cols: list[str] | str, pos_col: str,
                      group_col: str | None = None, label_col: str | None = None) -> dict:
    """{group: LandmarkSet} ordered by position. Refuses more than MAX_LANDMARKS per group."""
    vec = isinstance(cols, str)
    sel = ([group_col] if group_col else []) + [key, pos_col] + ([cols] if vec else list(cols)) \
        + ([label_col] if label_col else [])
    bound = MAX_LANDMARKS * (MAX_RUNS if group_col else 1)
    rows = landmarks.select(*sel).limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} landmarks; the landmark side must be a bounded subset")
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[group_col] if group_col else None, []).append(r)
    out = {}
    for g, rs in groups.items():
        if len(rs) > MAX_LANDMARKS:
            raise ValueError(f"run {g}: {len(rs)} landmarks > {MAX_LANDMARKS}")
        rs.sort(key=lambda r: r[pos_col])
        vals = np.array([list(r[cols]) if vec else [r[c] for c in cols] for r in rs], dtype=float)
        out[g] = LandmarkSet([r[key] for r in rs], [int(r[pos_col]) for r in rs], vals,
                             [int(r[label_col]) for r in rs] if label_col else None)
    return out


# ---------------------------------------------------------------- native row terms
def pauli_row_terms(n: int, repetitions: int, prefix: str = "a") -> list[list[Column]]:
    """Bloch vector (x, y, z) per feature as column expressions of the row's angles."""
    a = [F.col(f"{prefix}{q}") for q in range(n)]
    out = []
    for q in range(n):
        theta = a[q] / 2 + ((a[q - 1] + a[q]) / 2 if q > 0 else F.lit(0.0))
        x, y, z = F.lit(1.0), F.lit(0.0), F.lit(0.0)
        for rep in range(repetitions):
            x, y = x * F.cos(a[q]) - y * F.sin(a[q]), x * F.sin(a[q]) + y * F.cos(a[q])
            y, z = y * F.cos(theta) - z * F.sin(theta), y * F.sin(theta) + z * F.cos(theta)
            if rep + 1 < repetitions:
                x, y, z = z, -y, x
        out.append([x, y, z])
    return out


def _checked_bytes(lsets: dict, numbers: int) -> None:
    size = sum(len(ls.keys) for ls in lsets.values()) * (8 * numbers + 64)
    if size > MODEL_BYTES:
        raise ValueError(f"a landmark model of {size} bytes; at most {MODEL_BYTES} are sent to every task")


def _landmark_model(spark, lsets: dict, fields, group_col: str | None) -> DataFrame:
    """The landmark model as data: one row per run with an array of structs (``_model``), joined to the rows by run (a
    single row without runs). ``fields``: list of (name, type, fn(LandmarkSet) -> values per landmark)."""
    _checked_bytes(lsets, sum(1 if t == "double" else len(fn(next(iter(lsets.values())))[0]) for _, t, fn in fields) if lsets else 0)
    names = ", ".join(f"{nm}: {t}" for nm, t, _ in fields)
    schema = f"_group int, _model array<struct<_j: int, j_key: string, j_pos: int, {names}>>"
    table = []
    for g, ls in lsets.items():
        values = [fn(ls) for _, _, fn in fields]
        table.append((g, [(j, str(ls.keys[j]), ls.positions[j], *[v[j] for v in values]) for j in range(len(ls.keys))]))
    model = F.broadcast(spark.createDataFrame(table, schema))   # bytes checked above
    return model.withColumnRenamed("_group", group_col) if group_col else model.drop("_group")


def _with_model(rows: DataFrame, model: DataFrame, group_col: str | None) -> DataFrame:
    """Every row next to its run's model (one row a run)."""
    return rows.join(model, group_col) if group_col else rows.crossJoin(model)


def _native_terms(name: str, repetitions: int, n: int, prefix: str):
    """(row-term columns, landmark struct fields, per-pair kernel expression)."""
    if name == "pauli":
        terms = pauli_row_terms(n, repetitions, prefix)
        pre = [t.alias(f"_p{q}{c}") for q, trio in enumerate(terms) for c, t in zip("xyz", trio)]
        fields = [(f"l{q}{c}", "double", (lambda ls, q=q, i=i: rec.pauli_vectors(ls.values, repetitions)[:, q, i].tolist()))
                  for q in range(n) for i, c in enumerate("xyz")]
        k = F.lit(1.0)
        for q in range(n):
            dot = sum((F.col(f"_p{q}{c}") * F.col(f"l{q}{c}") for c in "xyz"), F.lit(0.0))
            k = k * ((dot + 1.0) * 0.5)
        return pre, fields, k
    if name == "custom" and repetitions == 1:
        a = [F.col(f"{prefix}{q}") for q in range(n)]
        pre = []
        for q in range(n):
            pre += [F.cos(a[q] / 2).alias(f"_c{q}"), F.sin(a[q] / 2).alias(f"_s{q}"),
                    F.cos(a[q] * a[q] / (2 * math.pi)).alias(f"_cp{q}"),
                    F.sin(a[q] * a[q] / (2 * math.pi)).alias(f"_sp{q}")]
        fields = []
        for q in range(n):
            fields += [(f"lc{q}", "double", lambda ls, q=q: np.cos(ls.values[:, q] / 2).tolist()),
                       (f"ls{q}", "double", lambda ls, q=q: np.sin(ls.values[:, q] / 2).tolist()),
                       (f"lcp{q}", "double", lambda ls, q=q: np.cos(ls.values[:, q] ** 2 / (2 * math.pi)).tolist()),
                       (f"lsp{q}", "double", lambda ls, q=q: np.sin(ls.values[:, q] ** 2 / (2 * math.pi)).tolist())]
        k = F.lit(1.0)
        for q in range(n):
            p = F.col(f"_c{q}") * F.col(f"lc{q}")
            s_ = F.col(f"_s{q}") * F.col(f"ls{q}")
            cosd = F.col(f"_cp{q}") * F.col(f"lcp{q}") + F.col(f"_sp{q}") * F.col(f"lsp{q}")
            k = k * (p * p + s_ * s_ + p * s_ * 2.0 * (cosd * cosd * 2.0 - 1.0))
        return pre, fields, k
    raise ValueError(f"no native form for {name} with {repetitions} repetitions")


def _pair_stage(rows: DataFrame, head: list, pre: list, model: DataFrame, k: Column,
                group_col: str | None, symmetric: bool) -> DataFrame:
    """rows -> (group?, i_key, j_key, [i_pos, j_pos], k): explode the joined model, one small expression per pair."""
    staged = _with_model(rows.select(*head, *pre), model, group_col)
    paired = staged.select(*[c for c in staged.columns if c != "_model"], F.inline("_model"))
    if symmetric:
        paired = paired.where(F.col("i_pos") <= F.col("j_pos"))
    cols = ([group_col] if group_col else []) + ["i_key", "j_key"] + (["i_pos", "j_pos"] if symmetric else [])
    return paired.select(*cols, k.alias("k"))


def _long_form(scored: DataFrame, group_col: str | None, lsets: dict, symmetric: bool,
               i_pos: str | None) -> DataFrame:
    """Explode a per-row kernel array into (group, i_key, j_key, k); keys from the joined model."""
    model = _landmark_model(scored.sparkSession, lsets, [("one", "double", lambda ls: [1.0] * len(ls.keys))], group_col)
    base = ([group_col] if group_col else []) + ["i_key"] + (["i_pos"] if i_pos else [])
    # outer form: the arrays are never null or empty, and a non-outer generator makes the
    # optimizer infer a size(_k) > 0 filter that evaluates the Python UDF a second time
    ex = _with_model(scored, model, group_col).select(*base, "_model", F.posexplode_outer("_k").alias("_j", "k"))
    at = F.element_at("_model", F.col("_j") + 1)
    ex = ex.withColumn("j_key", at["j_key"]).withColumn("j_pos", at["j_pos"])
    if symmetric:
        ex = ex.where(F.col("i_pos") <= F.col("j_pos"))
    cols = ([group_col] if group_col else []) + ["i_key", "j_key"] + (["i_pos", "j_pos"] if i_pos else []) + ["k"]
    return ex.select(*cols)


def fidelity_kernel(rows: DataFrame, landmarks: DataFrame, name: str, repetitions: int, n: int,
                    key: str = "row_key", pos_col: str = "position", group_col: str | None = None,
                    symmetric: bool = False, prefix: str = "a", native: bool | None = None) -> DataFrame:
    """Fidelity kernel between encoded rows (angles a0..) and encoded landmarks.

    symmetric=True: rows and landmarks are the same subset, only i_pos <= j_pos is kept.
    """
    rec.check_map(name, repetitions)
    angle_cols = [f"{prefix}{q}" for q in range(n)]
    lsets = collect_landmarks(landmarks, key, angle_cols, pos_col, group_col)
    head = ([group_col] if group_col else []) + [F.col(key).alias("i_key")] \
        + ([F.col(pos_col).alias("i_pos")] if symmetric else [])
    use_native = (name, repetitions) in NATIVE if native is None else native
    if use_native:
        pre, fields, k = _native_terms(name, repetitions, n, prefix)
        return _pair_stage(rows, head, pre, _landmark_model(rows.sparkSession, lsets, fields, group_col), k, group_col, symmetric)
    scored = rows.select(*head, _arrow_rows_x_landmarks(rows, name, repetitions, lsets, group_col, angle_cols).alias("_k"))
    return _long_form(scored, group_col, lsets, symmetric, "i_pos" if symmetric else None)


def _arrow_rows_x_landmarks(rows: DataFrame, name: str, repetitions: int, lsets: dict, group_col: str | None, cols: list[str]) -> Column:
    """pandas UDF: each Arrow batch of rows against its run's landmarks -> array<double>."""
    _checked_bytes(lsets, len(cols))
    bc = rows.sparkSession.sparkContext.broadcast({g: ls.values for g, ls in lsets.items()})

    if group_col is None:
        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def k_single(x: pa.Array) -> pa.Array:
            values = [c.to_numpy(zero_copy_only=False).astype(float) for c in x.flatten()]
            mat = rec.fidelity_matrix(name, repetitions, np.stack(values, axis=1), bc.value[None])
            return pa.ListArray.from_arrays(np.arange(0, mat.size + 1, mat.shape[1], dtype=np.int32), mat.ravel())
        return k_single(F.struct(*cols))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def k_grouped(g: pd.Series, x: pd.DataFrame) -> pd.Series:
        sets = bc.value
        vals = x.to_numpy(dtype=float)
        out = np.empty(len(g), dtype=object)
        for gid in pd.unique(g):
            idx = np.flatnonzero(g.to_numpy() == gid)
            mat = rec.fidelity_matrix(name, repetitions, vals[idx], sets[int(gid)])
            for t, i in enumerate(idx):
                out[i] = mat[t]
        return pd.Series(out)
    return k_grouped(F.col(group_col), F.struct(*cols))


# ---------------------------------------------------------------- rbf and vectors
def gamma_value(train_scaled: DataFrame, features: list[str], gamma, group_col: str | None = None) -> DataFrame:
    """(group?, gamma): 'scale' = 1 / (n_features * var_pop of all matrix cells), 'auto' = 1 / n_features."""
    n = len(features)
    g = [group_col] if group_col else []
    if gamma == "auto":
        return train_scaled.select(*g).distinct().withColumn("gamma", F.lit(1.0 / n)) if g else \
            train_scaled.sparkSession.range(1).select(F.lit(1.0 / n).alias("gamma"))
    if gamma == "scale":
        pairs = ", ".join(f"`{c}`" for c in features)
        cells = train_scaled.selectExpr(*[f"`{c}`" for c in g], f"stack({n}, {pairs}) as (v)")
        return cells.groupBy(*g).agg((F.lit(1.0) / (F.lit(float(n)) * F.var_pop("v"))).alias("gamma"))
    val = float(gamma)
    if g:
        return train_scaled.select(*g).distinct().withColumn("gamma", F.lit(val))
    return train_scaled.sparkSession.range(1).select(F.lit(val).alias("gamma"))


def rbf_kernel(rows: DataFrame, landmarks: DataFrame, features: list[str], gamma: float,
               key: str = "row_key", pos_col: str = "position", symmetric: bool = False) -> DataFrame:
    """exp(-gamma * sum_q (x_q - y_q)^2) against the landmark features (one run)."""
    lsets = collect_landmarks(landmarks, key, features, pos_col)
    fields = [(f"l{q}", "double", lambda ls, q=q: ls.values[:, q].tolist()) for q in range(len(features))]
    pre = [F.col(c).alias(f"_x{q}") for q, c in enumerate(features)]
    d2 = sum(((F.col(f"_x{q}") - F.col(f"l{q}")) * (F.col(f"_x{q}") - F.col(f"l{q}"))
              for q in range(len(features))), F.lit(0.0))
    head = [F.col(key).alias("i_key")] + ([F.col(pos_col).alias("i_pos")] if symmetric else [])
    return _pair_stage(rows, head, pre, _landmark_model(rows.sparkSession, lsets, fields, None),
                       F.exp(d2 * (-float(gamma))), None, symmetric)


def vector_kernel(rows: DataFrame, landmarks: DataFrame, vec_col: str, dim: int,
                  key: str = "row_key", pos_col: str = "position") -> DataFrame:
    """<u, v>^2 for unit vectors: one unrolled native dot product per pair."""
    lsets = collect_landmarks(landmarks, key, vec_col, pos_col)
    if lsets[None].values.shape[1] != dim:
        raise ValueError(f"landmark vectors have length {lsets[None].values.shape[1]}, expected {dim}")
    fields = [("lv", "array<double>", lambda ls: ls.values.tolist())]
    pre = [F.when(F.size(vec_col) == dim, F.col(vec_col))
           .otherwise(F.raise_error(F.lit(f"vector length differs from {dim}"))).alias("_u")]
    dot = sum((F.col("_u").getItem(i) * F.col("lv").getItem(i) for i in range(dim)), F.lit(0.0))
    return _pair_stage(rows, [F.col(key).alias("i_key")], pre, _landmark_model(rows.sparkSession, lsets, fields, None),
                       dot * dot, None, False)


# ---------------------------------------------------------------- matrix helpers
def pair_budget(subset_size: int, eval_rows: Column, shots: int) -> list[Column]:
    """Pairs of a symmetric n x n kernel (n(n+1)/2) plus m x n test pairs, and shots for them."""
    train_pairs = F.lit(subset_size * (subset_size + 1) // 2).cast("long")
    eval_size = F.least(eval_rows, F.lit(subset_size)).cast("long")
    test_pairs = eval_size * subset_size
    return [F.lit(subset_size).alias("subset_size"), eval_size.alias("eval_size"),
            train_pairs.alias("train_pairs"), test_pairs.alias("test_pairs"),
            (train_pairs + test_pairs).alias("circuits"),
            ((train_pairs + test_pairs) * shots).alias("total_shots")]


def rounded(df: DataFrame, value: str = "k") -> DataFrame:
    return df.withColumn(value, r6(value))
