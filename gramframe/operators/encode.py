"""Angle encoding (P4), the feature-map gate table (P5) and gate counts.

The gate table replaces circuit construction: one row per gate of each row's feature map,
in order, with its angle in radians (NULL for H and CX). A map is a short table of layers; the
rows come from array functions over it and one ``posexplode``, so no shuffle is needed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip_angle

PI = math.pi


def angle_columns(n: int, prefix: str = "a") -> list[str]:
    return [f"{prefix}{q}" for q in range(n)]


def encode_angles(df: DataFrame, features: list[str], prefix: str = "a", keep: bool = False) -> DataFrame:
    """Add a_q = clip(x_q, -3, 3) / 3 * pi for each feature (features dropped unless keep)."""
    others = [c for c in df.columns if keep or c not in features]
    return df.select(*others, *[clip_angle(c).alias(f"{prefix}{q}") for q, c in enumerate(features)])


# What one repetition of each map applies. A layer is (units, operations); units are
# single features or neighbouring pairs, an operation is (gate, angle rule).
LAYERS = {
    "zz": [("feature", [("Rz", "own")]), ("pair", [("CX", None), ("Rz", "product"), ("CX", None)])],
    "pauli": [("feature", [("Rz", "own"), ("Rx", "half")]), ("pair", [("CX", None), ("Rx", "pair mean"), ("CX", None)])],
    "custom": [("feature", [("Ry", "own"), ("Rz", "square")]), ("pair", [("CX", None)])],
}
HADAMARD_MAPS = ("zz", "pauli")   # these put an H layer in front of every repetition

ANGLE_RULES = {
    "own": lambda x, y: x,
    "half": lambda x, y: x / 2,
    "square": lambda x, y: x * x / PI,
    "product": lambda x, y: x * y / PI,
    "pair mean": lambda x, y: (x + y) / 2,
}
GATE_TYPE = "array<struct<repetition:int,gate:string,qubit:int,control:int,angle:double>>"


def _check_map_name(name: str) -> None:
    if name not in LAYERS:
        raise ValueError(f"unknown feature map {name!r}")


def _layer(angles: Column, repetition: Column, units: str, operations: list, n: int) -> Column:
    """The gates of one layer: an array over its units, operations of a unit next to each other."""
    count, ahead = (n - 1, 1) if units == "pair" else (n, 0)
    if count < 1:
        return F.array().cast(GATE_TYPE)

    def gates(unit: Column) -> Column:
        here, following = F.get(angles, unit), F.get(angles, unit + 1)
        return F.array(*[
            F.struct(repetition.alias("repetition"), F.lit(gate).alias("gate"), (unit + ahead).alias("qubit"),
                     (unit if gate == "CX" else F.lit(None).cast("int")).alias("control"),
                     (ANGLE_RULES[rule](here, following) if rule else F.lit(None).cast("double")).alias("angle"))
            for gate, rule in operations]).cast(GATE_TYPE)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), gates))


def map_parameters(encoded: DataFrame, key: str, name: str, repetitions: int, n: int,
                   prefix: str = "a") -> DataFrame:
    """(key, feature_map, step, repetition, gate, qubit, control, angle): one row per gate.

    Repetition r's layers, then the H layer in front of repetition r + 1; repetition 0 holds only
    the opening H layer."""
    _check_map_name(name)
    angles = F.array(*angle_columns(n, prefix))
    nothing = F.array().cast(GATE_TYPE)

    def repetition_gates(r: Column) -> Column:
        body = F.concat(*[_layer(angles, r, units, ops, n) for units, ops in LAYERS[name]])
        front = _layer(angles, r, "feature", [("H", None)], n) if name in HADAMARD_MAPS else nothing
        return F.concat(F.when(r > 0, body).otherwise(nothing), F.when(r < repetitions, front).otherwise(nothing))

    gates = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(repetitions)), repetition_gates))
    return encoded.select(key, F.posexplode(gates).alias("step", "g")).select(
        key, F.lit(name).alias("feature_map"), F.col("step").cast("int"), "g.*")


def expected_gate_count(name: str, repetitions: int, n: int) -> int:
    """Closed-form gate count of a map (used to check the table)."""
    _check_map_name(name)
    sizes = {"feature": n, "pair": n - 1}
    per_repetition = sum(sizes[units] * len(ops) for units, ops in LAYERS[name])
    return repetitions * (per_repetition + (n if name in HADAMARD_MAPS else 0))


def gate_counts(params: DataFrame) -> DataFrame:
    """(feature_map, gate, gates, rows, gates_per_row) over a gate table.

    Each encoded row has exactly one gate at step 0, so rows = count of step-0 gates: one
    aggregation, no distinct count over keys.
    """
    from pyspark.sql import Window

    per_gate = params.groupBy("feature_map", "gate").agg(
        F.count(F.lit(1)).alias("gates"), F.count_if(F.col("step") == 0).alias("_first"))
    rows = F.sum("_first").over(Window.partitionBy("feature_map"))
    return per_gate.select("feature_map", "gate", "gates", rows.alias("rows")) \
        .withColumn("gates_per_row", (F.col("gates") / F.col("rows")).cast("long"))
