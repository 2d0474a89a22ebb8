"""Selection by histograms against sorting."""

from __future__ import annotations

import hashlib
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F


def _hashed(spark, rows):
    df = spark.createDataFrame(rows, "g string, y int, key string").repartition(5)
    return df.withColumn("h", F.md5("key"))


@pytest.mark.parametrize("finish", [1, 7, 4096])
def test_hash_cuts_take_the_first_k_rows(spark, monkeypatch, finish):
    from gramframe.operators import selection as s
    monkeypatch.setattr(s, "FINISH", finish)
    rows = [(g, y, f"{g}{y}-{i}") for g, y, n in (("a", 0, 300), ("a", 1, 5), (None, 0, 40), ("b", 1, 1), ("c", 0, 9)) for i in range(n)]
    want = {("a", 0): 123, ("a", 1): 5, (None, 0): 1, ("b", 1): 0, ("c", 0): 8}
    quota = spark.createDataFrame([(g, y, k) for (g, y), k in want.items()], "g string, y int, k int")
    df = _hashed(spark, rows)
    cuts = s.hash_cuts(df, ["g", "y"], "h", "key", lambda sizes: quota)
    assert {(c["g"], c["y"]) for c in cuts} == {k for k, v in want.items() if v}
    by_hash = lambda r: hashlib.md5(r[2].encode()).hexdigest()
    expected = {r[2] for (g, y), k in want.items() for r in sorted((x for x in rows if x[:2] == (g, y)), key=by_hash)[:k]}
    for limit in (64, 2):  # cuts in the plan, cuts in a joined table
        monkeypatch.setattr(s, "MAX_LITERAL_GROUPS", limit)
        flagged = s.up_to_cut(df, cuts, ["g", "y"], "h", "key", "first")
        assert {r.key for r in flagged.where("first").collect()} == expected
        assert flagged.count() == len(rows)


def test_hash_cuts_refuse_repeated_keys(spark, monkeypatch):
    from gramframe.operators import selection as s
    df = _hashed(spark, [("a", 0, "same")] * 10)
    half = lambda sizes: sizes.select("g", "y", F.lit(5).alias("k"))
    with pytest.raises(ValueError, match="not unique"):
        s.hash_cuts(df, ["g", "y"], "h", "key", half)
    monkeypatch.setattr(s, "FINISH", 3)
    with pytest.raises(ValueError, match="not unique"):
        s.hash_cuts(df, ["g", "y"], "h", "key", half)


def test_split_plan_has_no_window_and_no_shuffle_of_rows(spark):
    from gramframe.operators.sampling import stratified_split, undersample
    df = spark.range(2000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    for out in (stratified_split(df, "y", "key", 3, 0.2), undersample(df, "y", "key", 3)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Exchange" not in plan
    assert stratified_split(df, "y", "key", 3, 0.2).where("split = 'test'").count() == 400
    assert [r["count"] for r in undersample(df, "y", "key", 3).groupBy("y").count().collect()] == [286, 286]


def _median(values):
    return statistics.median(values)


def test_radix_medians(spark):
    from gramframe.operators.selection import radix_medians
    rng = np.random.default_rng(2)
    cols = {
        "normal": rng.standard_normal(501).tolist(), "wide": [math.copysign(10.0 ** e, s) for e, s in zip(rng.uniform(-300, 300, 501), rng.uniform(-1, 1, 501))],
        "tied": rng.integers(0, 4, 501).astype(float).tolist(), "zeros": [-0.0, 0.0, 1.0] * 167,
        "near": [1.0 + k * 2.0 ** -52 for k in range(501)], "sparse": [float(i) if i % 5 == 0 else None for i in range(501)],
        "none": [None] * 501, "infinite": [float("inf")] * 400 + [1.0] * 101,
    }
    names = list(cols)
    rows = [(("x", None, "y")[i % 3] if i < 500 else "z", *[cols[c][i] for c in names]) for i in range(501)]
    df = spark.createDataFrame(rows, "g string, " + ", ".join(f"{c} double" for c in names)).repartition(4)
    want = {}
    for group in ("x", None, "y", "z"):
        for at, c in enumerate(names):
            own = [r[1 + at] for r in rows if r[0] == group and r[1 + at] is not None]
            if own:
                want[group, c] = _median(own)
    assert {(r[0], r[1]): r[2] for r in radix_medians(df, names, ["g"])} == want
    whole = {r[0]: r[1] for r in radix_medians(df, names, [])}
    assert whole == {c: _median([x for x in cols[c] if x is not None]) for c in names if c != "none"}
    assert radix_medians(df.where("false"), names, ["g"]) == [] and radix_medians(df.where("false"), names, []) == []


def test_run_grid_reads_rows_once_and_widens_its_bound(spark, monkeypatch):
    from gramframe.operators import sampling
    rows = [(f"k{i}", int(i % 9 == 0)) for i in range(900)]
    df = spark.createDataFrame(rows, "key string, y int").repartition(4)
    runs = sampling.comparison_runs([8, 40], 3, 5)
    expected = {}
    for r in runs:
        for y in (0, 1):
            own = sorted((hashlib.md5(f"{r.seed}~subset~{k}".encode()).hexdigest(), k) for k, c in rows if c == y)
            expected[r.run_id, y] = {k for _, k in own[:r.size // 2]}
    for first in (sampling.CANDIDATES, 0.01):  # the second misses rows and must widen
        monkeypatch.setattr(sampling, "CANDIDATES", first)
        got = sampling.balanced_subsets(df, "y", "key", runs).collect()
        found = {}
        for r in got:
            found.setdefault((r.run_id, r.y), set()).add(r.key)
        assert found == expected
        for run in runs:
            assert sorted(r.position for r in got if r.run_id == run.run_id) == list(range(run.size))


def test_duplicates_of_long_texts(spark):
    from gramframe.operators.profile import duplicate_rows
    rows = [("x" * 100_000, 1), ("x" * 100_000, 1), ("x" * 99_999, 1), (None, 1), (None, 1), ("", 1), ("", 2), ("x" * 100_000, None)]
    df = spark.createDataFrame(rows, "`a text` string, b int")
    out = duplicate_rows(df, ["a text", "b"])
    assert tuple(out.first()) == (2, 6)
    plan = out._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert keys and all("a text" in line for line in keys) and "sha2" in plan


def test_balanced_subset_ranks_few_rows(spark, monkeypatch):
    """The window sees the rows below the bound only, and picks what ranking all rows picks; a bound that is too low is widened."""
    from gramframe.operators import sampling
    df = spark.range(20_000).selectExpr("concat('k', id) as row_key", "if(id % 50 = 0, 1, 0) as y").cache()
    ranked = []
    plain = sampling.first_k_by_hash
    monkeypatch.setattr(sampling, "first_k_by_hash", lambda hits, *a, **k: ranked.append(hits.count()) or plain(hits, *a, **k))
    got = {tuple(r) for r in sampling.balanced_subset(df, "y", "row_key", 16, 5).select("row_key", "y").collect()}
    assert ranked[0] < 1000
    monkeypatch.setattr(sampling, "_hash_bound", lambda factor, half, n: "0001" if factor == sampling.CANDIDATES else "g")
    again = {tuple(r) for r in sampling.balanced_subset(df, "y", "row_key", 16, 5).select("row_key", "y").collect()}
    from gramframe.functions.columns import order_hash
    rows = df.select("row_key", "y", order_hash(5, "subset", "row_key").alias("h")).collect()
    want = {(r["row_key"], y) for y in (0, 1) for r in sorted((r for r in rows if r["y"] == y), key=lambda r: r["h"])[:8]}
    assert got == want == again


def test_six_decimals_are_spark_rounding(spark):
    from gramframe.functions.columns import r6
    from pyspark.sql import functions as F
    values = [0.0, -0.0, 5e-7, -5e-7, 2.5e-6, 0.1234565, 1234.5678905, -7.0000005, 1e15 / 7, 1e300, float("inf"), float("nan"), None, 999999.9999995] + [i / 7e6 for i in range(-50, 50)]
    df = spark.createDataFrame([(v,) for v in values], "x double").withColumn("got", r6("x")).withColumn("want", F.round("x", 6) + 0.0)
    assert df.where("not (got <=> want)").count() == 0
    plan = df.select("got")._jdf.queryExecution().toString()
    assert "rint" in plan.lower()   # most values never become decimals
