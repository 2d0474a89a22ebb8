"""Operators on hand-made tables (FIXTURES.md) and invariants on the given tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramframe.functions.recursions import fidelity_kernel
from gramframe.operators import kernel_stats as ks
from gramframe.operators import kernels, metrics, prep, profile, ranking, sampling
from gramframe.operators.encode import encode_angles, expected_gate_count, gate_counts, map_parameters

SCORED = [(0, .1), (1, .4), (0, .4), (1, .8), (0, .8), (1, .9)]


def scored_df(spark, rows=SCORED):
    return spark.createDataFrame(rows, "y int, score double")


def test_auc_ap_with_ties(spark):
    r = metrics.ranking_metrics(scored_df(spark), "y", "score").first()
    assert r["roc_auc"] == pytest.approx(7 / 9)
    assert r["average_precision"] == pytest.approx((1 + 2 / 3 + 3 / 5) / 3)


def test_auc_symmetry_and_edge_cases(spark):
    neg = spark.createDataFrame([(y, -s) for y, s in SCORED], "y int, score double")
    a = metrics.ranking_metrics(scored_df(spark), "y", "score").first()["roc_auc"]
    b = metrics.ranking_metrics(neg, "y", "score").first()["roc_auc"]
    assert a + b == pytest.approx(1.0)
    one_class = metrics.ranking_metrics(scored_df(spark, [(1, .2), (1, .3)]), "y", "score").first()
    assert one_class["roc_auc"] is None and one_class["average_precision"] is None
    tied = metrics.ranking_metrics(scored_df(spark, [(0, .5), (1, .5), (0, .5), (1, .5)]), "y", "score").first()
    assert tied["roc_auc"] == pytest.approx(0.5)
    assert tied["average_precision"] == pytest.approx(0.5)


def test_threshold_metrics_zero_denominators(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (1, 1)], "y int, pred int")
    m = metrics.threshold_metrics(df).first()
    assert m["specificity"] == 0.0 and m["false_positive_rate"] == 0.0
    assert m["balanced_accuracy"] == pytest.approx(1 / 3)   # only class 1 present
    assert m["precision"] == 1.0 and m["f1"] == pytest.approx(0.5)
    none_pred = spark.createDataFrame([(1, 0), (0, 0)], "y int, pred int")
    m = metrics.threshold_metrics(none_pred).first()
    assert m["precision"] == 0.0 and m["f1"] == 0.0 and m["balanced_accuracy"] == pytest.approx(0.5)


def test_median_and_scaler_nulls(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (0, 4.0), (0, None), (1, 8.0)], "y int, x double")
    small = prep.fit_preprocessor(df, ["x"], rows_per_group=10).stats.first()
    big = prep.fit_preprocessor(df, ["x"]).stats.first()
    for row in (small, big):
        assert row["med_x"] == 3.0
        vals = np.array([1, 2, 4, 3, 8.0])
        assert row["mu_x"] == pytest.approx(vals.mean())
        assert row["sd_x"] == pytest.approx(vals.std())
    assert df.agg(F.stddev_pop("x")).first()[0] == pytest.approx(2.680951, abs=1e-6)


def test_constant_column_sd_one(spark):
    df = spark.createDataFrame([(0, 5.0), (1, 5.0), (1, None)], "y int, x double")
    s = prep.fit_preprocessor(df, ["x"], rows_per_group=10).stats.first()
    assert s["sd_x"] == 1.0
    out = prep.fit_preprocessor(df, ["x"], rows_per_group=10).transform(df).select("x").collect()
    assert all(r["x"] == 0.0 for r in out)


def test_duplicates_missing_equals_missing(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None), (2.0, 3.0), (2.0, 3.0), (4.0, 5.0)], "a double, b double")
    assert profile.duplicate_rows(df, ["a", "b"]).first()["duplicates"] == 2


def test_label_contract(spark):
    bad = spark.createDataFrame([(0,), (2,)], "y int")
    with pytest.raises(ValueError):
        profile.validate_labels(bad)
    one = spark.createDataFrame([(1,), (1,)], "y int")
    with pytest.raises(ValueError):
        profile.validate_labels(one)
    with pytest.raises(ValueError):
        profile.validate_columns(bad, ["x", "y"])


def _table(spark, n0, n1):
    rows = [(f"k{i}", 0) for i in range(n0)] + [(f"m{i}", 1) for i in range(n1)]
    return spark.createDataFrame(rows, "row_key string, y int")


def test_hash_rank_exact_and_partition_independent(spark):
    df = _table(spark, 700, 300).withColumn("h", F.md5("row_key"))
    expect = df.selectExpr("row_key", "row_number() over (partition by y order by h, row_key) as r")
    got = ranking.hash_rank(df, ["y"], "h", "row_key", max_groups=2).select("row_key", F.col("rank").alias("r"))
    assert sorted(expect.collect()) == sorted(got.collect())
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got1 = ranking.hash_rank(df, ["y"], "h", "row_key", max_groups=2).select("row_key", F.col("rank").alias("r"))
        assert sorted(got1.collect()) == sorted(expect.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_stratified_split_counts(spark):
    df = _table(spark, 2184, 1092)          # 3276 rows like the reference data
    s = sampling.stratified_split(df, "y", "row_key", 7, 0.2)
    counts = {(r["y"], r["split"]): r["count"] for r in s.groupBy("y", "split").count().collect()}
    assert counts[(0, "test")] + counts[(1, "test")] == math.ceil(0.2 * 3276)
    assert counts[(0, "train")] + counts[(1, "train")] == 3276 - 656
    assert s.count() == 3276 and s.select("row_key").distinct().count() == 3276
    # largest remainder on the train share: 2620 * 2/3 = 1746.67 -> 1747, 873.33 -> 873
    assert counts[(0, "train")] == 1747 and counts[(1, "train")] == 873


def test_balanced_subset_rules(spark):
    df = _table(spark, 40, 10)
    sub = sampling.balanced_subset(df, "y", "row_key", 16, 3)
    assert {r["y"]: r["count"] for r in sub.groupBy("y").count().collect()} == {0: 8, 1: 8}
    assert sorted(r["position"] for r in sub.collect()) == list(range(16))
    with pytest.raises(ValueError):
        sampling.balanced_subset(df, "y", "row_key", 15, 3)
    with pytest.raises(ValueError):
        sampling.balanced_subset(df, "y", "row_key", 24, 3)


def test_folds_and_undersample(spark):
    df = _table(spark, 23, 12)
    f = sampling.stratified_folds(df, "y", "row_key", 5, 5)
    per = {(r["y"], r["fold"]): r["count"] for r in f.groupBy("y", "fold").count().collect()}
    # sorted labels dealt round robin: class 0 positions 0..22, class 1 positions 23..34
    for y, off, n in ((0, 0, 23), (1, 23, 12)):
        for k in range(5):
            assert per.get((y, k), 0) == sum(1 for p in range(off, off + n) if p % 5 == k)
    u = sampling.undersample(df, "y", "row_key", 1)
    assert {r["y"]: r["count"] for r in u.groupBy("y").count().collect()} == {0: 12, 1: 12}
    with pytest.raises(ValueError):
        sampling.check_folds({0: 4, 1: 4}, 5)


def test_native_kernels_match_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 4))
    rows = [(f"r{i}", i, *map(float, x[i])) for i in range(12)]
    df = spark.createDataFrame(rows, "row_key string, position int, f0 double, f1 double, f2 double, f3 double")
    enc = encode_angles(df, ["f0", "f1", "f2", "f3"])
    ang = np.clip(x, -3, 3) / 3 * np.pi
    for name, reps in (("pauli", 2), ("custom", 1), ("custom", 2), ("zz", 1), ("zz", 2)):
        k = kernels.fidelity_kernel(enc, enc, name, reps, 4)
        got = {(r["i_key"], r["j_key"]): r["k"] for r in k.collect()}
        ref = fidelity_kernel(name, reps)(ang[:, None, :], ang[None, :, :])
        for i in range(12):
            for j in range(12):
                assert got[(f"r{i}", f"r{j}")] == pytest.approx(ref[i, j], abs=1e-12)
        sym = kernels.fidelity_kernel(enc, enc, name, reps, 4, symmetric=True)
        assert sym.count() == 12 * 13 // 2


def test_gate_table_counts(spark):
    df = spark.createDataFrame([("a", 0.1, 0.2, 0.3), ("b", 1.0, -1.0, 0.5)], "row_key string, a0 double, a1 double, a2 double")
    for name in ("zz", "pauli", "custom"):
        t = map_parameters(df, "row_key", name, 2, 3)
        assert t.count() == 2 * expected_gate_count(name, 2, 3)
        g = gate_counts(t).agg(F.sum("gates_per_row")).first()[0]
        assert g == expected_gate_count(name, 2, 3)


def test_outcome_probability_rules(spark):
    counts = spark.createDataFrame([(0, 0, "view", 3), (0, 0, "click", 1), (0, 1, "click", 2)],
                                   "i int, j int, outcome string, n long")
    p = {(r["i"], r["j"]): r["p"] for r in ks.outcome_probability(counts, "view").collect()}
    assert p == {(0, 0): 0.75, (0, 1): 0.0}
    zero = spark.createDataFrame([(1, 1, "view", 0)], "i int, j int, outcome string, n long")
    with pytest.raises(Exception):
        ks.outcome_probability(zero, "view").collect()
    m = ks.mirror_upper(ks.outcome_probability(counts, "view"))
    got = {(r["i"], r["j"]): (r["k"], r["present"]) for r in m.collect()}
    assert got[(1, 0)] == (0.0, True) and got[(1, 1)] == (0.0, False) and got[(0, 0)] == (0.75, True)


def test_kernel3_diagnostics(spark):
    # 3 x 3 kernel, labels (0, 0, 1): class 1 has one member
    K = np.array([[1.0, 0.8, 0.1], [0.8, 1.0, 0.3], [0.1, 0.3, 1.0]])
    labels = [0, 0, 1]
    keys = ["a", "b", "c"]
    upper = [(keys[i], keys[j], float(K[i, j])) for i in range(3) for j in range(i, 3)]
    kdf = spark.createDataFrame(upper, "i_key string, j_key string, k double")
    lab = spark.createDataFrame([(k, y, p) for p, (k, y) in enumerate(zip(keys, labels))],
                                "row_key string, y int, position int")
    d = ks.kernel_diagnostics(ks.attach_labels(kdf, lab)).first()
    assert d["within_class_mean"] == pytest.approx(0.8)
    assert d["between_class_mean"] == pytest.approx((0.1 + 0.3) / 2)
    T = np.where(np.equal.outer(labels, labels), 1.0, -1.0)
    assert d["kernel_target_alignment"] == pytest.approx((K * T).sum() / (np.linalg.norm(K) * 3))
    sp = ks.kernel_spectrum(kdf).first()
    ev = np.linalg.eigvalsh(K)
    assert sp["min_eigenvalue"] == pytest.approx(ev.min())
    w = ev / ev.sum()
    assert sp["effective_rank"] == pytest.approx(math.exp(-(w * np.log(w)).sum()))
    pr = ks.kernel_participation(kdf).first()
    assert pr["participation_ratio"] == pytest.approx(np.trace(K) ** 2 / (K * K).sum())
    full = spark.createDataFrame([(keys[i], keys[j], float(K[i, j])) for i in range(3) for j in range(3)],
                                 "i_key string, j_key string, k double")
    ro = ks.reorder_by_class(full, lab).collect()
    assert {r["boundary"] for r in ro} == {2}


def test_csv_contract(spark, tmp_path):
    from gramframe.sources.csv_io import read_feature_csv
    good = tmp_path / "good.csv"
    good.write_text("a,b,y\n1.0,,0\n2.0,3.0,1\n")
    df = read_feature_csv(spark, str(good), ["a", "b"], "y")
    assert df.count() == 2 and df.where(F.col("b").isNull()).count() == 1
    swapped = tmp_path / "swapped.csv"
    swapped.write_text("b,a,y\n1.0,2.0,0\n2.0,3.0,1\n")
    with pytest.raises(Exception):
        read_feature_csv(spark, str(swapped), ["a", "b"], "y").collect()


def test_stream_scoring_matches_batch(spark, tmp_path):
    from gramframe.streaming.scoring import score_stream
    rng = np.random.default_rng(5)
    rows = [(f"r{i}", int(i % 2), i, *map(float, rng.normal(size=3))) for i in range(40)]
    schema = "row_key string, y int, position int, f0 double, f1 double, f2 double"
    df = spark.createDataFrame(rows, schema)
    feats = ["f0", "f1", "f2"]
    pre = prep.fit_preprocessor(df, feats, rows_per_group=40)
    lm = ks.class_mean_coefficients(encode_angles(pre.transform(df.where("position < 10")), feats), "y")
    path = str(tmp_path / "in")
    df.write.parquet(path)
    stream = spark.readStream.schema(schema).parquet(path)
    q = (score_stream(stream, pre, lm, "pauli", 2, feats).writeStream.format("memory")
         .queryName("scored_stream").outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    got = {r["row_key"]: r["score"] for r in spark.sql("select * from scored_stream").collect()}
    batch = score_stream(df, pre, lm, "pauli", 2, feats)
    for r in batch.collect():
        assert got[r["row_key"]] == pytest.approx(r["score"], abs=1e-12)


def test_skewed_class_and_hot_score(spark):
    """One class holds 90% of the rows and one score a third of them: ranks, split and AUC stay exact."""
    rows = [(f"k{i}", 0 if i % 10 else 1, 0.5 if i % 3 == 0 else (i % 97) / 97.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "row_key string, y int, score double")
    s = sampling.stratified_split(df, "y", "row_key", 9, 0.2)
    c = {(r["y"], r["split"]): r["count"] for r in s.groupBy("y", "split").count().collect()}
    assert c[(0, "test")] + c[(1, "test")] == 600 and c[(1, "test")] == 60
    r = metrics.ranking_metrics(df, "y", "score").first()
    y = np.array([t[1] for t in rows])
    sc = np.array([t[2] for t in rows])
    pos, neg = sc[y == 1], sc[y == 0]
    auc = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert r["roc_auc"] == pytest.approx(auc)


def test_all_missing_feature_is_an_error(spark):
    df = spark.createDataFrame([(0, None, 1.0), (1, None, 2.0)], "y int, x double, z double")
    with pytest.raises(ValueError):
        prep.fit_preprocessor(df, ["x", "z"], rows_per_group=10).transform(df)


def test_label_domain_compares_uncast(spark):
    from gramframe.operators.profile import label_domain
    for bad in ([0.0, 1.5], [0.4, 1.0], [0.0, 2.0], [1.0]):
        assert not label_domain(spark.createDataFrame([(x,) for x in bad], "y double")).first()["valid"]
    assert label_domain(spark.createDataFrame([(0.0,), (1.0,), (None,)], "y double")).first()["valid"]


def test_grouped_fit_rejects_a_feature_missing_in_a_group(spark):
    import pytest
    from gramframe.operators.prep import fit_preprocessor
    df = spark.createDataFrame([(0, 1.0, 2.0), (0, 2.0, 3.0), (1, None, 1.0), (1, None, 4.0)], "g int, a double, b double")
    for bound in (10, None):
        fitted = fit_preprocessor(df, ["a", "b"], ["g"], max_groups=2, rows_per_group=bound)
        with pytest.raises(Exception, match="no observed value"):
            fitted.transform(df).collect()


def test_mirror_rejects_lower_cells_and_folds_counts(spark):
    import pytest
    from gramframe.operators import kernel_stats as ks
    counts = spark.createDataFrame([(1, 0, "view", 3), (0, 1, "click", 1)], "i int, j int, outcome string, n long")
    with pytest.raises(Exception, match="below the diagonal"):
        ks.mirror_upper(ks.outcome_probability(counts, "view")).collect()
    full = {(r.i, r.j): r.k for r in ks.mirror_upper(ks.outcome_probability(ks.fold_cells(counts), "view")).collect()}
    assert full[0, 1] == full[1, 0] == 0.75


def test_run_grid_rows_are_filtered_before_runs_are_named(spark):
    """The array expression over the runs is not compiled by Spark: it may see the few rows that some run hits only."""
    from gramframe.operators import sampling
    runs = sampling.comparison_runs([4, 8], 3, 5)
    bounds = [("2", "4")] * len(runs)
    rows = spark.createDataFrame([(f"k{i}", i % 2) for i in range(400)] + [(None, 0), (None, 1)], "row_key string, y int")
    h = {r.run_id: sampling.order_hash(r.seed, "subset", "row_key") for r in runs}
    flagged = rows.select("row_key", "y", sampling._hit_by_any(runs, bounds, "y", "row_key").alias("some"), *[c.alias(f"h{i}") for i, c in h.items()]).collect()
    for r in flagged:
        assert r["some"] == any(r[f"h{i}"] < ("4" if r["y"] == 1 else "2") for i in h)
    assert 0 < sum(r["some"] for r in flagged) < len(flagged)
    many = [sampling.Run(i, 4, i) for i in range(sampling.MAX_FILTER_RUNS + 1)]
    out = sampling.balanced_subsets(rows.where("row_key is not null"), "y", "row_key", many)
    few = sampling.balanced_subsets(rows.where("row_key is not null"), "y", "row_key", many[:6])
    key = lambda r: (r["run_id"], r["position"], r["row_key"], r["y"])
    assert sorted(map(key, out.where("run_id < 6").collect())) == sorted(map(key, few.collect()))
