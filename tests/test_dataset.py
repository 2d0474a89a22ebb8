"""A user's own table: contract, quarantine, stable keys; committed outputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gramframe.sources.dataset import Contract, load, rejection_counts
from gramframe.sources.outputs import Outputs, table_digest

CONTRACT = Contract(("a", "b"), "y")


def _csv(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_quarantine_names_every_reason(spark, tmp_path):
    path = _csv(tmp_path / "t.csv", ["a,b,y", "1.5,2,0", " 3 ,,1", "x,2,0", "1,nan,1", "inf,q,2", "1,2,", "1,2,0,9", "4,5,0.5", "1.5,2,0"])
    data = load(spark, path, CONTRACT)
    assert sorted((r.a, r.b, r.y) for r in data.rows.fillna(-1.0, ["b"]).collect()) == [(1.0, -1.0, 1), (1.5, 2.0, 0), (1.5, 2.0, 0), (3.0, -1.0, 1)]
    assert {r.reason: r.n for r in rejection_counts(data).collect()} == {
        "a is not a number": 1, "b is not a number": 1, "a is not finite": 1, "label is not 0 or 1": 2, "label is missing": 1, "line does not match the header": 1}
    assert data.rejected.count() == 5
    with pytest.raises(ValueError, match="expected columns"):
        load(spark, path, Contract(("b", "a"), "y"))


def test_keys_do_not_depend_on_format_or_partitions(spark, tmp_path):
    df = spark.createDataFrame([(float(i % 3), None if i % 4 else 0.25, i % 2) for i in range(60)] + [(9.0, 9.0, 1)] * 40, "a double, b double, y int")
    df.repartition(5).write.option("header", True).csv(str(tmp_path / "c"))
    df.repartition(2).write.parquet(str(tmp_path / "p.parquet"))
    keys = [sorted(r.row_key for r in load(spark, s, CONTRACT).rows.collect()) for s in (str(tmp_path / "c"), str(tmp_path / "p.parquet"), df.coalesce(1))]
    assert keys[0] == keys[1] == keys[2] and len(set(keys[0])) == 100


def test_own_keys_are_checked(spark):
    df = spark.createDataFrame([("k1", 1.0, 2.0, 0), ("k2", 1.0, 2.0, 1), (None, 1.0, 1.0, 1)], "id string, a double, b double, y int")
    data = load(spark, df, Contract(("a", "b"), "y", "id"))
    assert sorted(r.row_key for r in data.rows.collect()) == ["k1", "k2"]
    assert rejection_counts(data).first()["reason"] == "key is missing"
    with pytest.raises(ValueError, match="occurs 2 times"):
        load(spark, df.union(df), Contract(("a", "b"), "y", "id"))
    with pytest.raises(ValueError, match="lacks the columns"):
        load(spark, df, Contract(("a", "zz"), "y"))


def test_outputs_are_committed_after_reading_back(spark, tmp_path):
    out = Outputs(spark, str(tmp_path / "out"), "r1")
    flat = spark.createDataFrame([("a", 0.1 + 0.2, 1), ("b, \"q\"", None, 2), (None, 1e-300, 3)], "n string, v double, i int")
    assert out.manifest().count() == 0
    assert sorted(out.publish(flat, "flat", "csv").collect(), key=str) == sorted(flat.collect(), key=str)
    nested = flat.select(F.struct("n", "v").alias("s"), F.array(F.array("i", "i")).alias("m"))
    assert sorted(out.publish(nested, "nested", "json").collect(), key=str) == sorted(nested.collect(), key=str)
    kernel = spark.createDataFrame([(r, i, i / 7) for r in (0, 1) for i in range(5)], "run_id int, i int, k double")
    out.publish(kernel, "kernel", "parquet", ["run_id"])
    out.publish(kernel.where("run_id = 1").withColumn("k", F.lit(2.0)), "kernel", "parquet", ["run_id"])
    got = {(r.run_id, r.i): r.k for r in out.read("kernel").collect()}
    assert got[0, 3] == 3 / 7 and got[1, 3] == 2.0 and len(got) == 10
    assert {(r.name, r.version, r.rows) for r in out.manifest().collect()} == {("flat", 0, 3), ("nested", 0, 3), ("kernel", 0, 10), ("kernel", 1, 10)}
    assert out.read("flat").count() == 3 and table_digest(out.read("nested")) == table_digest(nested)
    with pytest.raises(FileNotFoundError):
        out.read("absent")
    with pytest.raises(ValueError):
        out.publish(flat, "flat", "xml")


def test_damaged_outputs_are_not_read_or_committed(spark, tmp_path, monkeypatch):
    out = Outputs(spark, str(tmp_path / "out"), "r2")
    df = spark.createDataFrame([(i, float(i)) for i in range(9)], "i int, v double")
    out.publish(df, "t", "parquet")
    path = out.manifest("t").first()["path"]
    df.where("i < 5").write.mode("append").parquet(path)
    with pytest.raises(OSError, match="differs from its manifest"):
        out.read("t")
    read = Outputs._read
    monkeypatch.setattr(Outputs, "_read", lambda self, *a: read(self, *a).where("i <> 3"))
    with pytest.raises(OSError, match="not committed"):
        out.publish(df, "u", "csv")
    assert out.manifest("u").count() == 0


def test_study_on_a_users_table_agrees_across_formats(spark, tmp_path, monkeypatch):
    """The same rows as CSV with damaged lines and as Parquet give the same summary; outputs are committed."""
    from gramframe.plans import study
    from gramframe.plans.study import run_study
    monkeypatch.setattr(study, "C_GRID", [1.0])
    monkeypatch.setattr(study, "GAMMA_GRID", ["scale"])
    from gramframe.sources.config import StudyConfig
    from test_models import planted
    df = planted(spark, 300, 4).withColumn("f3", F.when(F.col("f3") > 0.8, None).otherwise(F.col("f3"))).drop("row_key")
    features = tuple(f"f{q}" for q in range(9))
    renamed = df.select(*[F.col(c).alias(f"col {c}") for c in features], F.col("y").alias("label"))
    contract = Contract(tuple(f"col {c}" for c in features), "label")
    renamed.write.parquet(str(tmp_path / "t.parquet"))
    broken = renamed.limit(3).select(*[F.lit("?").alias(c) if c == "col f1" else F.col(f"`{c}`").cast("string").alias(c) for c in renamed.columns])
    renamed.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in renamed.columns]).unionByName(broken).write.option("header", True).csv(str(tmp_path / "t"))
    out = Outputs(spark, str(tmp_path / "out"), "study")
    cfg = StudyConfig().quick()
    docs = [run_study(spark, str(tmp_path / name), cfg, contract=contract, outputs=o).first().asDict(recursive=True)
            for name, o in (("t", out), ("t.parquet", None))]
    assert docs[0]["data"] == docs[1]["data"] and docs[0]["data"]["rows"] == 300 and docs[0]["data"]["missing_values"]["col f3"] > 0
    assert docs[0]["kernel_diagnostics"] == pytest.approx(docs[1]["kernel_diagnostics"])
    assert docs[0]["comparison_mean"] == docs[1]["comparison_mean"] and len(docs[0]["comparison_mean"]) == 2
    assert {r.name for r in out.manifest().collect()} == {"classical_metrics", "feature_map_results", "model_comparison", "kernel_matrix", "summary", "data_summary"}
    assert out.read("model_comparison").count() == 2 and out.read("kernel_matrix").count() == 136
