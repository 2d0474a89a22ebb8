"""Feature-table views over the given tables.

The studied method takes one table of numeric features plus a binary target. These views
derive such tables from the given parquet files, so every job grows with them:

W  lineitem ⋈ orders ⋈ customer ⋈ part ⋈ supplier, nine features, target = returned line
D  labels ⋈ documents, nine text-shape features, target = quality (imbalanced)
E  embeddings, unit vectors of length 64, target = label % 2
C  events, outcome counts per (i, j) cell
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import read_table

FEATURES = [f"f{q}" for q in range(9)]
TARGET = "y"
KEY = "row_key"


def fixture_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_key, f0..f8, y). Inner joins keep every lineitem row."""
    li = read_table(spark, sf_dir, "lineitem", [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate"])
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_totalprice"])
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal"])
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_retailprice", "p_size"])
    supp = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_acctbal"])

    # orders meet their customers before the lines; the lines move by order last, where the window finds them
    orders = orders.join(cust, orders.o_custkey == cust.c_custkey)
    joined = (
        li.join(part, li.l_partkey == part.p_partkey)
        .join(supp, li.l_suppkey == supp.s_suppkey)
        .join(orders, li.l_orderkey == orders.o_orderkey)
    )
    line_key = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    dup = Window.partitionBy(*line_key).orderBy(
        "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate")
    return joined.select(
        F.concat_ws("~", *[F.col(c).cast("string") for c in line_key],
                    F.row_number().over(dup).cast("string")).alias(KEY),
        F.col("l_quantity").cast("double").alias("f0"),
        F.col("l_extendedprice").cast("double").alias("f1"),
        F.nullif(F.col("l_discount"), F.lit(0.0)).cast("double").alias("f2"),
        F.nullif(F.col("l_tax"), F.lit(0.0)).cast("double").alias("f3"),
        F.col("o_totalprice").cast("double").alias("f4"),
        F.col("p_retailprice").cast("double").alias("f5"),
        F.col("p_size").cast("double").alias("f6"),
        F.col("s_acctbal").cast("double").alias("f7"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).cast("double").alias("f8"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).cast("int").alias(TARGET),
    )


def _char_count(text, pattern: str):
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def fixture_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_key, f0..f8, y) from whole document texts; y = quality."""
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "quality"])
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "n_chars"])
    t = F.col("text")
    n = F.nullif(F.length(t), F.lit(0)).cast("double")
    spaces = _char_count(t, " ")
    lines = _char_count(t, "\n")
    digits = _char_count(t, "[0-9]")
    upper = _char_count(t, "[A-Z]")
    lower = _char_count(t, "[a-z]")
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").cast("string").alias(KEY),
        F.col("n_chars").cast("double").alias("f0"),
        (spaces + 1).cast("double").alias("f1"),
        ((F.length(t) - spaces) / (spaces + 1)).cast("double").alias("f2"),
        (F.nullif(digits, F.lit(0)) / n).alias("f3"),
        (upper / n).alias("f4"),
        F.nullif(lines, F.lit(0)).cast("double").alias("f5"),
        ((F.length(t) - spaces - upper - lower) / n).alias("f6"),
        (lower / n).alias("f7"),
        F.nullif(digits, F.lit(0)).cast("double").alias("f8"),
        F.col("quality").cast("int").alias(TARGET),
    )


def fixture_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_key, vec array<double>, label, y = label % 2)."""
    emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    return emb.select(
        F.col("vec_id").cast("string").alias(KEY),
        F.col("embedding").cast("array<double>").alias("vec"),
        F.col("label").cast("int").alias("label"),
        F.pmod(F.col("label"), F.lit(2)).cast("int").alias(TARGET),
    )


def fixture_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, outcome, n): outcome counts per cell; the zero outcome is 'view'."""
    ev = read_table(spark, sf_dir, "events", ["user_id", "event_type"])
    return (
        ev.select(
            F.pmod(F.col("user_id"), F.lit(16)).cast("int").alias("i"),
            F.pmod(F.expr("user_id div 16"), F.lit(16)).cast("int").alias("j"),
            F.col("event_type").alias("outcome"),
        )
        .groupBy("i", "j", "outcome")
        .agg(F.count(F.lit(1)).alias("n"))
    )


ZERO_OUTCOME = "view"
