"""Registered queries of the training-data operators: each applies one operator, with production
parameters, to its whole table and derives the contract's columns from the operator's rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package
from ..sources.tables import read_table
from . import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query (and its DuckDB form); the package is shipped to the Python workers first."""
    def register(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", ["doc_id", "text"])


@query("op1_posting_lists")
def op1(spark, sf_dir):
    from .posting_lists import nearest
    return nearest(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]))


@query("op2_minhash_near_dup")
def op2(spark, sf_dir):
    from .near_dup import near_duplicates
    return near_duplicates(documents(spark, sf_dir), shingle=4)


@query("op3_suffix_array_dedup")
def op3(spark, sf_dir):
    from .suffix_dedup import remove_repeated_bytes
    return remove_repeated_bytes(documents(spark, sf_dir)).drop("spans")


@query("op4_toxicity")
def op4(spark, sf_dir):
    from .toxicity import score
    return score(documents(spark, sf_dir), read_table(spark, sf_dir, "labels", ["doc_id", "toxic"]))


@query("op5_line_dedup", oracle.OP5)
def op5(spark, sf_dir):
    from pyspark.sql import functions as F

    from .line_dedup import delete_repeated_runs
    out = delete_repeated_runs(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_deleted", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op6_quality_rules", oracle.OP6)
def op6(spark, sf_dir):
    from .quality_rules import quality
    return quality(documents(spark, sf_dir)).drop("text", "cleaned_text")


@query("op7_bpe")
def op7(spark, sf_dir):
    from .bpe import encode
    return encode(documents(spark, sf_dir))


@query("op8_mix_sources", oracle.OP8)
def op8(spark, sf_dir):
    from .mixing import mix
    return mix(read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"])).drop("text")


@query("op9_automaton_dedup")
def op9(spark, sf_dir):
    from .automaton_dedup import remove_repeated_words
    return remove_repeated_words(documents(spark, sf_dir))


@query("op10_ppm_score")
def op10(spark, sf_dir):
    from .ppm_scoring import score
    return score(documents(spark, sf_dir))


@query("op11_simhash_near_dup")
def op11(spark, sf_dir):
    from .simhash_dup import near_duplicates
    return near_duplicates(documents(spark, sf_dir), shingle=3)


@query("op12_importance_resampling", oracle.OP12)
def op12(spark, sf_dir):
    from .resampling import resample
    return resample(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark", ["item_id", "text"]))


@query("op13_qdwh_whitening")
def op13(spark, sf_dir):
    from .whitening import whiten
    return whiten(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]))
