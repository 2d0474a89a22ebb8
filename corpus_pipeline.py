"""Corpus pipeline: five stages over ``documents``, each one of the operators in ``gramframe.llm``.

Every stage reads what its predecessor kept and writes its own Parquet; all but the last return the
columns of ``documents``. Nulls, empty texts and repeated rows follow the operators' docstrings.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramframe.llm.bpe import encode
from gramframe.llm.line_dedup import delete_repeated_runs
from gramframe.llm.mixing import mix
from gramframe.llm.near_dup import near_duplicates
from gramframe.llm.quality_rules import quality
from gramframe.session import ensure_checkpoint_dir, ship_package
from gramframe.sources.tables import read_table

MAX_EPOCHS = 1.5
MIN_WORDS = 50  # of a repeated run of fewer lines than the operator's own


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line rules clean every text; rejected documents go. ``n_chars`` follows the text."""
    kept = quality(docs).where("kept")
    return _documents(kept.withColumn("text", F.col("cleaned_text")), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines or of MIN_WORDS words go; documents of which no line is left go too."""
    out = delete_repeated_runs(docs, min_words=MIN_WORDS)
    return _documents(out.where((F.col("n_deleted") == 0) | (F.col("n_deleted") < F.col("n_lines"))), docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate group stays, the one with the smallest id; of rows with
    equal id and text one stays."""
    ship_package(spark)
    keep = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(keep, "doc_id", "left_semi")
    return _documents(named.dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id is null")), docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at temperature weights: every document at least once, none over MAX_EPOCHS times on average."""
    return _documents(mix(docs, max_epochs=MAX_EPOCHS), docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every row; source is carried along."""
    ship_package(spark)
    return encode(docs, extra=["source"])


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dup", near_dup_stage),
    ("mix_sources", mix_stage),
    ("bpe", encode_stage),
]

# Stages 3 to 5 have no SQL form (signatures, hashed permutations, the tokenizer's merges).
ORACLE_SQL = None


def _documents(rows: DataFrame, like: DataFrame) -> DataFrame:
    """Rows with the columns of ``like``; n_chars is that of the text."""
    if "n_chars" in like.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return rows.select(*like.columns)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    ship_package(spark)
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
