"""Phase 1 queries: profile, validation, projection, head (fixtures W and D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import order_hash
from ..operators import profile as prof
from ..sources.fixtures import FEATURES, KEY, TARGET, fixture_d, fixture_w
from .params import SEED
from .registry import query


@query("q_profile")
def q_profile(spark, sf_dir):
    return prof.profile(fixture_w(spark, sf_dir), FEATURES)


@query("q_class_counts")
def q_class_counts(spark, sf_dir):
    return prof.class_counts(fixture_w(spark, sf_dir), TARGET)


@query("q_missing")
def q_missing(spark, sf_dir):
    return prof.missing_counts(fixture_w(spark, sf_dir), FEATURES)


@query("q_duplicates")
def q_duplicates(spark, sf_dir):
    # duplicates over the feature and target columns (the key would make every row unique)
    return prof.duplicate_rows(fixture_w(spark, sf_dir), FEATURES + [TARGET])


@query("q_duplicates_docs")
def q_duplicates_docs(spark, sf_dir):
    # exact duplicate documents: (lang, text) over the whole documents table
    from ..sources.tables import read_table
    return prof.duplicate_rows(read_table(spark, sf_dir, "documents", ["lang", "text"]), ["lang", "text"])


@query("q_label_domain")
def q_label_domain(spark, sf_dir):
    return prof.label_domain(fixture_w(spark, sf_dir), TARGET)


@query("q_label_domain_docs")
def q_label_domain_docs(spark, sf_dir):
    return prof.label_domain(fixture_d(spark, sf_dir), TARGET)


@query("q_project_features")
def q_project_features(spark, sf_dir):
    w = fixture_w(spark, sf_dir)
    return w.select(KEY, *FEATURES, F.col(TARGET).cast("int").alias(TARGET))


@query("q_head")
def q_head(spark, sf_dir):
    """O3: first 16 rows of the table in its (hash) row order; the order is explicit."""
    w = fixture_w(spark, sf_dir).withColumn("_h", order_hash(SEED, "order", KEY))
    return (w.orderBy("_h", KEY).limit(16)
            .select(KEY, *FEATURES, TARGET))


@query("q_csv_contract")
def q_csv_contract(spark, sf_dir):
    """W written as a CSV under the input contract (fixed names and order, blank =
    missing), read back with a declared schema and header check, label domain validated,
    then profiled (rows, class counts, missing per feature)."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources.csv_io import CONTRACT_FEATURES, CONTRACT_TARGET, read_feature_csv

    w = fixture_w(spark, sf_dir)
    named = w.select(*[F.col(f).alias(c) for f, c in zip(FEATURES, CONTRACT_FEATURES)],
                     F.col(TARGET).alias(CONTRACT_TARGET))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    named.write.mode("overwrite").option("header", True).csv(path)
    back = read_feature_csv(spark, path, CONTRACT_FEATURES, CONTRACT_TARGET)
    counts = back.agg(F.count(F.lit(1)).alias("rows"),
                      F.count_if(F.col(CONTRACT_TARGET) == 0).alias("n0"),
                      F.count_if(F.col(CONTRACT_TARGET) == 1).alias("n1"),
                      *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in CONTRACT_FEATURES])
    return counts
