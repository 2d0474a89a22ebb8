"""CSV scan of a feature table with a fixed column contract.

The schema is declared (no inference); ``enforceSchema=False`` makes Spark check the header
against it, so a swapped or renamed header fails instead of silently shifting columns.
Blank fields are read as NULL and NaN is normalised to NULL once at the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import nan_to_null
from ..operators.profile import validate_columns, validate_labels


# The column contract of the studied input table (names and order).
CONTRACT_FEATURES = ["ph", "Hardness", "Solids", "Chloramines", "Sulfate", "Conductivity",
                     "Organic_carbon", "Trihalomethanes", "Turbidity"]
CONTRACT_TARGET = "Potability"


def feature_schema(features: list[str], target: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.DoubleType(), True) for c in features]
                        + [T.StructField(target, T.DoubleType(), True)])


def read_feature_csv(spark: SparkSession, path: str, features: list[str], target: str,
                     validate: bool = True) -> DataFrame:
    """Read, check the column contract (names and order) and the label domain {0, 1};
    return features as nullable doubles and the target as int."""
    raw = (spark.read.schema(feature_schema(features, target))
           .option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
           .csv(path))
    validate_columns(raw, features + [target])
    df = raw.select(*[nan_to_null(c).alias(c) for c in features], F.col(target))
    if validate:
        validate_labels(df, target)
    return df.withColumn(target, F.col(target).cast("int"))


def with_row_key(df: DataFrame, key: str = "row_key") -> DataFrame:
    """A row identity for a table without one (the CSV has only an implicit index).

    The id depends on the partition layout, so the keyed table is checkpointed at once: a
    recomputation after an executor loss must not renumber rows that later joins rely on."""
    from ..session import cut_lineage
    return cut_lineage(df.withColumn(key, F.monotonically_increasing_id().cast("string")))
