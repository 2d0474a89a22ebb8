"""S1-S3 for a user's own table: a contract, a quarantine for rows that break it, and a stable row key.

Rows are read as text (CSV) or as given (Parquet, a DataFrame), checked column by column and split in two: typed rows, and
rejected rows with the reasons. Missing features are allowed (they are imputed later), missing labels are not.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.profile import validate_columns
from ..session import cut_lineage

CORRUPT = "_corrupt"


@dataclass(frozen=True)
class Contract:
    """Column names of a table: features, a 0/1 target and, if it has one, its unique key."""

    features: tuple[str, ...]
    target: str
    key: str | None = None

    @property
    def columns(self) -> list[str]:
        return [*([self.key] if self.key else []), *self.features, self.target]


@dataclass(frozen=True)
class Dataset:
    rows: DataFrame         # row_key, features as doubles, target as int
    rejected: DataFrame     # the contract's columns as text, reasons
    contract: Contract


def _source(spark: SparkSession, source: str | DataFrame, contract: Contract) -> DataFrame:
    """The contract's columns as text, and the corrupt record of lines that do not split into them."""
    if not isinstance(source, str):
        table = source
    elif source.rstrip("/").endswith(".parquet"):
        table = spark.read.parquet(source)
    else:
        header = spark.read.option("header", True).csv(source)   # names only: no job over the data
        validate_columns(header, contract.columns)
        schema = T.StructType([T.StructField(c, T.StringType()) for c in contract.columns] + [T.StructField(CORRUPT, T.StringType())])
        return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False) \
            .option("columnNameOfCorruptRecord", CORRUPT).csv(source)
    missing = [c for c in contract.columns if c not in table.columns]
    if missing:
        raise ValueError(f"the table lacks the columns {missing}")
    return table.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in contract.columns], F.lit(None).cast("string").alias(CORRUPT))


def occurrence(df: DataFrame, cols: list[str], name: str) -> DataFrame:
    """Number (from 1) of a row among the rows with the same values. Partitions number their own rows after the
    counts of the partitions before, so a group that holds a third of the table is no single task."""
    keyed = cut_lineage(df.withColumn("_part", F.spark_partition_id()).withColumn("_group", F.sha2(F.concat_ws(
        "\u0001", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0002")) for c in cols]), 256)))
    sizes = keyed.groupBy("_group", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_group", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_group", "_part").orderBy(F.monotonically_increasing_id())
    out = keyed.join(offsets, ["_group", "_part"])
    return out.withColumn(name, F.col("_before") + F.row_number().over(inside)).drop("_before", "_part")


def load(spark: SparkSession, source: str | DataFrame, contract: Contract) -> Dataset:
    """Split a table by its contract. Without a key of its own a row's key is the digest of its values and its number among
    equal rows, so the same rows get the same keys from any format and partitioning."""
    raw = _source(spark, source, contract)
    text = {c: F.trim(F.col(f"`{c}`")) for c in contract.columns}
    blank = {c: F.col(f"`{c}`").isNull() | (t == "") | (F.lower(t) == "nan") for c, t in text.items()}
    number = {c: F.when(~blank[c], F.expr(f"try_cast(trim(`{c}`) as double)")) for c in (*contract.features, contract.target)}
    reasons = [F.when(F.col(CORRUPT).isNotNull(), F.lit("line does not match the header"))]
    reasons += [F.when(~blank[c] & number[c].isNull(), F.lit(f"{c} is not a number")) for c in contract.features]
    reasons += [F.when(F.abs(number[c]) == F.lit(float("inf")), F.lit(f"{c} is not finite")) for c in contract.features]
    reasons += [F.when(blank[contract.target], F.lit("label is missing")).when(
        number[contract.target].isNull() | ~number[contract.target].isin(0.0, 1.0), F.lit("label is not 0 or 1"))]
    if contract.key:
        reasons.append(F.when(blank[contract.key], F.lit("key is missing")))
    # of a line that does not split, only that is said
    found = F.when(F.col(CORRUPT).isNotNull(), F.array(F.lit("line does not match the header"))).otherwise(F.array_compact(F.array(*reasons)))
    checked = cut_lineage(raw.withColumn("reasons", found))   # the corrupt column needs the whole record: parsed once
    rejected = checked.where(F.size("reasons") > 0).select(*[f"`{c}`" for c in contract.columns], CORRUPT, "reasons")
    good = checked.where(F.size("reasons") == 0)
    typed = good.select(*([F.trim(F.col(f"`{contract.key}`")).alias("row_key")] if contract.key else []),
                        *[number[c].alias(c) for c in contract.features], number[contract.target].cast("int").alias(contract.target))
    if contract.key:
        again = typed.groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
        if again:
            raise ValueError(f"key {again[0]['row_key']!r} occurs {again[0]['n']} times")
        return Dataset(typed, rejected, contract)
    values = [*contract.features, contract.target]
    keyed = occurrence(typed, values, "_k").withColumn("row_key", F.concat_ws("~", "_group", F.col("_k").cast("string")))
    return Dataset(cut_lineage(keyed.select("row_key", *[f"`{c}`" for c in values])), rejected, contract)


def rejection_counts(data: Dataset) -> DataFrame:
    """(reason, n) over the quarantine; a row counts once for each of its reasons."""
    return data.rejected.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))

