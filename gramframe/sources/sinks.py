"""Result sinks. Every writer creates its folder (overwrite mode)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str) -> None:
    """Study / comparison tables: one CSV with a header (these tables are small)."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Nested records (metrics, summary): JSON lines, UTF-8 kept as is."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_kernel(df: DataFrame, path: str, partition_col: str | None = "run_id") -> None:
    """Kernel long tables: parquet, partitioned by run when the table has runs."""
    w = df.write.mode("overwrite")
    if partition_col and partition_col in df.columns:
        w = w.partitionBy(partition_col)
    w.parquet(path)
