"""Column names that cannot clash: own working columns start with two underscores, so the input's such columns are renamed
while an operator works."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` without column names that start with two underscores, and the names to restore."""
    taken = set(docs.columns)
    new = {}
    for c in docs.columns:
        if c.startswith("__"):
            name = f"u{c}"
            while name in taken:
                name = f"u{name}"
            taken.add(name)
            new[c] = name
    return docs.withColumnsRenamed(new), {v: k for k, v in new.items()}


def with_long_id(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Integer ids of any width as long (no change where they are)."""
    return docs.withColumn(id_col, F.col(f"`{id_col}`").cast("long"))
