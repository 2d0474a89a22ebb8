"""Results as committed outputs of a run.

A table is written to its own folder of the run, read back with the schema it was written from, and
compared with what was sent by row count and an order-free digest. Only then does one manifest row name it: a reader
that goes through the manifest never sees a half-written or damaged output, and a failed run leaves none. Kernel
matrices are partitioned; rewriting some runs replaces their partitions only. A manifest row is a small JSON file of its
own, so that writers of different outputs never touch the same file.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "run string, name string, format string, path string, rows long, digest string, fields string, version long"
FORMATS = ("csv", "json", "parquet")


def table_digest(df: DataFrame) -> tuple[int, str]:
    """(rows, digest): the digest is the sum of a 64-bit hash of every row, so the order of rows does not matter."""
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")
    r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(hashed), F.lit(0).cast("decimal(38,0)")).cast("string").alias("d")).first()
    return r["n"], r["d"]


@dataclass(frozen=True)
class Outputs:
    """The output folder ``base`` of a run."""

    spark: SparkSession
    base: str
    run: str

    def _read(self, fmt: str, path: str, schema: T.StructType) -> DataFrame:
        reader = self.spark.read.schema(schema)
        return reader.option("header", True).option("mode", "FAILFAST").csv(path) if fmt == "csv" else reader.format(fmt).load(path)

    def publish(self, df: DataFrame, name: str, fmt: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write, read back, compare, commit. Returns the table that readers will see.

        ``csv`` (flat tables, one file with a header) and ``json`` (nested records, one file) are for results of a bounded
        size; ``parquet`` for matrices, partitioned by ``partition_by``: a second publish replaces the partitions it holds."""
        if fmt not in FORMATS:
            raise ValueError(f"unknown format {fmt!r}; expected one of {FORMATS}")
        path = f"{self.base}/run={self.run}/{name}" + ("" if partition_by else f"-{uuid.uuid4().hex}")
        keep = [c for c in df.columns if c not in (partition_by or [])]
        df = df.select(*[F.col(f"`{c}`") for c in [*keep, *(partition_by or [])]])  # as a partitioned table is read
        whole = df if partition_by else df.coalesce(1)
        writer = whole.write.mode("overwrite")
        if fmt == "csv":
            writer = writer.option("header", True)
        if partition_by:
            writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
        writer.format(fmt).save(path)
        back = self._read(fmt, path, df.schema).select(*[f"`{c}`" for c in df.columns])
        own = back
        if partition_by:  # other partitions of an earlier publish are not part of this one
            mine = df.select(*partition_by).distinct()
            own = back.join(F.broadcast(mine), partition_by, "left_semi").select(*[f"`{c}`" for c in df.columns])
        sent, got = table_digest(df), table_digest(own)
        if sent != got:
            raise OSError(f"output {name} reads back as {got}, {sent} was written; not committed")
        rows, digest = table_digest(back) if partition_by else got
        version = self.manifest(name).count()
        row = [(self.run, name, fmt, path, rows, digest, df.schema.json(), version)]
        self.spark.createDataFrame(row, MANIFEST).coalesce(1).write.json(f"{self.base}/_manifest/{self.run}-{name}-{version}")
        return back

    def manifest(self, name: str | None = None) -> DataFrame:
        """Committed outputs of the run, every version."""
        path = f"{self.base}/_manifest"
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], MANIFEST)
        rows = self.spark.read.schema(MANIFEST).json(f"{path}/*").where(F.col("run") == self.run)
        return rows.where(F.col("name") == name) if name else rows

    def read(self, name: str) -> DataFrame:
        """The latest committed version of an output, checked against its manifest row."""
        row = self.manifest(name).orderBy(F.desc("version")).limit(1).first()
        if row is None:
            raise FileNotFoundError(f"run {self.run} has no committed output {name}")
        df = self._read(row["format"], row["path"], T.StructType.fromJson(json.loads(row["fields"])))
        if table_digest(df) != (row["rows"], row["digest"]):
            raise OSError(f"output {name} of run {self.run} differs from its manifest")
        return df
