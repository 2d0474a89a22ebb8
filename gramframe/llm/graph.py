"""Connected components of an edge table, by contraction; nothing is collected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


LOCAL_EDGES = 200_000  # edges that one task may hold


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task as stars: every node with the smallest node that these edges link it to."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    stars = np.array([(top(x), x) for x in list(up) if top(x) != x], np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(stars[:, 0]), pa.array(stars[:, 1])], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for all nodes with an edge.

    While more than ``LOCAL_EDGES`` edges are left, a round turns the edges of every task into stars,
    lets each node join one neighbour or stay, and drops edges inside a joined group. Even rounds join the
    smallest id, which ends stars at once; odd rounds join the smallest hash of the round, which shrinks any
    shape (long chains too) by a constant factor on average. Hot nodes cost one pre-aggregated minimum. The
    rest, bounded by ``LOCAL_EDGES``, is finished in one task."""
    pairs = cut_lineage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    label, level, left = None, 0, pairs.count()
    while left > LOCAL_EDGES:
        pairs = cut_lineage(pairs.coalesce(-(-left // LOCAL_EDGES)).mapInArrow(_forest, "a long, b long").distinct())
        if label is None:
            label = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("top", F.col("node"))
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        by_hash = level % 2 == 1
        rank = lambda c: F.struct((F.xxhash64(F.col(c), F.lit(level)) if by_hash else F.col(c)).alias("h"), F.col(c).alias("v"))  # noqa: B023,E731
        moves = cut_lineage(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(
            F.col("a").alias("top"), F.least(F.col("m"), rank("a"))["v"].alias("to")).where("top <> to"))
        label = cut_lineage(label.join(moves, "top", "left").select("node", F.coalesce("to", "top").alias("top")))
        moved = pairs.join(moves.select(F.col("top").alias("a"), F.col("to").alias("x")), "a", "left").join(
            moves.select(F.col("top").alias("b"), F.col("to").alias("y")), "b", "left")
        pairs = cut_lineage(moved.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).where("a <> b")
                            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        left, level = pairs.count(), level + 1
    stars = pairs.coalesce(1).mapInArrow(_forest, "a long, b long")
    if label is None:
        stars = cut_lineage(stars)
        return stars.select(F.col("b").alias("node"), F.col("a").alias("root")).union(stars.select("a", F.col("a").alias("root")).distinct())
    label = label.join(stars.select(F.col("b").alias("top"), F.col("a").alias("to")), "top", "left").select("node", F.coalesce("to", "top").alias("top"))
    label = cut_lineage(label)
    roots = label.groupBy("top").agg(F.min("node").alias("root"))
    return label.join(roots, "top").select("node", "root")
