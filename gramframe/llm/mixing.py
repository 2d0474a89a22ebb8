"""Operator 8, mixing sources to target weights.

Weights are w_s proportional to (token share of s) ** exponent. The exponent is found by bisection
on [0, 1] (``BITS`` halvings, ``LEVELS`` of them per Spark job over the per-source table, which stays a
DataFrame): either the one whose weights reach a target entropy, or the smallest (flattest
mix) under which no source is read more than ``max_epochs`` times. With a token budget B source s
owes w_s * B tokens; without one B is the smallest that reads every source at least once, so no
document is lost. Whole epochs take every document of the source; the rest of the budget is a
prefix of a block permutation: documents fall into blocks by a hash of (id, source, epoch), blocks
and their rows follow hash order, and the prefix ends where the tokens run out. Block sums
locate the end, so only the one block in which it lies is ordered; the selection itself is a filter.

Texts are never shuffled: the plan, a row per source, goes to the documents.

Defined results: a null source is one source of its own; documents without words take no tokens;
a source without tokens is read once; rows with equal id and source tie and go together; other
columns may have any names (``names.set_aside``); an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .names import set_aside
from .quality_rules import words

BITS, LEVELS = 42, 6
BLOCK_ROWS = 16384
MAX_EPOCHS = 2.0
PLACE_BITS = 60
BROADCAST_SOURCES, SALTS = 100_000, 16


def exponent(sources: DataFrame, max_epochs: float | None = MAX_EPOCHS, target_entropy: float | None = None, budget_share: float | None = None) -> float:
    """Exponent in [0, 1] by bisection over the table (source, tokens)."""
    lo, width = 0.0, 1.0
    share = F.col("tokens") / F.col("total")
    for _ in range(BITS // LEVELS):
        # the 2^LEVELS - 1 points that LEVELS halvings could visit, evaluated in one job
        cells = 2 ** LEVELS
        points = [lo + width * i / cells for i in range(cells)] + [lo + width]
        grid = sources.crossJoin(F.broadcast(sources.agg(F.sum("tokens").alias("total")))).where("tokens > 0")
        grid = grid.withColumn("p", F.explode(F.array(*[F.lit(x) for x in points])))
        grid = grid.groupBy("p").agg(
            F.sum(F.pow(share, F.col("p"))).alias("z"),
            F.sum(F.pow(share, F.col("p")) * F.col("p") * F.log(share)).alias("e"),
            F.max(F.pow(share, F.col("p") - 1)).alias("most"), F.min(F.pow(share, F.col("p") - 1)).alias("least"))
        got = {r["p"]: r for r in grid.collect()}  # one row per point
        if not got:
            return 1.0

        def flat_enough(p: float) -> bool:
            """True where the exponent must not be smaller: the limit is met (or entropy is low enough)."""
            r = got[p]
            if target_entropy is not None:
                return math.log(r["z"]) - r["e"] / r["z"] <= target_entropy
            epochs = r["most"] / r["z"] * budget_share if budget_share is not None else r["most"] / r["least"]
            return epochs <= max_epochs
        a, b = 0, cells
        if flat_enough(points[0]):
            return points[0]
        if not flat_enough(points[b]):
            return points[b]
        for _ in range(LEVELS):
            mid = (a + b) // 2
            a, b = (a, mid) if flat_enough(points[mid]) else (mid, b)
        lo, width = points[a], width / cells
    return lo + width


def mix(docs: DataFrame, max_epochs: float | None = MAX_EPOCHS, target_entropy: float | None = None, budget_tokens: int | None = None,
        id_col: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix") -> DataFrame:
    """``docs`` once per epoch in which the mix reads them, with ``n_tokens`` and ``epoch`` (from 0).
    Own columns replace columns of the same names."""
    docs, names_back = set_aside(docs)
    src = F.struct(F.col(f"`{source}`").isNull().alias("none"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("name"))
    tokens = F.coalesce(F.size(words(F.col(f"`{text}`"))), F.lit(0)).cast("long")
    narrow = cut_lineage(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), src.alias("s"),
                                     F.when(F.col(f"`{text}`").isNull(), F.lit(0)).otherwise(tokens).cast("long").alias("tokens")))
    sources = cut_lineage(narrow.groupBy("s").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    share = budget_tokens / total if budget_tokens and total else None
    alpha = exponent(sources, max_epochs, target_entropy, share)
    weights = sources.crossJoin(F.broadcast(sources.where("tokens > 0").agg(
        F.sum(F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(alpha))).alias("z"),
        F.min(F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(alpha - 1))).alias("least"))))
    part = F.col("tokens") / F.lit(float(max(total, 1)))
    epochs = F.pow(part, F.lit(alpha - 1)) / (F.col("z") * F.lit(share) ** -1 if share else F.col("least"))
    plan = weights.select("s", "rows", "tokens", F.when(F.col("tokens") > 0, F.round(epochs, 9)).otherwise(F.lit(1.0)).alias("epochs"))
    plan = plan.withColumn("full", F.floor("epochs").cast("int")).withColumn(
        "rest", F.floor((F.col("epochs") - F.floor("epochs")) * F.col("tokens")).cast("long"))
    # 2^bits blocks of about BLOCK_ROWS rows; a place's block is its leading bits
    plan = cut_lineage(plan.withColumn("bits", F.ceil(F.log2(F.greatest(F.col("rows") / BLOCK_ROWS, F.lit(1.0)))).cast("int")))
    n_sources = plan.count()
    ends = prefix_ends(narrow, plan, seed, n_sources)
    chosen = plan.join(ends, "s", "left").select(F.col("s").alias("__s"), F.col("full").alias("__full"), F.col("end").alias("__end"))

    own = ["n_tokens", "epoch"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    rows = docs.select(*kept, src.alias("__s"), F.col(f"`{id_col}`").cast("long").alias("__id"),
                       F.when(F.col(f"`{text}`").isNull(), F.lit(0)).otherwise(tokens).cast("long").alias("__tokens"))
    rows = _with_plan(rows, chosen, n_sources, "__s", "__id")
    extra = F.coalesce(_permuted(F.col("__id"), F.col("__s"), F.col("__full"), seed) <= F.col("__end"), F.lit(False))
    last = F.col("__full") - 1 + F.when(extra, F.lit(1)).otherwise(F.lit(0))
    rows = rows.withColumn("__last", last).where("__last >= 0").withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("__last"))))
    return rows.select(*kept, F.col("__tokens").alias("n_tokens"), F.col("__epoch").alias("epoch")).withColumnsRenamed(names_back)


def _with_plan(rows: DataFrame, plan: DataFrame, n_sources: int, s: str, id_: str) -> DataFrame:
    """Rows next to their source's plan. A plan of up to ``BROADCAST_SOURCES`` rows (counted) goes to the rows; a larger one
    meets them in ``SALTS`` copies, so that a hot source is no single task."""
    if n_sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(plan), s)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(id_), F.lit(SALTS)).cast("int"))
    return salted.join(plan.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [s, "__salt"]).drop("__salt")


def _permuted(id_: Column, s: Column, epoch: Column, seed: str) -> Column:
    """Place in the source's permutation of that epoch, from 0 to 2^60: leading digits of an md5."""
    text = F.concat_ws("~", F.lit(seed), F.coalesce(id_.cast("string"), F.lit("none")), epoch.cast("string"), s["none"].cast("string"), s["name"])
    return F.conv(F.substring(F.md5(text), 1, PLACE_BITS // 4), 16, 10).cast("long")


def prefix_ends(narrow: DataFrame, plan: DataFrame, seed: str, n_sources: int) -> DataFrame:
    """(s, end): the last place of the permutation that the rest of the source's budget reaches."""
    rows = _with_plan(narrow, plan.where("rest > 0").select("s", "full", "rest", "bits"), n_sources, "s", "id")
    rows = rows.withColumn("at", _permuted(F.col("id"), F.col("s"), F.col("full"), seed))
    rows = rows.withColumn("block", F.expr(f"shiftright(at, {PLACE_BITS} - bits)"))
    sums = rows.groupBy("s", "block", "rest").agg(F.sum("tokens").alias("t"))
    run = W.partitionBy("s").orderBy("block")
    sums = sums.withColumn("upto", F.sum("t").over(run)).withColumn("before", F.col("upto") - F.col("t"))
    edge = sums.where("before <= rest and upto > rest").select("s", "block", "before")   # one block a source
    at_edge = F.broadcast(edge) if n_sources <= BROADCAST_SOURCES else edge
    inside = rows.join(at_edge, ["s", "block"]).withColumn("upto", F.col("before") + F.sum("tokens").over(W.partitionBy("s").orderBy("at")))
    last = inside.where("upto <= rest").groupBy("s").agg(F.max("at").alias("within"))
    # nothing of the edge block fits: the end is the block's lower bound
    bound = edge.join(plan.select("s", "bits"), "s").select("s", (F.expr(f"shiftleft(block, {PLACE_BITS} - bits)") - 1).alias("bound"))
    return bound.join(last, "s", "left").select("s", F.coalesce("within", "bound").alias("end"))
