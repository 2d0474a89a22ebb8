"""Operator 5, deletion of repeated line runs, in DataFrame functions only.

The corpus is a set of line-ID sequences, one per document. Prefix doubling names its suffixes:
after a round two suffixes share a name exactly when their first ``depth`` lines agree, the name
being the first place (document, line) of the class, so names are exact and need no dense ranks.
Each round is one window (the name some lines further on) and one aggregation; only suffixes that
still share their name go on, so rounds shrink. The suffixes that share a name at depth ``min_run`` are an LCP
interval of that depth; every occurrence but the interval's first is a later copy, and its lines
are deleted. A shorter run that holds ``min_words`` words qualifies too: rounds then add one line each, so that
names of every depth exist (without ``min_words`` they double). Overlapping copies join into maximal runs.

Order of documents: by id (null last), then by a hash of the text. Defined results: blank lines (no
word) are never compared or deleted and do not interrupt a run; null texts stay null; rows with equal
id and text are one document here and lose the same lines; a document's own earlier lines count
as earlier copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .names import set_aside
from .quality_rules import let

MIN_RUN = 3
MIN_WORDS = 50  # of a repeated run of fewer lines
HAS_WORD = r"[^\x20\x09-\x0D]"
DOC = ["__d0", "__d1", "__d2"]


def _document(id_col: str, text: str) -> list[Column]:
    c = F.col(f"`{id_col}`")
    return [c.isNull().alias(DOC[0]), F.coalesce(c.cast("long"), F.lit(0)).alias(DOC[1]), F.xxhash64(F.col(f"`{text}`")).alias(DOC[2])]


def _word_lines(lines: Column) -> Column:
    """Lines that hold a word, with their place among all lines."""
    return F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("pos"), x.alias("line"))), lambda r: r["line"].rlike(HAS_WORD))


def line_ids(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: bool = False) -> DataFrame:
    """(document, seq, id): the lines with a word in order, with the 128-bit fingerprint that is their ID,
    and on request ``n``, their number of words."""
    def own(x: Column) -> list[Column]:
        return [F.size(F.filter(F.split(x, r"[\x20\x09-\x0D]+"), lambda y: y != "")).alias("n")] if words else []
    rows = docs.where(F.col(f"`{text}`").isNotNull()).select(*_document(id_col, text), F.posexplode(
        F.transform(F.filter(F.split(F.col(f"`{text}`"), "\n"), lambda x: x.rlike(HAS_WORD)),
                    lambda x: F.struct(F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("second"), x).alias("b")).alias("id"), *own(x)))).alias("seq", "line"))
    return rows.select(*DOC, "seq", "line.*")


def _renamed(rows: DataFrame, key: Column, *kept: Column) -> DataFrame:
    """Rows whose key occurs at two or more places, named by the first of these places."""
    rows = rows.select(*DOC, "seq", key.alias("key"), *kept)
    place = F.struct(*[F.col(c) for c in (*DOC, "seq")])
    names = rows.groupBy("key").agg(F.min(place).alias("name"), F.max(place).alias("last")).where(F.col("name") != F.col("last"))
    return rows.join(names.drop("last"), "key").drop("key")


def repeated_runs(docs: DataFrame, min_run: int = MIN_RUN, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(document, seq, name): every start of ``min_run`` lines that occur at two or more places."""
    rows = _renamed(line_ids(docs, id_col, text), F.col("id"))
    depth = 1
    while depth < min_run:
        step = min(depth, min_run - depth)
        there = W.partitionBy(*DOC).orderBy("seq").rangeBetween(step, step)
        paired = rows.withColumn("then", F.first("name").over(there)).where(F.col("then").isNotNull())
        rows = _renamed(paired, F.struct(F.col("name").alias("x"), F.col("then").alias("y")))
        depth += step
    return rows


def later_copies(docs: DataFrame, min_run: int = MIN_RUN, id_col: str = "doc_id", text: str = "text", min_words: int | None = MIN_WORDS) -> DataFrame:
    """(document, seq, len): every start of a later copy of ``min_run`` lines, or of fewer lines that
    hold ``min_words`` words."""
    place = F.struct(*[F.col(c) for c in (*DOC, "seq")])

    def later(rows: DataFrame, depth: int) -> DataFrame:
        return rows.where(place != F.col("name")).select(*DOC, "seq", F.lit(depth).alias("len"))

    if min_words is None:
        return later(repeated_runs(docs, min_run, id_col, text), min_run)
    n, words = F.col("n"), F.col("words")  # of the first line, of all lines
    # every round is read by the aggregation, the join and the copies found: texts are split once, rounds are stored
    rows = cut_lineage(_renamed(cut_lineage(line_ids(docs, id_col, text, words=True)), F.col("id"), n, n.alias("words")))
    there = W.partitionBy(*DOC).orderBy("seq").rangeBetween(1, 1)
    found = []
    for depth in range(1, min_run):
        found.append(later(rows.where(words >= min_words), depth))
        paired = rows.withColumns({"then": F.first("name").over(there), "more": F.first("words").over(there)}).where(F.col("then").isNotNull())
        rows = _renamed(paired, F.struct(F.col("name").alias("x"), F.col("then").alias("y")), n, (n + F.col("more")).alias("words"))
        rows = rows if depth + 1 == min_run else cut_lineage(rows)
    out = later(rows, min_run)
    for more in found:
        out = out.unionByName(more)
    return out


def delete_repeated_runs(docs: DataFrame, min_run: int = MIN_RUN, id_col: str = "doc_id", text: str = "text", min_words: int | None = MIN_WORDS) -> DataFrame:
    """``docs`` with the text less its later copies of line runs, and ``n_lines`` (lines with a word),
    ``n_deleted``, ``n_runs`` (maximal deleted runs). Own columns replace columns of the same names."""
    docs, names_back = set_aside(docs)
    starts = later_copies(docs, min_run, id_col, text, min_words)
    deleted = starts.groupBy(*DOC).agg(F.array_sort(F.collect_set(F.struct("seq", "len"))).alias("__starts"))
    own = ["n_lines", "n_deleted", "n_runs"]
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in own], *_document(id_col, text))
    rows = rows.join(deleted, DOC, "left")
    covered = let(F.col("__starts"), lambda s: F.array_distinct(F.flatten(F.transform(s, lambda a: F.sequence(a["seq"], a["seq"] + a["len"] - 1)))))
    # starts ascend, so covered lines do
    breaks = let(F.col("__covered"), lambda s: F.lit(1) + F.size(F.filter(F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: b - a > 1), lambda x: x)))
    body = F.col(f"`{text}`")
    lines = F.split(body, "\n")

    def rest(all_lines: Column) -> Column:
        gone = let(_word_lines(all_lines), lambda r: F.transform(F.col("__covered"), lambda s: r[s]["pos"]))
        kept = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), gone)
        return F.array_join(F.transform(kept, lambda p: all_lines[p]), "\n")

    rows = rows.withColumn("__covered", F.when(F.col("__starts").isNotNull(), covered))
    rows = rows.withColumns({
        "n_lines": F.when(body.isNull(), F.lit(0)).otherwise(F.size(F.filter(lines, lambda x: x.rlike(HAS_WORD)))).cast("long"),
        "n_deleted": F.coalesce(F.size("__covered"), F.lit(0)).cast("long"),
        "n_runs": F.when(F.col("__starts").isNull(), F.lit(0)).otherwise(breaks).cast("long"),
        "__text": F.when(F.col("__starts").isNull(), body).otherwise(let(lines, rest)),
    })
    names = [c for c in docs.columns if c not in own]
    out = rows.select(*[F.col("__text").alias(c) if c == text else F.col(f"`{c}`") for c in names], *own)
    return out.withColumnsRenamed(names_back)
