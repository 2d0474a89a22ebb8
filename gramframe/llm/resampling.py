"""Operator 12, importance resampling towards a target distribution, with length-bucketed CRC matrices.

A text's features are its runs of 1 to ``RUN`` consecutive words; a feature's bucket is the crc32 of its bytes modulo
``BUCKETS``. Per flush of about ``FLUSH`` words a task numbers the distinct words, finds the distinct runs by
their numbers, groups the distinct features' bytes by equal length into two-dimensional uint8 arrays
(bytes x features), updates the CRCs of a whole array byte by byte, and scatters the buckets back to every occurrence.
(Features beyond ``LONG`` bytes, rare and wide, take one library call each: the same function.)

Two passes: bucket counts of both tables (a task sends at most ``BUCKETS`` rows), then the gain
of every bucket, a table of ``BUCKETS`` numbers that is broadcast, summed over each text's features. Noise from a hash of the id
turns the sums into a weighted draw without replacement. The last score drawn is found by
histogram passes that narrow its range (nothing is sorted for that); only the drawn rows are ordered.

Defined results: null texts and texts without words have no features and weight 0; rows with a null id get weight but no score
and are not drawn; repeated rows count and are drawn one by one (the order among rows with equal score and id is
that of the checkpointed table); very long texts are read in pieces of ``PIECE`` bytes; an empty target
table gives the gains of the formula with T = 0; an empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import ordered_prefix
from ..session import cut_lineage
from .blocks import texts

RUN, BUCKETS, MIN_WORDS, PERCENT, SEED = 3, 10_000, 20, 5, 42
PIECE, FLUSH, LONG, CELLS = 1 << 20, 1 << 18, 256, 1 << 22
BINS = 4096

# word bytes in lower case, everything else a space: digits, ASCII letters and all bytes of other characters
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1)
    return t.astype(np.uint32)


_CRC = _crc_table()


def crcs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """crc32 of the byte strings data[start:start + size], as uint32."""
    out = np.empty(len(starts), np.uint32)
    order = np.argsort(sizes, kind="stable")
    edges = np.flatnonzero(np.diff(sizes[order], prepend=-1))
    for lo, hi in zip(edges.tolist(), np.append(edges[1:], len(order)).tolist()):
        size = int(sizes[order[lo]])
        if size > LONG:
            for i in order[lo:hi].tolist():
                out[i] = zlib.crc32(data[starts[i]:starts[i] + size])
            continue
        for at in range(lo, hi, CELLS // size):
            own = order[at:min(hi, at + CELLS // size)]
            matrix = data[starts[own][None, :] + np.arange(size)[:, None]]  # a row per byte position
            crc = np.full(len(own), 0xFFFFFFFF, np.uint32)
            for column in matrix:
                crc = _CRC[(crc ^ column) & np.uint32(255)] ^ crc >> np.uint32(8)
            out[own] = ~crc
    return out


class _Numbers(dict):
    """Word -> number, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    lo = 0
    while lo < len(text):
        part = text[lo:lo + PIECE].translate(_WORD)
        hi = lo + len(part)
        if hi < len(text) and part[-1] != 32:
            cut = part.rfind(b" ")
            while cut < 0 and hi < len(text):  # one word longer than a piece
                part += text[hi:hi + PIECE].translate(_WORD)
                hi, cut = min(len(text), hi + PIECE), part.rfind(b" ")
            if hi < len(text) or cut >= 0:
                part, hi = part[:cut + 1], lo + cut + 1
        yield part.split()
        lo = hi


def _flushes(rows: list[bytes]) -> Iterator[tuple[list[bytes], list[int], list[int], list[int]]]:
    """(words, first word, number of repeated leading words, row) of segments: texts, or pieces of long ones,
    which start with the last words of the piece before."""
    words: list[bytes] = []
    first: list[int] = []
    carried: list[int] = []
    row: list[int] = []
    for i, text in enumerate(rows):
        tail: list[bytes] = []
        for piece in _pieces(text):
            first.append(len(words))
            carried.append(len(tail))
            row.append(i)
            words += tail
            words += piece
            tail = (tail + piece)[-(RUN - 1):]
            if len(words) >= FLUSH:
                yield words, first, carried, row
                words, first, carried, row = [], [], [], []
    if words:
        yield words, first, carried, row


def _run_buckets(words: list[bytes], first: list[int], carried: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For every run length: (buckets of the distinct runs, their number per occurrence, segment per occurrence)."""
    numbers = _Numbers()
    word = np.array([numbers[w] for w in words], np.int64)
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.fromiter(itertools.accumulate(len(w) + 1 for w in words), np.int64, len(words)) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    at = np.array(first, np.int64)
    segment = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(words))))
    inside = np.arange(len(words)) - at[segment]  # place in the segment
    is_new = inside >= np.array(carried, np.int64)[segment]
    run = word  # number of the run that ends here, among runs of its length
    for size in range(1, RUN + 1):
        if size > 1:
            run = np.append(np.int64(0), run[:-1]) * len(numbers) + word
        whole = np.flatnonzero(inside >= size - 1)
        _, where, which = np.unique(run[whole], return_index=True, return_inverse=True)
        run = np.zeros(len(words), np.int64)
        run[whole] = which
        last = whole[where]
        begin = starts[last - size + 1]
        bucket = (crcs(data, begin, ends[last] - begin) % np.uint32(BUCKETS)).astype(np.int64)
        here = is_new[whole]
        yield bucket, which[here], segment[whole[here]]


def bucket_counts(table: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for words, first, carried, _ in _flushes(texts(batch)):
                for bucket, which, _ in _run_buckets(words, first, carried):
                    np.add.at(total, bucket, np.bincount(which, minlength=len(bucket)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])
    return table.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text") -> np.ndarray:
    """floor(1000 ln) of the buckets' smoothed target share over their share in ``docs`` (BUCKETS numbers)."""
    counts = []
    for table, column in ((docs, text), (target, target_text)):
        own = [0] * BUCKETS
        for r in bucket_counts(table, column).collect():  # BUCKETS rows at most
            own[r["bucket"]] = r["n"]
        counts.append(own)
    s, t = counts
    all_s, all_t = float(sum(s) + BUCKETS), float(sum(t) + BUCKETS)
    return np.array([math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s, t)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight), one row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
                for words, first, carried, row in _flushes(texts(batch)):
                    owner = np.array(row, np.int64)
                    for size, (bucket, which, segment) in enumerate(_run_buckets(words, first, carried), 1):
                        per = np.bincount(segment, minlength=len(owner))
                        upto = np.concatenate([[0], np.cumsum(shared.value[bucket][which])])
                        ends = np.cumsum(per)
                        np.add.at(weight, owner, upto[ends] - upto[ends - per])
                        np.add.at(n_features, owner, per)
                        if size == 1:
                            np.add.at(n_words, owner, per)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_features), pa.array(weight)],
                                                 ["doc_id", "n_words", "n_features", "weight"])
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def kth_largest(rows: DataFrame, column: str, k: int) -> int:
    """The k-th largest value of a long column with at least k values: histograms of at most ``BINS`` + 1 rows
    narrow the range until it is one value."""
    lo, hi = rows.agg(F.min(column), F.max(column)).first()
    while lo < hi:
        width = -(-(hi - lo + 1) // BINS)
        own = rows.where(F.col(column).between(lo, hi)).groupBy(F.floor((F.col(column) - F.lit(lo)) / F.lit(width)).alias("bin"))
        for r in sorted(own.agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect(), reverse=True):
            if k <= r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            k -= r["n"]
    return lo


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
             id_col: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank), one row per row of ``docs``; rank is null where not drawn."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    weighed = weights(docs, gains(docs, target, text, target_text), id_col, text).withColumn("score", F.col("weight") + noise)
    scored = cut_lineage(weighed.withColumn("row", F.monotonically_increasing_id()))
    able = scored.where((F.col("n_words") >= min_words) & F.col("doc_id").isNotNull())
    drawn = able.count() * percent // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if not drawn:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    least = kth_largest(able, "score", drawn)
    order = F.struct((-F.col("score")).alias("s"), F.col("doc_id").alias("d"), F.col("row").alias("r"))
    best = ordered_prefix(able.where(F.col("score") >= least).select("row", order.alias("place"), F.lit(1).alias("one")),
                          [], "place", ["one"], max_groups=1)
    rank = best.where(F.col("cum_one") <= drawn).select("row", F.col("cum_one").cast("long").alias("rank"))
    return scored.join(rank, "row", "left").select(*out, "rank")
