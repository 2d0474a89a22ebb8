"""Operator 4, toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features of a text: its words (A-Z lower-cased, ASCII punctuation stripped), word pairs and pairs
with one word between them, hashed to ``2 ** BITS`` coordinates, present or not. The model is fitted on a bounded sample of labelled
rows outside the held-out fold (``FIT_ROWS`` of each class, the first by a hash of the id), whose
size alone fixes the cost of the fit, in ``SHARDS`` shards (1: averaging shards cost recall); a shard makes ``EPOCHS``
passes of per-coordinate FTRL with L1 and L2 terms and the shards' weights are averaged. L1 leaves few non-zero weights, at most ``2 ** BITS``, which are broadcast.

Defined results: null and empty texts score by the intercept alone; labels other than 0 and 1, null
labels and ids do not train; a document with contradictory labels trains as toxic; of several texts under one
id one (by a hash) trains; without both classes the
score is 0.5 everywhere (nothing learnt). Neither label, language, source nor id enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from . import blocks as B
from .names import with_long_id
from .windows import mix

BITS, FIT_ROWS, SHARDS, EPOCHS = 18, 6000, 1, 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 25.0, 0.1
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
_STRIP = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PAIR, _SKIP = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def features(texts: list[bytes], bits: int = BITS) -> list[np.ndarray]:
    """Distinct coordinates of each text."""
    code: dict[bytes, int] = {}
    mask = np.uint64((1 << bits) - 1)
    out = []
    for x in texts:
        h = []
        for w in x.lower().split():
            c = code.get(w)
            if c is None:
                bare = w.strip(_STRIP)
                c = code[w] = xxh3_64_intdigest(bare) if bare else 0
            if c:
                h.append(c)
        a = np.array(h, np.uint64)
        parts = [a, mix(a[:-1] * _PAIR + a[1:]), mix(a[:-2] * _SKIP + a[2:])]
        out.append((np.concatenate(parts) & mask).astype(np.int32))
    return out


def ftrl(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """FTRL-proximal: per-coordinate learning rates, L1 and L2; the intercept is not regularised."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    rare = max(1.0, (len(labels) - labels.sum()) / max(labels.sum(), 1.0))
    order = np.random.default_rng(7).permutation(len(rows))

    def weights(i: np.ndarray) -> np.ndarray:
        zi, bias = z[i], i == size - 1
        l1, l2 = np.where(bias, 0.0, L1), np.where(bias, 0.0, L2)
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(n[i])) / ALPHA + l2))

    rows = [np.append(np.unique(r), np.int32(size - 1)) for r in rows]
    for _ in range(epochs):
        for j in order:
            i = rows[j]
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = (p - labels[j]) * (np.sqrt(rare) if labels[j] else 1.0)
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(size))
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, float]:
    """Averaged weights and intercept (at most 2 ** BITS + 1 rows reach the driver)."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) != HELD_OUT)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by = W.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = known.withColumn("k", F.row_number().over(by)).where(F.col("k") <= fit_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                own = pa.array([np.unique(f) for f in features(B.texts(batch))], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), own], ["doc_id", "toxic", "at"])

    # texts become coordinates (2 ** BITS at most) before they meet, one text an id: 2 * fit_rows rows at most
    rows = rows.select("doc_id", "text", F.col("toxic").cast("int")).mapInArrow(hashed, "doc_id long, toxic int, at array<int>")
    rows = rows.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min_by("at", F.struct(F.xxhash64("at"), "at")).alias("at"))
    shard = F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(SHARDS)).cast("int")

    def train(key, table):
        table = table.sort_by("doc_id")
        y = np.array(table.column("toxic").to_pylist(), np.float64)
        if len(set(y.tolist())) < 2:
            return pa.table({"i": pa.array([], pa.int32()), "w": pa.array([], pa.float64()), "one": pa.array([], pa.int32())})
        w, bias = ftrl([x.values.to_numpy() for x in table.column("at")], y)
        at = np.flatnonzero(w)
        return pa.table({"i": pa.array(np.append(at, -1).astype(np.int32)), "w": pa.array(np.append(w[at], bias)), "one": pa.array(np.append(np.zeros(len(at)), 1).astype(np.int32))})

    found = rows.withColumn("shard", shard).groupBy("shard").applyInArrow(train, "i int, w double, one int")
    got = found.groupBy("i").agg(F.sum("w").alias("w"), F.sum("one").alias("shards")).toArrow()
    w, bias, shards = np.zeros(1 << BITS), 0.0, 0
    for i, v, one in zip(*[got.column(c).to_pylist() for c in ("i", "w", "shards")]):
        if i < 0:
            bias, shards = v, one
        else:
            w[i] = v
    return w / max(shards, 1), bias / max(shards, 1)


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``."""
    docs, labels = with_long_id(docs), with_long_id(labels)
    w, bias = fit(docs, labels, fit_rows)
    at = np.flatnonzero(w)
    shared = docs.sparkSession.sparkContext.broadcast((at, w[at], bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, bias = shared.value
        dense = np.zeros(1 << BITS)
        dense[at] = values
        heavy = dense != 0
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                total = []
                for f in features(B.texts(batch)):
                    f = np.unique(f[heavy[f]])
                    total.append(bias + float(dense[f].sum()))
                p = 1 / (1 + np.exp(-np.clip(np.array(total), -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))
    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")
