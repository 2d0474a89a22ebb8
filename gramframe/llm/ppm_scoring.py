"""Operator 10, language-model scoring by prediction by partial matching, with a word-count base.

The model reads a document as its words (ASCII white space separates them, A-Z lower-cased) joined
by one space and an end symbol, i.e. the same events as the word-count base score. The trie's counts come from
every training document. Blocks count their distinct n-grams and words once and send them to
the key buckets, n-grams by their whole context and words by hash, so no ending is one bucket's. One
level of buckets holds the n-grams of one context length; it sends their sums under one byte less of
context to the next level, down to contexts of two bytes. The 2-grams (at most 65,536) and the
word totals are summed once by Spark and given to the last level. Answers go back level by level: a count
with its context's total and kinds, and the log probability below it; a level adds its own escapes and
exclusions. Blocks get a log probability or a count for each distinct key and add them up over whole
texts. No row count reaches the driver but the text size.

Defined results: null and empty texts have one token, the end; a null doc_id counts as the empty
text for the split (training). Word keys are 64-bit hashes; log probabilities travel as float32.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from . import blocks as B
from .names import with_long_id
from .ppm import END, SYMBOLS, _groups, grams
from .windows import mix

ORDER = 5  # bytes of the longest context
FOLDS, HELD_OUT = 5, 1
_WORDS, _KINDS = SYMBOLS * SYMBOLS, SYMBOLS * SYMBOLS + 1  # after the 2-grams: uses and kinds of training words
BLOCK_BYTES = 3 << 20  # an n-gram is a 64-bit number inside a task
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def fold(doc_id: int | None, folds: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def _read(docs: pa.Table, order: int, folds: int, held: int):
    """(held-out flags, n-grams of all documents, their number per document; word numbers, words per
    document, hashes of the distinct words in ascending order)."""
    out = [fold(x, folds) == held for x in docs.column("doc_id").to_pylist()]
    pad, end = bytes([END]) * order, bytes([END])
    stream, numbers, sizes, number = [], [], [], {}
    for x in B.texts(docs):
        w = x.lower().split()
        body = b" ".join(w)
        stream += (pad, body, end)
        sizes.append((len(body) + 1, len(w)))
        numbers.append(np.array([number.setdefault(y, len(number)) for y in w], np.int32))
    data = np.frombuffer(b"".join(stream), np.uint8)
    n_bytes, n_words = np.array(sizes, np.int64).reshape(-1, 2).T
    # n-grams that end in a document's padding belong to none
    own = np.ones(len(data) - order, bool) if len(data) else np.zeros(0, bool)
    starts = np.cumsum(n_bytes + order) - (n_bytes + order)
    for j in range(1, order + 1):
        own[starts[1:] - j] = False
    h = np.array([xxh3_64_intdigest(y) for y in number], np.uint64)
    rank = np.argsort(h, kind="stable")
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    words = place[np.concatenate(numbers)] if number else np.zeros(0, np.int64)
    return np.array(out, bool), grams(data, order)[own], n_bytes, words, n_words, h[rank]


def _bucket_of_gram(g: np.ndarray, ng: int) -> np.ndarray:
    return B.bucket_of(mix(g >> np.uint64(8)), ng)


def _counted(values: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of the block and their counts among training positions, by one sort."""
    both = np.sort(values << np.uint64(1) | train)
    keys = both >> np.uint64(1)
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    counts = np.add.reduceat((both & np.uint64(1)).astype(np.int64), at) if len(keys) else at
    return keys[at], counts


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys of all messages in ascending order, their counts, each message's places among them."""
    every = np.unique(np.concatenate(keys))
    total = np.zeros(len(every), np.int64)
    places = []
    for k, c in zip(keys, counts):
        at = np.searchsorted(every, k)
        total[at] += c.astype(np.int64)  # a key stands once in a message
        places.append(at)
    return every, total, places


def _routed(keys: np.ndarray, n: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Order of the keys by bucket, and each bucket's slice of that order."""
    b = _bucket_of_gram(keys, n)
    go = np.argsort(b, kind="stable")
    return go, B.slices(b[go], n)


def _ratio(x: np.ndarray, y: np.ndarray, where: np.ndarray) -> np.ndarray:
    """log10(x / y) where stated, else 0."""
    return np.log10(np.divide(x, y, out=np.ones(len(where)), where=where))


def _open(c: np.ndarray, total: np.ndarray, kinds: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """log10 probability of n-grams when nothing is excluded from their contexts."""
    seen = total > 0
    return _ratio(np.where(c > 0, c, kinds), total + kinds, seen) + np.where(c > 0, 0.0, rest)


def _level(keys: np.ndarray, c: np.ndarray, under: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """(count, total and kinds of the context, log10 probability after an escape from it) of each of
    the sorted n-grams; ``under`` has the same of the n-grams with one byte less of context."""
    c1, total1, kinds1, rest1 = under
    ctx = keys >> np.uint64(8)
    new = np.append(True, ctx[1:] != ctx[:-1])
    at, group = np.flatnonzero(new), np.cumsum(new) - 1
    total, kinds, lost = (np.add.reduceat(x, at)[group] for x in (c, (c > 0).astype(np.int64), np.where(c > 0, c1, 0)))
    t, d = total1 - lost, kinds1 - kinds
    kept = _ratio(np.where(c1 > 0, c1, d), t + d, (c == 0) & (d > 0)) + np.where(c1 > 0, 0.0, rest1)
    return c, total, kinds, np.where(c > 0, 0.0, np.where(total > 0, kept, _open(c1, total1, kinds1, rest1)))


def _lowest(pairs: np.ndarray) -> tuple[np.ndarray, ...]:
    """``_level`` of all 65,536 2-grams."""
    ones = pairs.reshape(SYMBOLS, SYMBOLS).sum(axis=0)
    total, kinds = ones.sum(), (ones > 0).sum()
    rest = np.where(ones > 0, 0.0, -np.log10(max(SYMBOLS - kinds, 1)))
    under = tuple(np.tile(x, SYMBOLS) for x in (ones, np.full(SYMBOLS, total), np.full(SYMBOLS, kinds), rest))
    return _level(np.arange(SYMBOLS * SYMBOLS, dtype=np.uint64), pairs, under)


def _shorter(keys: np.ndarray, m: int) -> np.ndarray:
    """n-grams of order ``m`` with one byte less of context."""
    return keys & np.uint64((1 << 8 * m) - 1)


def score(docs: DataFrame, order: int = ORDER, folds: int = FOLDS, held: int = HELD_OUT) -> DataFrame:
    """One row per document: the split, token counts, the word-count base and the trie's log10 probability."""
    if not 2 <= order <= 6:
        raise ValueError("order must be 2 to 6")
    docs = with_long_id(docs.select("doc_id", "text"))
    nb = B.block_count(docs, block_bytes=BLOCK_BYTES)
    ng = B.bucket_count(nb)
    nl = B.bucket_count(ng)  # of each level under the longest contexts
    blocks = B.to_blocks(docs, nb, ["doc_id", "text"])

    def send(b, table):
        out, gram, n_bytes, word, n_words, wk = _read(table, order, folds, held)
        gk, gc = _counted(gram, ~np.repeat(out, n_bytes))
        wc = np.bincount(word[~np.repeat(out, n_words)], minlength=len(wk))
        go, cuts = _routed(gk, ng)
        rows = []
        for g, ((a, z), (c, e)) in enumerate(zip(cuts, B.slices(B.bucket_of(wk, ng), ng))):
            if z > a or e > c:
                k = gk[go[a:z]]
                rows.append((g, b, B.dump(np.diff(k, prepend=np.uint64(0)), gc[go[a:z]].astype(np.uint32),
                                          np.diff(wk[c:e], prepend=np.uint64(0)), wc[c:e].astype(np.uint32))))
        return B.message(rows)

    def parts_of(got):
        parts = [B.load(x) for _, x in got]
        return parts, *_merged([np.cumsum(p[0], dtype=np.uint64) for p in parts], [p[1] for p in parts])

    def words_of(parts):
        return _merged([np.cumsum(p[2], dtype=np.uint64) for p in parts], [p[3] for p in parts])

    def sums_of(m, parts):
        """Uses and kinds of training words, counted in the buckets of the longest contexts."""
        if m < order:
            return np.sum([p[2] for p in parts], axis=0)
        uses = words_of(parts)[1]
        return np.array([uses.sum(), (uses > 0).sum()], np.int64)

    def up(m):
        def run(g, got):
            parts, keys, counts, _ = parts_of(got)
            sums = sums_of(m, parts)
            low, total = _groups(_shorter(keys, m), counts)
            go, cuts = _routed(low, nl)
            rows = []
            for to, (a, z) in enumerate(cuts):
                mine = to == g % nl
                if z > a or mine:
                    rows.append((to, g, B.dump(np.diff(low[go[a:z]], prepend=np.uint64(0)), total[go[a:z]].astype(np.uint64),
                                               sums if mine else np.zeros(2, np.int64))))
            return B.message(rows)
        return run

    def lowest(g, got):
        parts, keys, counts, _ = parts_of(got)
        pairs, total = _groups(_shorter(keys, 2), counts)
        return pa.table({"key": pa.array(np.append(pairs.astype(np.int64), [_WORDS, _KINDS]).astype(np.int32)),
                         "n": pa.array(np.append(total, sums_of(2, parts)))})

    def down(m):
        def run(g, got, table):
            if not got:
                return B.message([])
            parts, keys, counts, places = parts_of(got)
            short = _shorter(keys, m)
            if m == 2:
                pairs = np.zeros(_KINDS + 1, np.int64)
                pairs[table.column("keys")[0].values.to_numpy()] = table.column("ns")[0].values.to_numpy()
                n_docs = pairs[:_WORDS].reshape(SYMBOLS, SYMBOLS)[:, END].sum()
                totals = np.array([pairs[_WORDS], n_docs, pairs[_KINDS]], np.int64)
                at, under = short.astype(np.int64), _lowest(pairs[:_WORDS])
            else:
                answers = [B.load(x) for _, x in B.received(table)]
                totals = answers[0][4]
                low, at = np.unique(short, return_inverse=True)
                place = np.empty(len(low), np.int64)
                place[_routed(low, nl)[0]] = np.arange(len(low))
                under, at = [np.concatenate([p[i] for p in answers]) for i in range(4)], place[at]
            found = _level(keys, counts, tuple(x[at] for x in under)) if len(keys) else tuple(x[:0] for x in under)
            if m < order:
                return B.message([(src, g, B.dump(*[x[at] for x in found], totals)) for (src, _), at in zip(got, places)])
            logs = _open(*found).astype(np.float32)
            _, uses, at_words = words_of(parts)
            return B.message([(src, g, B.dump(logs[at], uses[w].astype(np.uint64), totals))
                              for (src, _), at, w in zip(got, places, at_words)])
        return run

    sent = {order: B.per_block(blocks, send, B.MESSAGE)}
    n_of = {m: ng if m == order else nl for m in range(2, order + 1)}
    for m in range(order, 2, -1):
        sent[m - 1] = B.per_bucket(sent[m], n_of[m], up(m))
    # one row of at most 65,538 sums, given to every bucket of the last level
    pairs = B.per_bucket(sent[2], n_of[2], lowest, "key int, n long").groupBy("key").agg(F.sum("n").alias("n"))
    one = pairs.agg(F.collect_list(F.struct("key", "n")).alias("p"))
    answers = one.select(F.explode(F.sequence(F.lit(0), F.lit(n_of[2] - 1))).alias("dest"), F.col("p.key").alias("keys"), F.col("p.n").alias("ns"))
    for m in range(2, order + 1):
        answers = B.per_bucket_with(sent[m], n_of[m], answers, down(m))

    def finish(b, table, got):
        if table is None:
            return pa.table({c: pa.array([], t) for c, t in _COLUMNS.items()})
        out, gram, n_bytes, word, n_words, wk = _read(table, order, folds, held)
        parts = [B.load(x) for _, x in got]
        rank = np.argsort(gram)
        ranked = gram[rank]
        new = np.append(True, ranked[1:] != ranked[:-1])
        gk = ranked[new]
        go = np.argsort(_bucket_of_gram(gk, ng), kind="stable")
        logs = np.empty(len(gk))
        logs[go] = np.concatenate([p[0] for p in parts])
        uses = np.concatenate([p[1] for p in parts]).astype(np.float64)
        corpus_words, corpus_docs = int(parts[0][2][0]), int(parts[0][2][1])
        kinds = int(parts[0][2][2]) + (corpus_docs > 0)
        total = corpus_words + corpus_docs
        per_byte = np.empty(len(gram))
        per_byte[rank] = logs[np.cumsum(new) - 1]
        del rank, ranked, new
        c = uses[word]
        below = total + 0.5 * (kinds + 1)
        base = _sums(np.log10((c + 0.5) / below), n_words) + np.log10((corpus_docs + 0.5) / below)
        known = _sums((c > 0).astype(np.float64), n_words).astype(np.int64) + (corpus_docs > 0)
        n = len(out)
        return pa.table({"doc_id": table.column("doc_id"), "held_out": pa.array(out), "n_tokens": pa.array(n_words + 1),
                         "n_known": pa.array(known), "train_tokens": pa.array(np.full(n, total, np.int64)),
                         "base_score": pa.array(base), "score": pa.array(_sums(per_byte, n_bytes))})

    return B.per_block_with(blocks, nb, answers, finish, SCHEMA)


_COLUMNS = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(),
            "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each document's values; documents without values get 0."""
    out = np.zeros(len(sizes))
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return out
