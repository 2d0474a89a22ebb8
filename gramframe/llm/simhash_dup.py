"""Operator 11, SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint of 64 bits is a row of eight positional bytes. Fingerprints that differ in at most ``BITS`` = 2
bits differ in at most 2 bytes, so they share at least ``LEAST`` = 6 of them at the same positions. That is the
count filter: pairs found in the index are tallied by their shared positional bytes, those that
reach the minimum are verified bit by bit.

Lists of a single positional byte would hold 1/256 of all documents each and make n^2 / 32 tallies, so a list
here is the intersection of four of them: the positions form four units of two bytes, two wrong bytes
spoil at most two units, hence every pair to be found meets in the list of at least one of the six choices of two units.
In lists of up to ``LIST`` members all pairs are tallied over the other four positions. Longer lists are
refined by two more positions (the tally's minimum): again no pair is lost, and as six bytes are fixed such a list
has at most 65,536 different members, each of which looks up the 136 fingerprints within two bits of it. A document
thus costs at most 6 * LIST tallies or 36 * 136 lookups, however skewed the fingerprints are. Lists with more than
1/1000 of all rows (6,000 at most, so that their keys can be broadcast) are refined before the shuffle, the others
inside the task that holds them.

Equal fingerprints are folded before the index. A task returns a spanning forest of the links it
verified, which keeps every component whole.

Defined results: null texts and texts without words have fingerprint zero and link like any other; a null doc_id takes
no part (component null); rows with one doc_id are one node, whatever their texts; repeated
rows are all returned; very long texts are read in pieces of ``PIECE`` bytes; an empty table gives no rows. Only the
id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..session import cut_lineage
from .blocks import texts
from .graph import components

SHINGLE, SEED, BITS, LEAST = 5, 42, 2, 6
LIST, HOT_SHARE = 64, 1000
PIECE, FLUSH, ROWS = 1 << 20, 1 << 18, 200_000
SPACE = re.compile(rb"[\x20\x09-\x0D]")

UNITS = list(itertools.combinations(range(4), 2))  # the two units of two bytes that a list fixes
WRONG = list(itertools.combinations(range(8), 2))  # the two bytes that a refined list leaves open
NEAR = np.array([1 << i for i in range(16)] + [1 << i | 1 << j for i, j in itertools.combinations(range(16), 2)], np.int64)


# ------------------------------------------------------------------ fingerprints
def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, piece by piece."""
    lo = 0
    while lo < len(text):
        stop = SPACE.search(text, lo + PIECE) if len(text) - lo > PIECE else None
        hi = stop.start() if stop else len(text)
        yield text[lo:hi].lower().split()
        lo = hi + 1


def _shingle_hashes(words: list[bytes], size: int) -> list[int]:
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    return [xxh64_intdigest(joined[lo:hi - 1], SEED) for lo, hi in zip([0, *ends], ends[size - 1:])]


def text_hashes(text: bytes, size: int) -> Iterator[list[int]]:
    """XXH64 of all shingles, repeats included; fewer words than ``size`` are one shingle."""
    tail: list[bytes] = []
    some = False
    for words in _pieces(text):
        words = tail + words
        if len(words) >= size:
            yield _shingle_hashes(words, size)
            some = True
            tail = words[len(words) - size + 1:]
        else:
            tail = words
    if tail and not some:
        yield _shingle_hashes(tail, len(tail))


def fingerprints(rows: list[bytes], size: int) -> np.ndarray:
    """uint64 per text: a bit is 1 where more than half the shingle hashes have it."""
    ones, total = np.zeros((len(rows), 64), np.int64), np.zeros(len(rows), np.int64)
    held: list[int] = []
    at: list[int] = []
    who: list[int] = []

    def flush() -> None:
        if held:
            bits = np.unpackbits(np.array(held, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            np.add.at(ones, who, np.add.reduceat(bits, at, axis=0, dtype=np.int64))
            np.add.at(total, who, np.diff([*at, len(held)]))
            held.clear()
            at.clear()
            who.clear()
    for i, text in enumerate(rows):
        for part in text_hashes(text, size):
            at.append(len(held))
            who.append(i)
            held += part
            if len(held) >= FLUSH:
                flush()
    flush()
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)


def fingerprinted(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, one row per row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(texts(batch), shingle).view(np.int64))], ["doc_id", "fp"])
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


# ------------------------------------------------------------------ the index
def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))


def _joined(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = F.shiftleft(out, 8).bitwiseOR(p)
    return out


def _list_keys(fp: Column) -> list[Column]:
    """The six lists of a fingerprint: number of the two units, their four bytes."""
    return [_joined([F.lit(n).cast("long"), *[_byte(fp, 2 * u + i) for u in units for i in (0, 1)]]) for n, units in enumerate(UNITS)]


def _open_bytes(n: int) -> list[tuple[int, int]]:
    fixed = {2 * u + i for u in UNITS[n] for i in (0, 1)}
    return [w for w in WRONG if not fixed & set(w)]


def _refined_key(fp: Column, wrong: tuple[int, int]) -> Column:
    return _joined([F.lit(1 + WRONG.index(wrong)).cast("long"), *[_byte(fp, i) for i in range(8) if i not in wrong]])


def postings(reps: DataFrame, n: int) -> DataFrame:
    """(key, fp, rep): every fingerprint in its lists, those of very long lists in the refined lists instead."""
    fp = F.col("fp")
    plain = reps.select("fp", "rep", F.explode(F.array(*_list_keys(fp))).alias("key"))
    bound = max(LIST, n // HOT_SHARE)
    # lists of more than n / 1000 of the 6 n rows: 6,000 keys at most
    hot = F.broadcast(cut_lineage(plain.groupBy("key").count().where(F.col("count") > bound).select("key")))
    of = F.shiftright(F.col("key"), 32)
    choices = F.when(of == 0, F.array(*[_refined_key(fp, w) for w in _open_bytes(0)]))
    for n_ in range(1, len(UNITS)):
        choices = choices.when(of == n_, F.array(*[_refined_key(fp, w) for w in _open_bytes(n_)]))
    refined = plain.join(hot, "key", "left_semi").select(F.explode(choices).alias("key"), "fp", "rep")
    return plain.join(hot, "key", "left_anti").select("key", "fp", "rep").unionByName(refined)


def _np_key(fp: np.ndarray, wrong: tuple[int, int]) -> np.ndarray:
    out = np.full(len(fp), 1 + WRONG.index(wrong), np.uint64)
    for i in range(8):
        if i not in wrong:
            out = out << np.uint64(8) | (fp >> np.uint64(8 * i) & np.uint64(255))
    return out


def verified(x: np.ndarray) -> np.ndarray:
    """Positions of the pairs (as XORs of fingerprints) that share enough positional bytes and differ in few enough bits."""
    tally = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    kept = np.flatnonzero(tally >= LEAST)
    return kept[np.bitwise_count(x[kept]) <= BITS]


def _short_lists(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) of all pairs inside lists of at most LIST members; keys ascend."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, LIST):
        same = np.flatnonzero(key[step:] == key[:-step])
        if not len(same):
            break
        hit = same[verified(fp[same] ^ fp[same + step])]
        a.append(hit)
        b.append(hit + step)
    return np.concatenate(a), np.concatenate(b)


def _refined_list(fp: np.ndarray, wrong: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Links inside one refined list of any length: lookups of all neighbours in the 16 open bits."""
    low = (fp >> np.uint64(8 * wrong[0]) & np.uint64(255) | (fp >> np.uint64(8 * wrong[1]) & np.uint64(255)) << np.uint64(8)).astype(np.int64)
    place = np.full(1 << 16, -1, np.int64)
    place[low] = np.arange(len(fp))
    a, b = [], []
    for mask in NEAR:
        other = place[low ^ mask]
        hit = np.flatnonzero(other > np.arange(len(fp)))
        a.append(hit)
        b.append(other[hit])
    # the same fingerprint may have come from two lists: tie all its places to the one looked up
    again = np.flatnonzero(place[low] != np.arange(len(fp)))
    return np.concatenate([*a, again]), np.concatenate([*b, place[low[again]]])


def links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) inside complete lists, given in ascending key order (non-empty)."""
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(first, len(key)))
    is_long = np.repeat(size > LIST, size)
    short = np.flatnonzero(~is_long)
    a, b = _short_lists(key[short], fp[short])
    found_a, found_b = [short[a]], [short[b]]
    for lo, n in zip(first[size > LIST].tolist(), size[size > LIST].tolist()):
        own, k = fp[lo:lo + n], int(key[lo])
        if k >> 48:
            a, b = _refined_list(own, WRONG[(k >> 48) - 1])
            found_a.append(lo + a)
            found_b.append(lo + b)
            continue
        for wrong in _open_bytes(k >> 32):
            sub = _np_key(own, wrong)
            order = np.argsort(sub, kind="stable")
            a, b = links(sub[order], own[order])
            found_a.append(lo + order[a])
            found_b.append(lo + order[b])
    return np.concatenate(found_a), np.concatenate(found_b)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest node, node) of every node that the links (a, b) tie to a smaller one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    up = np.arange(len(nodes))
    while True:
        p, q = up[x], up[y]
        open_ = p != q
        if not open_.any():
            break
        np.minimum.at(up, np.maximum(p, q)[open_], np.minimum(p, q)[open_])
        while not np.array_equal(up, up[up]):
            up = up[up]
    moved = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[up[moved]], nodes[moved]


def listed_links(lists: DataFrame, n_parts: int) -> DataFrame:
    """(a, b): a spanning forest of the verified links of every task's lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]

        def solve(cols: list[np.ndarray]) -> pa.RecordBatch:
            lo, hi = links(cols[0], cols[1]) if len(cols[0]) else (np.zeros(0, np.int64),) * 2
            a, b = forest(cols[2][lo], cols[2][hi])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        for batch in batches:
            own = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            rest = [np.concatenate([r, x.astype(r.dtype, copy=False)]) for r, x in zip(rest, own)]
            if len(rest[0]) >= ROWS:
                cut = int(np.searchsorted(rest[0], rest[0][-1]))  # the last list may go on
                yield solve([r[:cut] for r in rest])
                rest = [r[cut:] for r in rest]
        yield solve(rest)
    return lists.repartition(n_parts, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``."""
    rows = cut_lineage(fingerprinted(docs, shingle, id_col, text))
    named = rows.where("doc_id is not null")
    reps = cut_lineage(named.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    size = reps.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    edges = listed_links(postings(reps.select("fp", "rep"), size["n"]), max(4, -(-6 * size["n"] // ROWS)))
    # a doc_id with several fingerprints ties their classes together
    several = cut_lineage(named.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("doc_id"))
    if not several.isEmpty():
        tied = named.distinct().join(several, "doc_id", "left_semi").join(reps, "fp")
        edges = edges.union(tied.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    label = components(edges).withColumnRenamed("node", "rep")
    classes = reps.join(label, "rep", "left").select("fp", "n", F.coalesce("root", "rep").alias("root"))
    # classes with more than 1/1000 of all rows, 1,000 at most, go to their rows; the others meet them in a shuffle
    big = cut_lineage(classes.where(F.col("n") > size["rows"] // HOT_SHARE + 1).select("fp", "root"))
    out = rows.join(F.broadcast(big), "fp").unionByName(
        rows.join(F.broadcast(big), "fp", "left_anti").join(classes.select("fp", "root"), "fp", "left"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("component_id"))
