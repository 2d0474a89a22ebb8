"""Operator 2, MinHash near-duplicates by a multi-index Hamming join.

A document's signature has ``CHUNKS * WIDTH`` codes of 16 bits, the low bits of the minima of as many
hash functions over its shingles. The signature distance of two documents is the number of codes in
which they differ. The signature is split into chunks; by the pigeonhole principle two signatures
that differ in at most ``CHUNKS * (ERRORS + 1) - 1`` codes have a chunk with at most ``ERRORS``
differing codes. Each chunk is therefore entered once for every choice of ``ERRORS`` codes that
may be wrong, with these masked: all pairs within that distance share an entry (40 entries per document
at 8 chunks of 5 codes with 1 error). At a Jaccard similarity of 0.8 a pair shares none with
probability 0.263 ** 8, about 2 in 100,000.

Sharing an entry only makes a candidate; links are confirmed on the full shingle sets. Documents with
equal sets are folded first. Within an entry every member is paired with the least member, so
groups of copies cost a star, not all pairs; components of the confirmed links follow, and then
every remaining pair of members that still lie in different components is confirmed too, so no link
is lost to the star: pairs of small entries one by one, those of hot entries in blocks of documents
(``hot_links``). Entries are folded per partition before the shuffle, groups are salted.

Shingles are compared by 64-bit hashes. Defined results: documents without words or text have an empty
set and no links; a null doc_id takes no part (component null, kept); rows with one doc_id are one
node of the graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ..session import cut_lineage
from . import blocks as B
from .graph import components
from .windows import mix, window_hash

SHINGLE, PERCENT = 5, 80
CHUNKS, WIDTH, ERRORS = 8, 5, 1
GROUP = 256  # members of a confirmation group
SMALL, BLOCK = 32, 512  # members of an entry whose pairs are listed; documents of a block of a hot cluster
_CODES = CHUNKS * WIDTH
_A = mix(np.arange(1, _CODES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_B = mix(np.arange(1, _CODES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all texts end to end, their number per text)."""
    code: dict[bytes, int] = {}
    split = [x.lower().split() for x in texts]
    lens = np.array([len(w) for w in split], np.int64)
    flat = np.empty(int(lens.sum()), np.uint64)
    at = 0
    for w in split:
        for x in w:
            if x not in code:
                code[x] = xxh3_64_intdigest(x)
        flat[at:at + len(w)] = [code[x] for x in w]
        at += len(w)
    hashed = mix(window_hash(flat, size))
    sets, at = [], 0
    for n in lens.tolist():
        if n >= size:
            sets.append(np.unique(hashed[at:at + n - size + 1]))
        elif n:
            sets.append(mix(window_hash(flat[at:at + n], n) + np.uint64(n)))
        else:
            sets.append(np.zeros(0, np.uint64))
        at += n
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.array([len(x) for x in sets], np.int64)


def signatures(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Codes (documents x _CODES, uint16); rows of empty sets are 0."""
    out = np.zeros((len(sizes), _CODES), np.uint16)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    at = (np.cumsum(sizes) - sizes)[some]
    for j in range(_CODES):
        h = (flat ^ _B[j]) * _A[j]
        h ^= h >> np.uint64(32)
        out[some, j] = (np.minimum.reduceat(h * _A[j], at) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def entries(codes: np.ndarray) -> np.ndarray:
    """Entry keys (documents x entries): chunk by chunk, each choice of one masked code."""
    wide = codes.astype(np.uint64)
    keys = []
    for c in range(CHUNKS):
        for masked in range(WIDTH):
            kept = [c * WIDTH + i for i in range(WIDTH) if i != masked]
            k = np.zeros(len(codes), np.uint64)
            for i in kept:
                k = k << np.uint64(16) | wide[:, i]
            keys.append(mix(k + np.uint64((c * WIDTH + masked) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))
    return np.stack(keys, axis=1)


def signed(docs: DataFrame, shingle: int, id_col: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, sig): set size, 128-bit digest of the set, signature."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                flat, sizes = shingle_sets(B.texts(batch), shingle)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat))])
                other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat ^ _B[0]))])
                sig = signatures(flat, sizes)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array(sizes), pa.array((total[ends[1:]] - total[ends[:-1]]).view(np.int64)),
                    pa.array((other[ends[1:]] - other[ends[:-1]]).view(np.int64)), pa.array([r.tobytes() for r in sig], pa.binary())],
                    ["doc_id", "n_shingles", "s1", "s2", "sig"])
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(sign, "doc_id long, n_shingles long, s1 long, s2 long, sig binary")


def _stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs (least member, member) of every entry with two or more, and the least member per entry."""
    order = np.lexsort((ids, keys))
    k, d = keys[order], ids[order]
    new = np.append(True, k[1:] != k[:-1]) if len(k) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    least = d[first][np.cumsum(new) - 1] if len(k) else d
    far = d != least
    return least[far], d[far], k[first], d[first]


def _counted_pairs(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    if not len(a):
        return a, b, n
    at = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    return a[at], b[at], np.add.reduceat(n, at)


PAIRS = "a long, b long, n long"


def star_pairs(reps: DataFrame, n_parts: int) -> DataFrame:
    """(a, b, n): a the least member of n entries that b is in, folded per partition, then per entry."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for src, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            codes = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, _CODES)
            keys = entries(codes)
            ids = np.repeat(batch.column("rep").to_numpy(zero_copy_only=False), keys.shape[1])
            a, b, k, d = _stars(keys.reshape(-1), ids)
            pairs = _counted_pairs(a, b, np.ones(len(a), np.int64))
            # pairs found here travel along with the entries; those of one hot least member go to all buckets
            to = B.bucket_of(mix(mix(pairs[0].view(np.uint64)) ^ pairs[1].view(np.uint64)), n_parts)
            go = np.argsort(to, kind="stable")
            rows = []
            for g, ((lo, hi), (p, q)) in enumerate(zip(B.slices(B.bucket_of(k, n_parts), n_parts), B.slices(to[go], n_parts))):
                if hi > lo or q > p:
                    rows.append((g, src, B.dump(np.diff(k[lo:hi], prepend=np.uint64(0)), d[lo:hi], *[x[go[p:q]] for x in pairs])))
            yield from B.message(rows).to_batches()

    def meet(g, got):
        parts = [B.load(x) for _, x in got]
        keys = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        a, b, _, _ = _stars(keys, np.concatenate([p[1] for p in parts]))
        a, b, n = _counted_pairs(np.concatenate([a, *[p[2] for p in parts]]), np.concatenate([b, *[p[3] for p in parts]]),
                                 np.concatenate([np.ones(len(a), np.int64), *[p[4] for p in parts]]))
        return pa.table({"a": a, "b": b, "n": n})

    sent = reps.select("rep", "sig").mapInArrow(send, B.MESSAGE)
    return B.per_bucket(sent, n_parts, meet, PAIRS).groupBy("a", "b").agg(F.sum("n").alias("n"))


def open_entries(reps: DataFrame, pairs: DataFrame, label: DataFrame, n_parts: int, percent: int) -> DataFrame:
    """What the stars left open: (a, b, hot). Of entries with up to ``SMALL`` members, the pairs in different
    components whose sizes admit a link (hot false); of larger ones a star of all members (hot true)."""
    touched = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    rows = reps.join(touched, "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    rows = rows.select("rep", "n_shingles", "sig", F.coalesce("root", "rep").alias("root"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for src, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            keys = entries(np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, _CODES))
            m = keys.shape[1]
            flat = keys.reshape(-1)
            order = np.argsort(flat, kind="stable")
            k = flat[order]
            ids, sizes, roots = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), m)[order] for c in ("rep", "n_shingles", "root"))
            rows = [(g, src, B.dump(np.diff(k[lo:hi], prepend=np.uint64(0)), ids[lo:hi], sizes[lo:hi], roots[lo:hi]))
                    for g, (lo, hi) in enumerate(B.slices(B.bucket_of(k, n_parts), n_parts)) if hi > lo]
            yield from B.message(rows).to_batches()

    def meet(g, got):
        parts = [B.load(x) for _, x in got]
        k = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        ids, sizes, roots = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        order = np.lexsort((ids, roots, k))
        k, ids, sizes, roots = k[order], ids[order], sizes[order], roots[order]
        new = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        near: set[tuple[int, int]] = set()
        hot: set[tuple[int, int]] = set()
        for lo, hi in zip(new.tolist(), np.append(new[1:], len(k)).tolist()):
            if hi - lo < 2 or roots[lo] == roots[hi - 1]:
                continue
            d, z, r = ids[lo:hi], sizes[lo:hi], roots[lo:hi]
            if len(d) > SMALL:
                least = int(d.min())
                hot.update((least, x) for x in d.tolist() if x != least)
                continue
            for i in range(len(d) - 1):
                j = np.searchsorted(r, r[i], side="right")  # members of later components
                fit = 100 * np.minimum(z[i], z[j:]) >= percent * np.maximum(z[i], z[j:])
                near.update((min(int(d[i]), x), max(int(d[i]), x)) for x in d[j:][fit].tolist())
        both = np.array(sorted(near) + sorted(hot), np.int64).reshape(-1, 2)
        return pa.table({"a": both[:, 0], "b": both[:, 1], "hot": pa.array([False] * len(near) + [True] * len(hot), pa.bool_())})

    return B.per_bucket(rows.mapInArrow(send, B.MESSAGE), n_parts, meet, "a long, b long, hot boolean").distinct()


GROUPED = "g long, k int, m int, asks boolean, root long, node long, set binary"


def _sets(roles: DataFrame, docs: DataFrame, shingle: int, id_col: str, text: str) -> DataFrame:
    """Rows of GROUPED: the shingle set of every (node, g, k, m, asks, root) of ``roles``, each text read once."""
    member = roles.groupBy("node").agg(F.collect_list(F.struct("g", "k", "m", "asks", "root")).alias("roles"))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("node"), F.col(f"`{text}`").alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                flat, sizes = shingle_sets(B.texts(batch), shingle)
                at = np.concatenate([[0], np.cumsum(sizes)])
                n_roles = [len(r) for r in batch.column("roles").to_pylist()]
                who = np.repeat(np.arange(batch.num_rows), n_roles)
                blobs = pa.array([flat[at[i]:at[i + 1]].tobytes() for i in range(batch.num_rows)], pa.binary())
                role = batch.column("roles").flatten().flatten()
                yield pa.RecordBatch.from_arrays([*role, batch.column("node").take(pa.array(who)), blobs.take(pa.array(who))],
                                                 ["g", "k", "m", "asks", "root", "node", "set"])

    return texts.join(member, "node").select("node", "text", "roles").mapInArrow(sets, GROUPED)


def confirmed(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int, id_col: str, text: str) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity; a's partners in salted groups."""
    counts = pairs.groupBy("a").agg(F.count("*").alias("n")).select("a", F.ceil(F.col("n") / GROUP).cast("int").alias("salts"))
    zero, none = F.lit(0), F.lit(0).cast("long")
    members = pairs.select("a", "b").join(counts, "a").select(F.col("b").alias("node"), F.col("a").alias("g"), F.pmod(F.xxhash64("b"), "salts").cast("int").alias("k"),
                                                zero.alias("m"), F.lit(False).alias("asks"), none.alias("root"))
    leads = counts.select(F.col("a").alias("node"), F.col("a").alias("g"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("k"),
                          zero.alias("m"), F.lit(True).alias("asks"), none.alias("root"))

    def compare(key, table):
        asks = table.column("asks").to_pylist()
        blobs = table.column("set").to_pylist()
        lead = [np.frombuffer(x, np.uint64) for x, one in zip(blobs, asks) if one]
        hit = []
        for node, x, one in zip(table.column("node").to_pylist(), blobs, asks):
            own = np.frombuffer(x, np.uint64)
            for other in [] if one else lead:
                common = len(np.intersect1d(other, own, assume_unique=True))
                if 100 * common >= percent * (len(other) + len(own) - common):
                    hit.append(node)
        return pa.table({"a": pa.array([key[0].as_py()] * len(hit), pa.int64()), "b": pa.array(hit, pa.int64())})

    return _sets(members.union(leads), docs, shingle, id_col, text).groupBy("g", "k").applyInArrow(compare, "a long, b long").distinct()


def hot_links(stars: DataFrame, label: DataFrame, docs: DataFrame, shingle: int, percent: int, id_col: str, text: str) -> DataFrame:
    """Links (a, b) between different components inside clusters of hot entries.

    Documents outside a cluster's largest component ask, all documents of the cluster answer; both
    sides are dealt in blocks, so every pair that could still join two components meets in one bounded
    group, where an inverted index counts common shingles. A group returns at most one link per asker and component."""
    cluster = components(stars).select("node", F.col("root").alias("g")).join(label, "node", "left").select("node", "g", F.coalesce("root", "node").alias("root"))
    cluster = cut_lineage(cluster)
    parts = cluster.groupBy("g", "root").agg(F.count("*").alias("n")).groupBy("g").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most"))
    parts = parts.select("g", F.col("most.root").alias("main"), F.ceil(F.col("n") / BLOCK).cast("int").alias("ms"),
                         F.ceil((F.col("n") - F.col("most.n")) / BLOCK).cast("int").alias("ks")).where("ks > 0")
    rows = cluster.join(parts, "g")
    answers = rows.select("node", "g", F.explode(F.sequence(F.lit(0), F.col("ks") - 1)).alias("k"),
                          F.pmod(F.xxhash64("node"), "ms").cast("int").alias("m"), F.lit(False).alias("asks"), "root")
    asks = rows.where("root <> main").select("node", "g", F.pmod(F.xxhash64("node", F.lit("ask")), "ks").cast("int").alias("k"),
                                             F.explode(F.sequence(F.lit(0), F.col("ms") - 1)).alias("m"), F.lit(True).alias("asks"), "root")

    def compare(key, table):
        asks = np.array(table.column("asks").to_pylist(), bool)
        nodes, roots = np.array(table.column("node").to_pylist(), np.int64), np.array(table.column("root").to_pylist(), np.int64)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        there = np.flatnonzero(~asks)
        if not asks.any() or not len(there):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        sizes = np.array([len(sets[i]) for i in there])
        values = np.concatenate([sets[i] for i in there])
        owner = np.repeat(np.arange(len(there)), sizes)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        out = set()
        for i in np.flatnonzero(asks):
            lo, hi = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
            n = hi - lo
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            common = np.bincount(owner[at], minlength=len(there))
            fits = np.flatnonzero((100 * common >= percent * (sizes + len(sets[i]) - common)) & (roots[there] != roots[i]))
            first: dict[int, int] = {}
            for j in fits.tolist():
                r = int(roots[there[j]])
                first[r] = min(first.get(r, int(nodes[there[j]])), int(nodes[there[j]]))
            out.update((min(int(nodes[i]), x), max(int(nodes[i]), x)) for x in first.values())
        both = np.array(sorted(out), np.int64).reshape(-1, 2)
        return pa.table({"a": both[:, 0], "b": both[:, 1]})

    grouped = _sets(answers.union(asks), docs, shingle, id_col, text)
    return grouped.groupBy("g", "k", "m").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``."""
    n_parts = max(4, B.block_count(docs, text, 32 << 20))
    sig = cut_lineage(signed(docs, shingle, id_col, text))
    by_set = sig.where("n_shingles > 0 and doc_id is not null")
    reps = cut_lineage(by_set.groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")))
    pairs = cut_lineage(star_pairs(reps, n_parts))
    # the two least members that a document meets most often settle nearly all groups
    best = W.partitionBy("b").orderBy(F.desc("n"), "a")
    tested = cut_lineage(pairs.withColumn("k", F.row_number().over(best)).where("k <= 2").select("a", "b"))
    links = cut_lineage(confirmed(tested, docs, shingle, percent, id_col, text))
    label = components(links)
    rest = cut_lineage(open_entries(reps, pairs, label, n_parts, percent))
    some = {r["hot"] for r in rest.select("hot").distinct().collect()}
    late = []
    if False in some:
        untested = rest.where("not hot").select("a", "b").join(tested, ["a", "b"], "left_anti")
        late.append(confirmed(untested, docs, shingle, percent, id_col, text))
    if True in some:
        late.append(hot_links(rest.where("hot"), label, docs, shingle, percent, id_col, text))
    for more in late:
        links = links.union(cut_lineage(more))
    if late:
        label = components(links)
    rows = sig.join(reps.select("n_shingles", "s1", "s2", "rep"), ["n_shingles", "s1", "s2"], "left")
    # a doc_id with several different sets links its classes; the smallest of them stands for all
    rows = rows.join(label.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("root", "rep")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(component)
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
