"""Operator 1, nearest neighbours by inner product over balanced posting lists.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm, so that the largest inner
product is the smallest distance. Centroids, about ``LISTS`` times the square root of the number of vectors, are
fitted with a balance penalty on full lists, on a bounded sample (the only vectors that reach the driver) in which long vectors, the
likelier answers, are likelier too. A graph over the centroids (``DEGREE`` nearest of each, broadcast) is searched
best-first in memory, both to post vectors and to choose a query's lists.

A vector goes to its nearest list and, up to ``MAX_REPLICAS``, to lists within ``REPLICATE`` times that distance; of these
the ones that its earlier lists' residuals say least about come first, so that a query which misses one list may hit another. A
query reads, of the ``beam`` nearest lists that the graph search keeps, those within ``ratio`` times its smallest distance. Both
numbers are calibrated, not set: one pass over all vectors finds the true neighbours of ``CALIBRATION_QUERIES`` sampled
vectors, and of the pairs of beam and ratio that reach ``TARGET`` of them the one that reads fewest rows is taken. ``n_read`` says how
many posted rows a query's lists hold. In any case a query reads its nearest lists until they hold k other vectors for certain.

A list is split into parts of at most about ``PART`` rows and its queries into parts of about ``VISITS``; a task has one of each. Equal vectors
are folded on both sides: a vector stands for its ``k`` + 1 smallest ids (more can never be among anyone's k nearest), and
equal query vectors are searched once. Scores are recomputed in double precision from the original vectors.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component, and rows
without vec_id, take no part; rows with equal id and vector are one; vectors shorter than
the longest are compared as if padded with zeros; a query id with several vectors has one result, with the best score of each partner.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

K = 20
LISTS, MAX_LISTS, FIT_PER_LIST = 4.0, 4096, 24
SAMPLE_ROWS, SAMPLE_BYTES = 65536, 64 << 20
CALIBRATION_QUERIES, TARGET = 512, 0.95
NORM_POWER = 3  # a vector's chance to be in the fit sample grows with this power of its norm
PART, VISITS, SALTS = 4096, 32768, 16
DEGREE, EXPAND, POST_BEAM = 12, 8, 24
REPLICATE, MAX_REPLICAS = 1.1, 4


def usable(vec: Column) -> Column:
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vec.isNotNull() & (F.size(vec) > 0) & fine & F.exists(vec, lambda x: x != 0)


class CentroidGraph:
    """Centroids and the nearest centroids of each; best-first search from evenly spread entry nodes."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        c = len(centroids)
        self.entries = np.arange(0, c, max(1, int(np.sqrt(c))))
        # a ring keeps the graph connected whatever the nearest neighbours are
        ring = ((np.arange(c) + 1) % c)[:, None]
        near = [np.argsort(_distances(centroids[lo:lo + 512], centroids), axis=1, kind="stable")[:, 1:DEGREE + 1] for lo in range(0, c, 512)]
        self.near = np.concatenate([np.concatenate(near), ring], axis=1)

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest centroids found, nearest first, and their distances (-1 and infinite if fewer)."""
        n, c = len(x), len(self.centroids)
        if beam >= c:
            node = np.broadcast_to(np.arange(c), (n, c))
            dist = _distances(x, self.centroids)
        else:
            node, dist = self._best_first(x, beam)
        order = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(node, order, 1), np.take_along_axis(dist, order, 1)

    def _best_first(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(x), min(EXPAND, beam)
        seen = np.zeros((n, len(self.centroids)), bool)
        seen[:, self.entries] = True
        node = np.tile(self.entries, (n, 1))
        dist = _distances(x, self.centroids[self.entries])
        fresh = np.ones(dist.shape, bool)
        rows = np.arange(n)[:, None]
        while True:
            if dist.shape[1] > beam:
                best = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
                node, dist, fresh = (np.take_along_axis(a, best, 1) for a in (node, dist, fresh))
            ahead = np.where(fresh, dist, np.inf)
            pick = np.argpartition(ahead, min(width, ahead.shape[1]) - 1, axis=1)[:, :width]
            go = np.isfinite(np.take_along_axis(ahead, pick, 1))
            if not go.any():
                return node, dist
            np.put_along_axis(fresh, pick, False, axis=1)
            to = self.near[np.take_along_axis(node, pick, 1)]
            to = np.where(go[:, :, None], to, -1).reshape(n, -1)
            to = np.sort(np.where((to >= 0) & ~seen[rows, to], to, -1), axis=1)
            new = to >= 0
            new[:, 1:] &= to[:, 1:] != to[:, :-1]
            r, j = np.nonzero(new)
            at = to[r, j]
            seen[r, at] = True
            d = np.full(to.shape, np.inf)
            d[r, j] = np.sqrt(((x[r] - self.centroids[at]) ** 2).sum(axis=1))
            node, dist = np.concatenate([node, np.maximum(to, 0)], axis=1), np.concatenate([dist, d], axis=1)
            fresh = np.concatenate([fresh, new], axis=1)


class ListIndex:
    """Centroid graph with the rules that post vectors and choose a query's lists."""

    def __init__(self, centroids: np.ndarray, largest: float) -> None:
        self.graph, self.largest = CentroidGraph(centroids), largest
        self.beam, self.ratio = len(centroids), np.inf
        self.rows = np.zeros(len(centroids))  # posted rows of each list

    def post(self, v: np.ndarray) -> np.ndarray:
        """Lists of every vector, the nearest first, -1 where it has fewer."""
        x, c = _lifted(v, self.largest), self.graph.centroids
        node, dist = self.graph.search(x, POST_BEAM)
        cost = np.where(dist <= dist[:, :1] * REPLICATE, dist * dist, np.inf)
        out = np.full((len(x), MAX_REPLICAS), -1)
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for i in range(MAX_REPLICAS):
            some = np.isfinite(cost[rows, at])
            out[some, i] = node[some, at[some]]
            # a list whose residual points where this one's does adds little
            rest = x - c[node[rows, at]]
            rest /= np.maximum(np.sqrt((rest * rest).sum(1)), 1e-300)[:, None]
            cost = cost + ((x * rest).sum(1)[:, None] - np.einsum("nd,nbd->nb", rest, c[node])) ** 2
            cost[rows, at] = np.inf
            at = np.argmin(cost, axis=1)
        return out

    def _asked(self, v: np.ndarray) -> np.ndarray:
        """Only the direction of a query matters: it is scaled to the sphere of the lifted vectors."""
        return np.concatenate([v * (self.largest / np.sqrt((v * v).sum(1)))[:, None], np.zeros((len(v), 1))], axis=1)

    def calibrate(self, queries: np.ndarray, near: np.ndarray, owner: np.ndarray) -> None:
        """The beam and ratio that read fewest rows and find ``TARGET`` of the true neighbours ``near``
        (of query ``owner``) of sampled queries."""
        if not len(near):
            return
        d = _distances(self._asked(queries), self.graph.centroids)
        order = np.argsort(d, axis=1, kind="stable")
        place = np.argsort(order, axis=1, kind="stable")
        far = d / np.maximum(d.min(axis=1, keepdims=True), 1e-300)
        lists = np.concatenate([self.post(near[lo:lo + 512]) for lo in range(0, len(near), 512)])
        own = owner[:, None]
        ranks = np.where(lists >= 0, place[own, lists], d.shape[1]).min(axis=1)
        ratios = np.where(lists >= 0, far[own, lists], np.inf).min(axis=1)
        far, rows = np.take_along_axis(far, order, 1), self.rows[order]
        least = np.inf
        needed = int(np.ceil(TARGET * len(ranks)))
        for share in np.linspace(TARGET, 1, 12):
            beam = int(np.quantile(ranks, share, method="higher")) + 1
            ratio = np.partition(np.where(ranks < beam, ratios, np.inf), needed - 1)[needed - 1] * (1 + 1e-9)
            read = np.where(far[:, :beam] <= ratio, rows[:, :beam], 0).sum()
            if read < least:
                least, self.beam, self.ratio = read, beam, float(ratio)

    def choose(self, v: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, list) of all lists to read; ``least`` posted rows are reached wherever there are so many."""
        x = self._asked(v)
        out = []
        beam = self.beam
        rows = np.arange(len(x))
        while len(rows):
            node, dist = self.graph.search(x[rows], beam)
            held = np.where(np.isfinite(dist), self.rows[node], 0)
            full = held.sum(axis=1) >= least if beam < len(self.rows) else np.ones(len(rows), bool)
            wanted = (dist <= dist[:, :1] * self.ratio) | (np.cumsum(held, axis=1) - held < least)
            r, j = np.nonzero(wanted & (held > 0) & full[:, None])
            out.append((rows[r], node[r, j]))
            rows, beam = rows[~full], beam * 4
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def fit_centroids(sample: np.ndarray, n_lists: int, rounds: int = 8) -> np.ndarray:
    """Balanced k-means: the distance to a list grows with the rows it already holds."""
    n_lists = max(1, min(n_lists, len(sample)))
    centroids = sample[np.linspace(0, len(sample) - 1, n_lists).astype(np.int64)].copy()
    fair = len(sample) / n_lists
    sizes = np.full(n_lists, fair)
    for _ in range(rounds):
        fullness = (1 + 0.05 * np.maximum(sizes / fair - 1, 0))[None]
        own = np.concatenate([np.argmin(_distances(sample[lo:lo + 2048], centroids) * fullness, axis=1) for lo in range(0, len(sample), 2048)])
        sizes = np.bincount(own, minlength=n_lists).astype(np.float64)
        some = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[some].astype(np.int64)
        centroids[some] = np.add.reduceat(sample[np.argsort(own, kind="stable")], starts, axis=0) / sizes[some, None]
    return centroids


def _matrix(column, dims: int) -> np.ndarray:
    """Rows of an Arrow list column as doubles, padded with zeros."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(flat.offsets.to_numpy())
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), dims))
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = values
    return out


def _lifted(x: np.ndarray, largest: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(largest ** 2 - (x * x).sum(1), 0))[:, None]], axis=1)


def _fit(distinct: DataFrame, n: int, dims: int, largest: float) -> ListIndex:
    """Centroids from a sample in which a vector's chance grows with its norm."""
    n_lists = max(1, min(int(LISTS * n ** 0.5), MAX_LISTS, n // 8))
    most = max(64, min(FIT_PER_LIST * n_lists, SAMPLE_ROWS, SAMPLE_BYTES // (8 * (dims + 1))))
    u = (F.pmod(F.xxhash64("v"), F.lit(1 << 31)) + 0.5) / (1 << 31)
    weight = F.pow(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x) / largest ** 2, F.lit(NORM_POWER / 2))
    fit = distinct.orderBy(-F.log(u) / weight, F.col("ids")[0]).limit(most).select("v").toArrow()
    return ListIndex(fit_centroids(_lifted(_matrix(fit.column("v"), dims), largest), min(n_lists, max(1, fit.num_rows // 8))), largest)


def _neighbours(distinct: DataFrame, dims: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sampled vectors, and their ``k`` nearest others of all vectors by one pass over the table (vectors, owners)."""
    spark = distinct.sparkSession
    sample = distinct.orderBy(F.xxhash64(F.lit("query"), "v"), F.col("ids")[0]).limit(CALIBRATION_QUERIES).select("v").toArrow()
    queries = _matrix(sample.column("v"), dims)
    asked = spark.sparkContext.broadcast(queries)  # CALIBRATION_QUERIES vectors

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = asked.value
        score, have = np.full((len(q), k), -np.inf), np.zeros((len(q), k, dims))
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                v = _matrix(whole.column("v").slice(lo, 1024), dims)
                new = q @ v.T
                new[np.abs(new - (q * q).sum(axis=1)[:, None]) <= 1e-9 * (1 + np.abs(new))] = -np.inf  # itself, if among these
                both = np.concatenate([score, new], axis=1)
                top = np.argpartition(-both, k - 1, axis=1)[:, :k]
                old = top < k
                have = np.where(old[:, :, None], np.take_along_axis(have, np.where(old, top, 0)[:, :, None], 1), v[np.where(old, 0, top - k)])
                score = np.take_along_axis(both, top, 1)
        r, j = np.nonzero(np.isfinite(score))
        yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(score[r, j]), pa.array(have[r, j].tolist(), pa.list_(pa.float64()))], ["q", "score", "v"])

    found = distinct.select("v").mapInArrow(best, "q int, score double, v array<double>")
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), F.xxhash64("v")))
    near = found.withColumn("k", rank).where(F.col("k") <= k).select("q", "v").toArrow()  # CALIBRATION_QUERIES * k vectors at most
    return queries, _matrix(near.column("v"), dims), near.column("q").to_numpy().astype(np.int64)


def nearest(table: DataFrame, k: int = K, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, n_read): for every row whose id is divisible by ``every`` the ``k`` found
    nearest of all other rows, and the number of posted rows in the lists that were read for it."""
    spark = table.sparkSession
    vec = F.col(f"`{vec_col}`")
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vec.alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = rows.select("vec_id", F.transform("v", lambda x: x.cast("double")).alias("v"))
    first = W.partitionBy("v").orderBy("vec_id")
    held = rows.distinct().withColumn("k", F.row_number().over(first)).where(F.col("k") <= k + 1)
    distinct = cut_lineage(held.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    asked = rows.where(F.col("vec_id") % every == 0).distinct()
    # equal query vectors are one search, named by smallest id and hash
    folded = asked.groupBy("v").agg(F.min("vec_id").alias("q")).withColumn("h", F.xxhash64("v"))

    facts = distinct.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"),
                         F.max(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)).alias("norm")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, n_read long")
    n, dims, largest = facts["n"], facts["dims"], float(np.sqrt(facts["norm"]))
    index = _fit(distinct, n, dims, largest)
    posting = spark.sparkContext.broadcast(index)  # MAX_LISTS vectors at most

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                lists_ = posting.value.post(_matrix(batch.column("v"), dims))
                r, j = np.nonzero(lists_ >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(lists_[r, j].astype(np.int32)), batch.column("v").take(pa.array(r)), batch.column("ids").take(pa.array(r))], ["list", "v", "ids"])

    lists = cut_lineage(distinct.mapInArrow(post, "list int, v array<double>, ids array<long>"))
    counted = lists.groupBy("list").count().collect()  # one row per list, MAX_LISTS at most
    index.rows = np.zeros(len(index.rows))
    for r in counted:
        index.rows[r["list"]] = r["count"]
    index.calibrate(*_neighbours(distinct, dims, k))
    choosing = spark.sparkContext.broadcast(index)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                v = _matrix(batch.column("v"), dims)
                r, list_ = choosing.value.choose(v, MAX_REPLICAS * (k + 1))
                read = np.bincount(r, weights=choosing.value.rows[list_], minlength=len(v)).astype(np.int64)
                at = pa.array(r)
                yield pa.RecordBatch.from_arrays([pa.array(list_.astype(np.int32)), *[batch.column(c).take(at) for c in ("v", "q", "h")], pa.array(read[r])], ["list", "v", "q", "h", "n_read"])

    visits = cut_lineage(folded.mapInArrow(choose, "list int, v array<double>, q long, h long, n_read long"))
    visited = {r["list"]: r["count"] for r in visits.groupBy("list").count().collect()}
    parts = [(r["list"], -(-r["count"] // PART), -(-visited[r["list"]] // VISITS)) for r in counted if r["list"] in visited]
    parts = F.broadcast(spark.createDataFrame(parts, "list int, parts int, q_parts int"))

    def every_part(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count).cast("int") - 1))

    have = lists.join(parts, "list").select("list", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"), every_part("q_parts").alias("q_part"), "v", "ids")
    want = visits.join(parts, "list").select("list", every_part("parts").alias("part"), F.pmod("h", F.col("q_parts")).cast("int").alias("q_part"), "v", "q", "h")

    def search(key, left, right):
        out_q, out_h, out_v, out_s = [], [], [], []
        if left.num_rows and right.num_rows:
            have, ids = _matrix(left.column("v"), dims), left.column("ids").to_pylist()
            want, qs, hs = _matrix(right.column("v"), dims), right.column("q").to_pylist(), right.column("h").to_pylist()
            for lo in range(0, len(want), 256):
                rough = want[lo:lo + 256] @ have.T
                m = min(k + 1, rough.shape[1])
                cut = -np.partition(-rough, m - 1, axis=1)[:, m - 1]
                for i in range(len(rough)):
                    # all that may tie with the last one by the rough product, scored one by one alike
                    pick = np.flatnonzero(rough[i] >= cut[i] - 1e-9 * (1 + abs(cut[i])))
                    exact = (have[pick] * want[lo + i]).sum(axis=1)
                    found = sorted((-s, v) for s, p in zip(exact.tolist(), pick.tolist()) for v in ids[p])[:k + 1]
                    out_q += [qs[lo + i]] * len(found)
                    out_h += [hs[lo + i]] * len(found)
                    out_v += [v for _, v in found]
                    out_s += [-s for s, _ in found]
        return pa.table({"q": pa.array(out_q, pa.int64()), "h": pa.array(out_h, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    by = ["list", "part", "q_part"]
    found = have.groupBy(*by).cogroup(want.groupBy(*by)).applyInArrow(search, "q long, h long, vec_id long, score double")
    found = found.groupBy("q", "h", "vec_id").agg(F.max("score").alias("score"))
    near = found.withColumn("k", F.row_number().over(W.partitionBy("q", "h").orderBy(F.desc("score"), "vec_id"))).where(F.col("k") <= k + 1)
    near = near.groupBy("q", "h").agg(F.collect_list(F.struct("vec_id", "score")).alias("near"))
    read = visits.groupBy("q", "h").agg(F.max("n_read").alias("n_read"))
    # a vector's answer goes back to all query rows that hold it; a hot vector's rows are salted
    answers = folded.join(near, ["q", "h"]).join(read, ["q", "h"]).select("v", "near", "n_read", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = asked.select(F.col("vec_id").alias("query_id"), "v", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt"))
    pairs = salted.join(answers, ["v", "salt"]).select("query_id", "n_read", F.explode("near").alias("r")).select("query_id", "n_read", "r.*")
    best = pairs.where(F.col("vec_id") != F.col("query_id")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.max("n_read").alias("n_read"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "n_read")
