"""Operator 1 against brute force with several hundred lists, hot vectors and repeated ids."""

from __future__ import annotations

import numpy as np
import pytest

from gramframe.llm.posting_lists import EXPAND, CentroidGraph, ListIndex, nearest


def _brute(ids, vecs, q_id, q_vec, k=20):
    s = (vecs * q_vec).sum(axis=1)
    best: dict[int, float] = {}
    for i, x in zip(ids, s):
        if i != q_id:
            best[i] = max(x, best.get(i, -np.inf))
    return sorted(best.items(), key=lambda r: (-r[1], r[0]))[:k]


@pytest.mark.parametrize("kind", ["clusters", "norms"])
def test_reads_few_rows_and_finds_nearly_all(spark, kind):
    rng = np.random.default_rng(3)
    n, d = 12000, 16
    if kind == "clusters":
        vecs = rng.normal(size=(100, d))[rng.integers(0, 100, n)] + 0.4 * rng.normal(size=(n, d))
    else:
        vecs = rng.normal(size=(n, d)) * rng.lognormal(0, 0.5, n)[:, None]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    got: dict[int, list] = {}
    read = {}
    for r in nearest(table, every=60).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        read[r.query_id] = r.n_read
    assert sorted(got) == list(range(0, n, 60))
    hits = 0
    for q, found in got.items():
        want = dict(_brute(range(n), vecs, q, vecs[q]))
        hits += len(want.keys() & dict(found).keys())
        assert len(found) == 20 and all(abs(x - vecs[i] @ vecs[q]) < 1e-9 for i, x in found)
        assert found == sorted(found, key=lambda r: (-r[1], r[0]))
    assert hits >= 0.9 * 20 * len(got)
    assert np.mean(list(read.values())) < 0.35 * n


def test_hot_vectors_repeated_ids_and_extra_columns(spark):
    rng = np.random.default_rng(4)
    vecs = rng.integers(-3, 4, size=(600, 6)).astype(float)
    vecs[(vecs == 0).all(axis=1)] = 1
    vecs[::3] = vecs[0]  # a third of all rows are one vector
    rows = [(i, v.tolist(), i) for i, v in enumerate(vecs)]
    rows += [(40, [5.0] * 6, 1), (40, [5.0] * 6, 1), (41, [4.0] * 6, 2), (60, [9.0, 1.0], 0)]  # second vectors of three ids, a short one
    table = spark.createDataFrame(rows, "vec_id int, embedding array<double>, list int").selectExpr("*", "1 as q", "2 as h", "3 as n_read", "4 as ids")
    got: dict[int, list] = {}
    for r in nearest(table).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    padded = {(i, tuple(v + [0.0] * (6 - len(v)))) for i, v, _ in rows}
    ids, all_vecs = [i for i, _ in padded], np.array([v for _, v in padded])
    assert sorted(got) == list(range(0, 600, 20))
    hits = 0
    for q, found in got.items():
        best: dict[int, float] = {}
        for own in all_vecs[[i == q for i in ids]]:
            for i, x in _brute(ids, all_vecs, q, own):
                best[i] = max(x, best.get(i, -np.inf))
        want = sorted(best.items(), key=lambda r: (-r[1], r[0]))[:20]
        hits += len({i for i, _ in want} & {i for i, _ in found})
        assert len(found) == 20 and q not in dict(found)
    assert hits >= 0.9 * 20 * len(got)


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_few_vectors(spark, n):
    rows = [(20 * i, [1.0 + i, 2.0]) for i in range(n)] + [(7, None)]
    out = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(out) == n * (n - 1)
    assert out == [] or {r.rank for r in out} == set(range(1, n))


def test_graph_search_finds_the_nearest_centroids():
    rng = np.random.default_rng(6)
    centroids, x = rng.normal(size=(700, 12)), rng.normal(size=(64, 12))
    node, dist = CentroidGraph(centroids).search(x, 40)
    assert node.shape == (64, 40) and (np.diff(dist, axis=1) >= 0).all()
    exact = np.sqrt(((x[:, None] - centroids[None]) ** 2).sum(axis=2))
    assert np.allclose(np.take_along_axis(exact, node, 1), dist)
    found = [len(set(a[:10]) & set(b[:10])) for a, b in zip(node, np.argsort(exact, axis=1))]
    assert np.mean(found) > 9.5


def test_a_query_reaches_enough_rows_beyond_its_beam():
    index = ListIndex(np.random.default_rng(7).normal(size=(300, 5)), 10.0)
    index.rows = np.zeros(300)
    index.rows[[3, 250]] = 60
    index.beam, index.ratio = EXPAND, 1.0
    rows, lists = index.choose(np.random.default_rng(8).normal(size=(5, 4)), 84)
    assert sorted(zip(rows.tolist(), lists.tolist())) == [(i, j) for i in range(5) for j in (3, 250)]
