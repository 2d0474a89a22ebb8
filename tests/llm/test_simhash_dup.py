"""Operator 11 against brute force: fingerprints by the definition, all pairs by popcount."""

from __future__ import annotations

import numpy as np
import xxhash


def _fingerprint(text, size):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(rows):
    """Smallest id reachable; rows (id, fingerprint), ids linked by equal id or 2 bits."""
    up = {i: i for i, _ in rows if i is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    known = [(i, f) for i, f in rows if i is not None]
    for n, (i, f) in enumerate(known):
        for j, g in known[:n]:
            if bin(f ^ g).count("1") <= 2:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: top(i) for i in up}


def test_fingerprints_and_components(spark, monkeypatch):
    from gramframe.llm import simhash_dup
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(i, base.replace(f"word{7 * i}", "changed")) for i in range(30)]
    rows += [(100 + i, " ".join(f"t{i}x{j}" for j in range(5 + i))) for i in range(20)]
    rows += [(None, base), (900, None), (901, ""), (902, " \n "), (903, "Two Words"), (903, "two words"), (904, "TWO words"),
             (905, "é ü É"), (3, base), (3, base), (906, base), (906, "two words"), (907, "a b c\x0bd")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id int, text string, fp int, rep int").repartition(3)
    monkeypatch.setattr(simhash_dup, "PIECE", 64)  # every longer text is read in pieces
    monkeypatch.setattr(simhash_dup, "LIST", 4)
    want = [(i, _fingerprint(t, 3)) for i, t in rows]
    root = _components(want)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash_dup.near_duplicates(docs, shingle=3).collect()), key=str)
    assert got == sorted(((i, f"{f:016x}", root.get(i)) for i, f in want), key=str)
    assert simhash_dup.near_duplicates(docs.where("false")).collect() == []


def _planted(rng, n):
    """Fingerprints with a dense cluster (six and four bytes shared) and random ones with neighbours."""
    centre = rng.integers(0, 1 << 63, dtype=np.uint64)
    dense = centre ^ rng.integers(0, 1 << 16, n, dtype=np.uint64)
    wide = centre ^ (rng.integers(0, 1 << 32, n, dtype=np.uint64) & np.uint64(0x11111111))
    free = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    near = free ^ np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64) ^ np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
    return np.unique(np.concatenate([dense, wide, free, near]))


def test_index_finds_every_link(spark):
    """No link lost in short, long and very long lists; the result does not depend on the split."""
    from gramframe.llm import simhash_dup as s
    fps = _planted(np.random.default_rng(3), 500)
    reps = spark.createDataFrame([(int(f.view(np.int64)), i) for i, f in enumerate(fps)], "fp long, rep long")
    want = set()
    for i in range(len(fps)):
        want.update((i, int(j)) for j in np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= 2) + i + 1)
    a, b = (np.array(x) for x in zip(*sorted(want)))
    roots = set(zip(*(x.tolist() for x in s.forest(a, b))))
    assert len(roots) > 700
    for n in (len(fps), 10 ** 9):  # lists refined before the shuffle, lists refined in the task
        lists = s.postings(reps, n)
        key = np.array([(r.key, r.fp, r.rep) for r in lists.collect()], np.int64)
        key = key[np.argsort(key[:, 0], kind="stable")]
        x, y = s.links(key[:, 0].view(np.uint64), key[:, 1].view(np.uint64))
        found = {(min(p, q), max(p, q)) for p, q in zip(key[x, 2].tolist(), key[y, 2].tolist()) if p != q}
        assert found == want
        edges = [(r.a, r.b) for r in s.listed_links(lists, 3).collect()]
        x, y = (np.array(v, np.int64) for v in zip(*edges))
        assert set(zip(*(v.tolist() for v in s.forest(x, y)))) == roots
        assert len(edges) <= 3 * len(fps)


def test_units_cover_all_wrong_bytes():
    from gramframe.llm import simhash_dup as s
    for wrong in s.WRONG:
        assert any(wrong in s._open_bytes(n) for n in range(len(s.UNITS)))
