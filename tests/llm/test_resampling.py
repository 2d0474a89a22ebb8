"""Operator 12 against brute force with zlib and hashlib."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def _buckets(text):
    words = WORD.findall((text or "").translate(UPPER))
    return len(words), [zlib.crc32(" ".join(words[i:i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def _expected(rows, targets, percent=5):
    own = [(i, *_buckets(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in targets for b in _buckets(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in s}
    out, able = [], []
    for i, n, f in own:
        weight = sum(gain[b] for b in f)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if n >= 20:
                able.append((-score, i, len(out)))
        out.append([i, len(f), weight, score, None])
    for rank, (_, _, at) in enumerate(sorted(able)[:percent * len(able) // 100], 1):
        out[at][4] = rank
    return sorted(map(tuple, out), key=str)


def _rows():
    text = " ".join(f"Word{i % 40} ÄÖ{i % 7}x, don't-stop_{i};" for i in range(60))
    rows = [(i, text[i:] + f" only {i}") for i in range(40)] + [(100 + i, "benchmark words here " * 10) for i in range(5)]
    return rows + [(7, rows_text := "short"), (7, rows_text), (None, text), (None, None), (500, None), (501, ""), (502, "..."), (503, "one"),
                   (504, "x" * 700 + " " + "y" * 300 + " z"), (505, "中文" * 200 + "\x00a\x7fB"), (100, "benchmark words here " * 10)]


def test_resample_equals_brute_force(spark, monkeypatch):
    from gramframe.llm import resampling as r
    rows, targets = _rows(), ["Benchmark words here", None, "", "only benchmark Words"]
    docs = spark.createDataFrame([(i, t, 5, "w") for i, t in rows], "doc_id int, text string, score int, row string").repartition(3)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(targets)], "item_id long, text string")
    got = sorted((tuple(x) for x in r.resample(docs, bench, percent=20).collect()), key=str)
    assert got == _expected(rows, targets, 20)
    assert sum(x[4] is not None for x in got) == 9
    for name, value in (("PIECE", 40), ("FLUSH", 50), ("LONG", 12), ("CELLS", 300)):  # pieces and pure functions in this process
        monkeypatch.setattr(r, name, value)
    for _, t in rows:
        text = (t or "").encode()
        buckets = []
        for words, first, carried, _ in r._flushes([text]):
            for bucket, which, _ in r._run_buckets(words, first, carried):
                buckets += bucket[which].tolist()
        assert Counter(buckets) == Counter(_buckets(t)[1])


def test_empty_tables(spark):
    from gramframe.llm.resampling import resample
    docs = spark.createDataFrame(_rows(), "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert resample(docs.where("false"), bench).collect() == []
    got = sorted((tuple(x) for x in resample(docs, bench).collect()), key=str)
    assert got == _expected(_rows(), [])


def test_kth_largest_with_ties_and_wide_values(spark):
    from gramframe.llm.resampling import kth_largest
    rng = np.random.default_rng(1)
    values = [*rng.integers(-10 ** 14, 10 ** 14, 200).tolist(), *rng.integers(0, 5, 200).tolist()]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 37, 150, 300, 400):
        assert kth_largest(rows, "v", k) == sorted(values, reverse=True)[k - 1]
