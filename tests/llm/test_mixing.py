"""Operator 8 against a plain version: exponent, epochs, budgets, prefix ends; clashing names, ties, hot sources."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import pytest


def _rows():
    rows = [(i, "w " * (1 + i % 7), f"s{min(i % 40, 5)}") for i in range(400)]
    rows += [(500, None, "s1"), (501, "", "empty"), (502, " \n", "empty"), (None, "a b c", None), (503, "a b", None), (3, "w w w w", "s3"), (3, "w w w w", "s3")]
    return rows


def _expected(rows, limit):
    tokens = [len((t or "").split()) for _, t, _ in rows]
    total, by = sum(tokens), defaultdict(int)
    for (_, _, s), n in zip(rows, tokens):
        by[s] += n
    shares = [n / total for n in by.values() if n]
    ratio = lambda p: (min(shares) / max(shares)) ** (p - 1)
    lo, hi = 0.0, 1.0
    if ratio(0) <= limit:
        hi = 0.0
    else:
        for _ in range(42):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if ratio(mid) <= limit else (mid, hi)
    out = []
    for s, n in by.items():
        epochs = round((n / total) ** (hi - 1) / max(shares) ** (hi - 1), 9) if n else 1.0
        whole = math.floor(epochs)
        rest = math.floor((epochs - whole) * n)
        own = []
        for (i, _, x), k in zip(rows, tokens):
            if x == s:
                text = "~".join(["mix", "none" if i is None else str(i), str(whole), "true" if s is None else "false", s or ""])
                own.append((int(hashlib.md5(text.encode()).hexdigest()[:15], 16), i, k))
        own.sort(key=lambda r: r[0])
        for place, i, k in own:
            upto = sum(x[2] for x in own if x[0] <= place)
            for e in range(whole + (rest > 0 and upto <= rest)):
                out.append((i, s, k, e))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [1.5, 2.0, 1e6])
@pytest.mark.parametrize("salted", [False, True])
def test_mix_equals_the_plain_version(spark, monkeypatch, limit, salted):
    from gramframe.llm import mixing
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)  # several blocks a source
    if salted:
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    docs = spark.createDataFrame([(i, t, s, 7, "x", 1, 2) for i, t, s in _rows()],
                                 "doc_id int, text string, source string, `end` int, full string, rest int, at int").repartition(3)
    got = mixing.mix(docs, max_epochs=limit)
    assert got.columns == [*docs.columns, "n_tokens", "epoch"]
    assert sorted(((r.doc_id, r.source, r.n_tokens, r.epoch) for r in got.collect()), key=str) == _expected(_rows(), limit)
    assert {(r["end"], r["full"]) for r in got.collect()} == {(7, "x")}


def test_texts_are_neither_shuffled_nor_broadcast(spark):
    from gramframe.llm.mixing import mix
    docs = spark.createDataFrame(_rows(), "doc_id long, text string, source string")
    plan = mix(docs)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        assert "text" not in line or "Exchange" not in line
    assert mix(docs.where("false")).collect() == []
