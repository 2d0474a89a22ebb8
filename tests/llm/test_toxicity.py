"""Operator 4: the trained weights against FTRL-proximal one coordinate at a time, and odd training rows."""

from __future__ import annotations

import math

import numpy as np
import pytest

from gramframe.llm import toxicity as tox


def _plain_ftrl(rows, labels, epochs):
    """Weights by the published update, coordinate by coordinate; None is the intercept (no penalty)."""
    z, n = {}, {}
    rare = math.sqrt(max(1.0, labels.count(0) / max(labels.count(1), 1)))

    def weight(i):
        zi, l1, l2 = z.get(i, 0.0), 0.0 if i is None else tox.L1, 0.0 if i is None else tox.L2
        if abs(zi) <= l1:
            return 0.0
        return -(zi - math.copysign(l1, zi)) / ((tox.BETA + math.sqrt(n.get(i, 0.0))) / tox.ALPHA + l2)

    order = np.random.default_rng(7).permutation(len(rows))
    for _ in range(epochs):
        for j in order:
            own = [*set(rows[j].tolist()), None]
            w = {i: weight(i) for i in own}
            g = (1 / (1 + math.exp(-sum(w.values()))) - labels[j]) * (rare if labels[j] else 1.0)
            for i in own:
                before = n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(before)) / tox.ALPHA * w[i]
    return {i: weight(i) for i in z}


@pytest.fixture
def corpus(monkeypatch):
    monkeypatch.setattr(tox, "L1", 2.0)  # so that a small table leaves weights
    rng = np.random.default_rng(2)
    texts, labels = [], []
    for i in range(240):
        w = [f"t{x}" for x in rng.integers(0, 50, 20)]
        if i % 3 == 0:
            w[4:6] = ["vile", "Scum!"]
        texts.append(" ".join(w))
        labels.append(int(i % 3 == 0))
    return texts, labels


def test_weights_equal_the_plain_update(corpus):
    texts, labels = corpus
    rows = tox.features([t.encode() for t in texts])
    w, bias = tox.ftrl(rows, np.array(labels, float), epochs=3)
    want = _plain_ftrl(rows, labels, 3)
    assert abs(bias - want.pop(None)) < 1e-9
    assert {int(i) for i in np.flatnonzero(w)} == {i for i, x in want.items() if x} and np.count_nonzero(w) < len(want) / 2
    assert max(abs(w[i] - x) for i, x in want.items()) < 1e-9


def test_scores_follow_from_the_weights(spark, corpus):
    texts, labels = corpus
    rows = list(enumerate(texts)) + [(3, "a second text of one id"), (3, "a second text of one id"), (900, None), (901, ""), (None, "vile scum"), (902, "w " * 200_000)]
    marks = [(i, y) for i, y in enumerate(labels)] + [(0, 0), (5, None), (None, 1), (6, 2), (900, 0)]
    docs, marked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    w, bias = tox.fit(docs, marked)
    again = tox.fit(docs.repartition(5), marked.repartition(3))
    assert np.array_equal(w, again[0]) and bias == again[1]  # the order of arrival does not matter
    got = tox.score(docs, marked).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), round(1 / (1 + math.exp(-(bias + sum(w[list(set(f.tolist()))])))), 9)) for (i, t), f in
                  zip(rows, tox.features([(t or "").encode() for _, t in rows])))
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in got) == want
    assert tox.score(docs.where("false"), marked).count() == 0
