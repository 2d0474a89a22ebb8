"""Operator 5 against a plain version of its rule: runs of three lines, or of 50 words in fewer."""

from __future__ import annotations

import re

import numpy as np

from gramframe.llm.line_dedup import delete_repeated_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _plain(docs):
    kept, first = {}, {}
    lines = {i: [x for x in t.split("\n") if WORD.search(x)] for i, t in docs}
    gone = {i: set() for i, _ in docs}
    for i, _ in sorted(docs):
        own = lines[i]
        for at in range(len(own)):
            for depth in (1, 2, 3):
                run = tuple(own[at:at + depth])
                if len(run) < depth or (depth < 3 and sum(len(WORD.findall(x)) for x in run) < 50):
                    continue
                if first.setdefault(run, (i, at)) != (i, at):
                    gone[i].update(range(at, at + depth))
    for i, t in docs:
        seq, out = -1, []
        for x in t.split("\n"):
            seq += bool(WORD.search(x))
            if not (WORD.search(x) and seq in gone[i]):
                out.append(x)
        runs = sum(s - 1 not in gone[i] for s in gone[i])
        kept[i] = (len(lines[i]), len(gone[i]), runs, "\n".join(out) if gone[i] else t)
    return kept


def test_runs_of_lines_and_words_match_a_plain_version(spark):
    rng = np.random.default_rng(9)
    pool = [" ".join(f"w{x}" for x in rng.integers(0, 400, size)) for size in (1, 2, 3, 5, 8, 24, 26, 30, 49, 50, 51, 80)] + ["", " \t", "50 words " * 25]
    docs = [(i, "\n".join(pool[j] if rng.random() < 0.8 else f"own {i} {k}" for k, j in enumerate(rng.integers(0, len(pool), rng.integers(1, 12))))) for i in range(120)]
    docs += [(200 + i, docs[0][1]) for i in range(40)]  # copies of one document
    docs += [(300 + i, "the common line") for i in range(100)] + [(500, "long line " * 40_000), (501, "x\n" + "long line " * 40_000)]
    got = {r.doc_id: (r.n_lines, r.n_deleted, r.n_runs, r.text) for r in delete_repeated_runs(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == _plain(docs)
    assert got[501][1] == 1 and got[500][1] == 0 and got[399][1] == 0


def test_query_and_pipeline_stage_share_one_rule(spark):
    import corpus_pipeline
    docs = spark.createDataFrame([(1, "a b " * 30 + "\nend", 9), (2, "start\n" + "a b " * 30, 9), (3, "start\nend", 9)], "doc_id long, text string, n_chars int")
    stage = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, docs, "").collect()}
    assert stage == {r.doc_id: r.text for r in delete_repeated_runs(docs).collect()} and stage[2] == "start"
