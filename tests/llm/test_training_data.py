"""The training-data operators against brute force on small tables, edge cases included."""

from __future__ import annotations

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest

EDGE = [(None, "no id here"), (9001, None), (9002, ""), (9003, " \n\t "), (9004, "two words"), (9005, "two words")]


def _docs(spark):
    base = [
        "alpha beta gamma delta. " * 30, "one line here\nsecond line there\nthird line too\nfourth", "x",
        "one line here\nsecond line there\nthird line too\nother end", "w%d " * 1 % 3 + " ".join(f"word{i}" for i in range(200)),
        " ".join(f"word{i}" for i in range(10, 190)), " ".join(f"word{i}" if i % 40 else "edit" for i in range(200)),
        "ä é " + " ".join(f"Wört{i}" for i in range(120)), "idiot " * 3 + "plain text follows here",
    ]
    rows = [(i, t) for i, t in enumerate(base)] + [(i + 50, t) for i, t in enumerate(base[:4])] + EDGE
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    from gramframe.llm import blocks, suffix_dedup
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 2000)


def _cut(units, width, ids):
    """Removed flags of every sequence by the definition (windows that start in a smaller document)."""
    first = {}
    for i, u in sorted(zip(ids, units), key=lambda x: x[0]):
        for p in range(len(u) - width + 1):
            first.setdefault(tuple(u[p:p + width]), i)
    out = []
    for i, u in zip(ids, units):
        gone = [False] * len(u)
        for p in range(len(u) - width + 1):
            if first[tuple(u[p:p + width])] < i:
                gone[p:p + width] = [True] * width
        out.append(gone)
    return out


def test_repeated_bytes_and_words(spark):
    from gramframe.llm.automaton_dedup import remove_repeated_words
    from gramframe.llm.suffix_dedup import remove_repeated_bytes
    docs, rows = _docs(spark)
    order = [10 ** 9 if i is None else i for i, _ in rows]
    raw = [(t or "").encode() for _, t in rows]
    got = collections.defaultdict(list)
    for r in remove_repeated_bytes(docs).collect():
        got[r.doc_id].append((r.n_bytes, r.n_removed, r.kept_sha256))
    for (i, _), x, gone in zip(rows, raw, _cut(raw, 50, order)):
        assert (len(x), sum(gone), hashlib.sha256(bytes(c for c, g in zip(x, gone) if not g)).hexdigest()) in got[i]
    got = collections.defaultdict(list)
    for r in remove_repeated_words(docs).collect():
        got[r.doc_id].append((r.n_words, r.n_removed, r.kept_sha256))
    words = [x.split() for x in raw]
    for (i, _), w, gone in zip(rows, words, _cut(words, 50, order)):
        assert (len(w), sum(gone), hashlib.sha256(b" ".join(c for c, g in zip(w, gone) if not g)).hexdigest()) in got[i]


def test_maximal_repeats_list_all_occurrences():
    from gramframe.llm.suffix_dedup import maximal_repeats
    # ranks 0-2 share 60, ranks 1-2 share 70; rank 3 is apart
    found = maximal_repeats(np.array([0, 60, 70, 0]), np.array([1, 2, 3, 4]), np.array([5, 3, 4, 1]))
    assert sorted(found) == [(60, 0, 2, 3), (70, 1, 2, 3)]
    # equal left bytes: not maximal
    assert maximal_repeats(np.array([0, 60]), np.array([7, 7]), np.array([1, 2])) == []


def test_bpe_round_trip(spark):
    from tokenizers import Tokenizer

    from gramframe.llm.bpe import encode, tokenizer_path
    docs, rows = _docs(spark)
    tok = Tokenizer.from_file(tokenizer_path())
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode(docs).collect())
    want = collections.Counter()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))] += 1
    assert got == want


def test_ppm_is_a_distribution_and_base_is_exact(spark):
    from gramframe.llm.ppm import Trie, grams
    from gramframe.llm.ppm_scoring import score
    data = np.frombuffer(b"\xff\xffabracadabra\xff", np.uint8)
    k, c = np.unique(grams(data, 2), return_counts=True)
    pairs = np.bincount(data[1:-1].astype(np.int64) * 256 + data[2:], minlength=65536)
    trie = Trie(k, c, 2, pairs)
    for ctx in (b"ab", b"zz", b"ra"):
        keys = np.uint64(int.from_bytes(ctx, "big") << 8) | np.arange(256, dtype=np.uint64)
        assert abs((10 ** trie.log10(keys)).sum() - 1) < 1e-9
    docs, rows = _docs(spark)
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5
    counts, n = collections.Counter(), 0
    for i, t in rows:
        if fold(i) != 1:
            counts.update((t or "").encode().lower().split())
            n += 1
    total, kinds = sum(counts.values()) + n, len(counts) + 1
    got = {(r.doc_id, r.n_tokens): r for r in score(docs).collect()}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        r = got[i, len(w) + 1]
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w) + math.log10((n + 0.5) / (total + 0.5 * (kinds + 1)))
        assert r.train_tokens == total and abs(r.base_score - base) < 1e-6 and r.score < 0 and r.held_out == (fold(i) == 1)


def test_ppm_hot_ending_is_split_and_levels_agree_with_one_trie(spark, monkeypatch):
    from gramframe.llm import ppm_scoring
    from gramframe.llm.ppm import Trie, grams
    keys = np.arange(4096, dtype=np.uint64) << np.uint64(24) | np.uint64(0x6520FF)  # contexts that end in "e "
    assert np.bincount(ppm_scoring._bucket_of_gram(keys, 16), minlength=16).max() < 512
    monkeypatch.setattr(ppm_scoring, "BLOCK_BYTES", 500)
    docs, rows = _docs(spark)
    got = {(r.doc_id, r.n_tokens): r for r in ppm_scoring.score(docs).collect()}
    streams = [np.frombuffer(b"\xff" * 5 + b" ".join((t or "").encode().lower().split()) + b"\xff", np.uint8) for _, t in rows]
    trained = [x for x, (i, _) in zip(streams, rows) if ppm_scoring.fold(i, 5) != 1]
    k, c = np.unique(np.concatenate([grams(x, 5) for x in trained]), return_counts=True)
    pairs = np.zeros(65536, np.int64)
    np.add.at(pairs, (k & np.uint64(0xFFFF)).astype(np.int64), c)
    trie = Trie(k, c, 5, pairs)
    for x, (i, t) in zip(streams, rows):
        want = trie.log10(grams(x, 5)).sum()
        assert abs(got[i, len((t or "").encode().lower().split()) + 1].score - want) < 1e-5 * max(1, -want)


@pytest.mark.parametrize("small", [32, 2])
def test_near_duplicates(spark, monkeypatch, small):
    from gramframe.llm import near_dup
    monkeypatch.setattr(near_dup, "SMALL", small)
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 10 ** 6, 100)]
    rows = []
    for i in range(24):
        w = list(base)
        for p in rng.integers(0, 100, i % 6):
            w[p] = f"e{i}_{p}"
        rows.append((100 - i, " ".join(w)))
    rows += EDGE[1:] + [(9006, "A B c d e f"), (9007, "a b C d e f")]
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[p:p + 4]) for p in range(len(w) - 3)} if len(w) > 3 else ({tuple(w)} if w else set())
    ids = sorted(sets)
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in ids:
        for b in ids:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(rows + EDGE[:1], "doc_id long, text string")
    got = {r.doc_id: r for r in near_dup.near_duplicates(df, shingle=4).collect()}
    assert got[None].component_id is None and got[None].kept
    for i in ids:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), top(i), top(i) == i)


def test_components_of_chains_and_stars(spark, monkeypatch):
    from gramframe.llm import graph
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + j) for j in range(1, 50)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    for local in (200_000, 20):
        monkeypatch.setattr(graph, "LOCAL_EDGES", local)
        got = {r.node: r.root for r in graph.components(df).collect()}
        assert all(got[x] == (0 if x < 1000 else 1000) for e in edges for x in e)


def test_posting_lists_recall_and_ties(spark):
    from gramframe.llm.posting_lists import nearest
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(400, 16))
    vecs[100:160] = vecs[20]  # a group of copies
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)] + [(500, None), (520, [0.0] * 16), (540, [float("nan")] * 16), (560, [None] * 16), (None, [1.0] * 16)]
    got = collections.defaultdict(list)
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 400, 20))
    hits = 0
    for q, found in got.items():
        s = vecs @ vecs[q]
        want = sorted((-s[i], i) for i in range(400) if i != q)[:20]
        hits += len({i for _, i in want} & {i for i, _ in found})
        assert all(abs(x - s[i]) < 1e-9 for i, x in found) and len(found) == 20
    assert hits >= 0.9 * 20 * len(got)
    assert [i for i, _ in got[20]] == list(range(100, 120))


def test_toxicity_held_out(spark):
    from gramframe.llm.toxicity import score
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(300):
        w = [f"t{x}" for x in rng.integers(0, 60, 30)]
        bad = i % 4 == 0
        if bad:
            w[3], w[17] = "scum", "loser"
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += EDGE
    out = score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (1, None)], "doc_id long, toxic int")).collect()
    assert len(out) == len(rows)
    held = [r for r in out if r.held_out and r.doc_id < 300]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.95
    none = score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert {r.score for r in none} == {0.5}


def test_lines_quality_mix_edges(spark):
    from gramframe.llm.line_dedup import delete_repeated_runs
    from gramframe.llm.mixing import mix
    from gramframe.llm.quality_rules import quality
    docs, rows = _docs(spark)
    lines = {(r.doc_id, r.n_lines, r.n_deleted, r.text) for r in delete_repeated_runs(docs.selectExpr("doc_id", "text", "1 as n_runs")).collect()}
    assert (1, 4, 0, rows[1][1]) in lines and (3, 4, 3, "other end") in lines and (51, 4, 4, "") in lines and (9001, 0, 0, None) in lines
    q = {r.doc_id: r for r in quality(docs.selectExpr("doc_id", "text", "1 as kept")).collect()}
    assert q[9001].n_words == 0 and q[9001].base_failed and not q[9001].kept
    assert q[0].base_failed and q[0].n_repeat_words == 120
    src = docs.selectExpr("doc_id", "text", "case when doc_id < 5 then 'a' when doc_id < 60 then 'b' end as source", "7 as epoch")
    out = mix(src, max_epochs=2.0).collect()
    assert {r.doc_id for r in out} == {i for i, _ in rows} and max(r.epoch for r in out) <= 1
    for op in (delete_repeated_runs, quality, mix):
        assert op(src.where("doc_id = -1")).count() == 0


def test_line_stage_deletes_long_runs_of_one_or_two_lines(spark):
    import corpus_pipeline
    from gramframe.llm.line_dedup import delete_repeated_runs
    long, half = " ".join(f"l{i}" for i in range(50)), " ".join(f"h{i}" for i in range(25))
    rest = " ".join(f"r{i}" for i in range(25))
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd"), (3, f"{half}\n\n{rest}\ne"), (4, f"f\n{half}\n{rest}\ng"),
            (5, f"{half}\nh\n{rest}"), (6, long), (7, f"i\n{long}\nj\n{half}\n{rest}"), (8, "a\nk\nd"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, docs, "").collect()}
    assert got == dict(rows[:1] + [(2, "c\nd"), rows[2], (4, "f\ng"), rows[4], (7, "i\nj"), rows[7], rows[8]])
    runs = {r.doc_id: (r.n_deleted, r.n_runs) for r in delete_repeated_runs(docs, min_words=50).collect()}
    assert runs[4] == (2, 1) and runs[6] == (1, 1) and runs[7] == (3, 2) and runs[1] == (0, 0)


def test_exponent_meets_targets(spark):
    from gramframe.llm.mixing import exponent
    src = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "s string, tokens long")
    x = exponent(src, max_epochs=4.0)
    assert abs(100 ** (1 - x) - 4.0) < 1e-6
    x = exponent(src, target_entropy=1.0)
    p = np.array([1000, 100, 10]) / 1110
    w = p ** x / (p ** x).sum()
    assert abs(-(w * np.log(w)).sum() - 1.0) < 1e-6


def test_pipeline_stages(spark):
    import corpus_pipeline
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    n = docs.count()
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert 0 < len({r.doc_id for r in out}) <= n
    kept = corpus_pipeline.quality_stage(spark, docs, "")
    assert kept.columns == docs.columns
