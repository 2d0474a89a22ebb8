"""The whole pipeline against plain versions of its five stages, and each stage on odd tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from test_line_dedup import _plain as plain_lines
from test_mixing import _expected as plain_mix

import corpus_pipeline
from gramframe.llm.bpe import tokenizer_path
from gramframe.llm.quality_rules import NOTICES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _line_fails(line):
    ws, n = WORD.findall(line), len(WORD.findall(line))
    marks, bars = len(re.findall(r"[!?]", line)), len(re.findall(r"[|»›·]", line))
    return (len(re.findall(r"[#*$%&|<>]", line)) * 100 > len(line) * 8 or (marks >= 3 and marks * 3 >= n) or (bars >= 2 and bars * 4 >= n)
            or (n < 25 and any(p in line.lower() for p in NOTICES)) or (n >= 10 and len(set(ws)) * 4 < n)
            or (n < 3 and not line.strip(" \t\n\x0b\x0c\r").endswith(tuple(".!?:;。！？：；…"))))


def _quality(docs):
    out = []
    for i, text in docs:
        ws = WORD.findall(text or "")
        seen = Counter(tuple(ws[p:p + 3]) for p in range(len(ws) - 2))
        again = {p + o for p in range(len(ws) - 2) if seen[tuple(ws[p:p + 3])] > 1 for o in range(3)}
        clean = "\n".join(x for x in (text or "").split("\n") if WORD.search(x) and not _line_fails(x))
        lost = len(ws) - len(WORD.findall(clean))
        if len(ws) >= 50 and 100 * len(again) <= 50 * len(ws) and 100 * lost <= 50 * len(ws):
            out.append((i, clean))
    return out


def _near_dups(docs):
    sets = {}
    for i, text in docs:
        ws = WORD.findall(text.lower())
        sets[i] = {tuple(ws[p:p + 5]) for p in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())
    root = {i: i for i in sets}
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return [(i, t) for i, t in docs if root[i] == i]


def _corpus():
    rng = np.random.default_rng(11)
    sentence = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 3000, n)) + "."
    common = [sentence(60), sentence(9), sentence(9), sentence(9), "Home | News | Contact | About", "Read our privacy policy", "BUY NOW!!!", "Short", ""]
    docs = []
    for _ in range(70):
        lines = [sentence(int(rng.integers(8, 40))) for _ in range(int(rng.integers(2, 7)))]
        for j in rng.integers(0, len(common), int(rng.integers(0, 4))):
            lines.insert(int(rng.integers(0, len(lines) + 1)), common[j])
        if rng.random() < 0.2:
            lines += common[1:4]
        docs.append("\n".join(lines))
    docs += docs[:20]  # whole copies, then near ones: a word of each line changes
    docs += ["\n".join(x.replace("w1", f"v{k}", 1) for x in d.split("\n")) for k, d in enumerate(docs[20:40])]
    docs += [sentence(120) + "\n" + sentence(4)] * 30 + [None, "", " \n\t", "same three words " * 40, "Äußerst " + sentence(80), "W5 " * 3 + sentence(20_000)]
    order = rng.permutation(len(docs))
    return [(int(order[i]), t, f"s{min(i % 9, 3)}" if i % 11 else None) for i, t in enumerate(docs)]


def test_pipeline_equals_its_plain_stages(spark, tmp_path):
    from tokenizers import Tokenizer
    rows = _corpus()
    source = {i: s for i, _, s in rows}
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(
        4).write.parquet(str(tmp_path / "documents.parquet"))
    docs = _quality([(i, t) for i, t, _ in rows])
    assert 100 < len(docs) < len(rows)
    cut = plain_lines(docs)
    lined = [(i, cut[i][3]) for i, _ in docs if cut[i][1] == 0 or cut[i][1] < cut[i][0]]
    assert len(lined) < len(docs) and any(cut[i][1] for i, _ in lined)
    single = dict(_near_dups(lined))
    assert len(single) < len(lined)
    tok = Tokenizer.from_file(tokenizer_path())
    want = []
    for i, s, _, _ in plain_mix([(i, t, source[i]) for i, t in single.items()], corpus_pipeline.MAX_EPOCHS):
        ids = tok.encode(single[i], add_special_tokens=False).ids
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), tok.decode(ids, skip_special_tokens=False))]
        want.append((i, len(ids), *digest, s))
    assert len(want) > len(single)  # some documents are read twice
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "source"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


SCHEMA = ("doc_id int, text string, lang string, source string, n_chars int, kept boolean, n_tokens string, epoch string, cleaned_text string, "
          "__starts string, component_id string, rep string, root string, blob string, b int, n int, name string")


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_nulls_repeats_and_clashing_names(spark, stage):
    good = " ".join(f"w{i}" for i in range(60)) + "."
    other = " ".join(f"x{i}" for i in range(60)) + "."
    values = [(1, good), (1, good), (2, good), (3, None), (None, other), (None, None), (4, ""), (5, other + "\n" + good), (5, "y " + good), (6, "long words here " * 30_000 + ".")]
    docs = spark.createDataFrame([(i, t, None, None if k % 2 else "s", None, False, "t", "e", "c", "s", "k", "r", "o", "b", k, 1, "m") for k, (i, t) in enumerate(values)], SCHEMA)
    fn = dict(corpus_pipeline.STAGES)[stage]
    out = fn(spark, docs, "")
    got = Counter((r.doc_id, r["source"]) for r in out.collect())
    whole = Counter((i, None if k % 2 else "s") for k, (i, _) in enumerate(values))
    if stage == "bpe":
        assert got == whole
    else:
        assert out.columns == docs.columns
        assert {r.name for r in out.collect()} == {"m"}
        assert {r.kept for r in out.collect()} == {stage == "quality_rules"}  # there the operator's own column replaces it
    ids = Counter(i for (i, _), k in got.items() for _ in range(k))
    if stage == "quality_rules":  # rows without enough words go, whatever their id; copies are judged alike
        assert ids == Counter({1: 2, 2: 1, None: 1, 5: 2})
    if stage == "line_dedup":     # the later copies of a long line go, with documents that held nothing else
        assert ids == Counter({1: 2, 3: 1, None: 1, 4: 1, 5: 2, 6: 1})  # the null id comes last: its text is a later copy
    if stage == "minhash_near_dup":  # equal rows are one; a null id takes no part
        assert ids[1] == 1 and ids[2] == 0 and ids[None] == 2 and ids[3] == ids[4] == ids[6] == 1
    if stage == "mix_sources":    # every row at least once
        assert all(got[k] >= n for k, n in whole.items())
    assert fn(spark, docs.where("false"), "").count() == 0
