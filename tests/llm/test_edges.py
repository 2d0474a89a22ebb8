"""Integer ids of other widths and clashing column names give the results of the plain table."""

from __future__ import annotations

import pytest

ROWS = [(1, "alpha beta gamma delta " * 20), (2, "alpha beta gamma delta " * 20), (3, None), (None, ""), (4, "one\ntwo lines\nthree lines here\nfour"),
        (5, "one\ntwo lines\nthree lines here\nfive"), (5, "idiot text of a repeated id"), (6, "x" * 300_000 + " tail")]
CLASH = "doc_id int, text string, b int, blob string, __starts string, __d0 int, n_tokens string"


def _tables(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string")
    odd = spark.createDataFrame([(i, t, 9, "x", "keep me", 8, "y") for i, t in ROWS], CLASH)
    return plain, odd


@pytest.mark.parametrize("name", ["suffix", "automaton", "ppm", "toxicity", "bpe", "simhash"])
def test_int_ids_and_clashing_names(spark, name):
    from gramframe.llm import automaton_dedup, bpe, ppm_scoring, simhash_dup, suffix_dedup, toxicity
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 7)], "doc_id int, toxic int")
    run = {"suffix": lambda d: suffix_dedup.remove_repeated_bytes(d).drop("spans"), "automaton": automaton_dedup.remove_repeated_words,
           "ppm": ppm_scoring.score, "toxicity": lambda d: toxicity.score(d, labels), "bpe": bpe.encode, "simhash": simhash_dup.near_duplicates}[name]
    plain, odd = _tables(spark)
    want, got = (sorted(map(tuple, run(d).collect()), key=str) for d in (plain, odd))
    assert got == want and len(got) == len(ROWS)


def test_encode_carries_columns_of_any_name(spark):
    from gramframe.llm.bpe import encode
    _, odd = _tables(spark)
    out = encode(odd, extra=["b", "blob", "__starts", "n_tokens"])
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "b", "blob", "__starts"]
    assert {(r.b, r.blob, r["__starts"]) for r in out.collect()} == {(9, "x", "keep me")}


def test_line_dedup_keeps_columns_of_any_name(spark):
    from gramframe.llm.line_dedup import delete_repeated_runs
    plain, odd = _tables(spark)
    got = delete_repeated_runs(odd)
    assert got.columns == [*odd.columns, "n_lines", "n_deleted", "n_runs"] and {r["__starts"] for r in got.collect()} == {"keep me"}
    both = [sorted(((r.doc_id, r.text, r.n_deleted, r.n_runs) for r in x.collect()), key=str) for x in (got, delete_repeated_runs(plain))]
    assert both[0] == both[1]
