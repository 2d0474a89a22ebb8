"""Exchanges between blocks and key buckets: relays change the way of a message, never what arrives."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from gramframe.llm import blocks, ppm_scoring, suffix_dedup


def _arrived(df):
    return sorted((r.dest, r.src, r.n, r.total) for r in df.collect())


def test_relays_deliver_every_message_in_few_rows(spark, monkeypatch):
    n = 300
    def send(batches):
        rng = np.random.default_rng(1)
        for batch in batches:
            # destination 7 hears from every sender, most others from a third of them
            yield from blocks.message([(d, s, blocks.dump(np.array([s, d]))) for s in batch.column(0).to_pylist()
                                       for d in np.unique(np.append(rng.integers(0, n, 100), 7)).tolist()]).to_batches()
    def totals(dest, got):
        return pa.table({"dest": pa.array([dest] * len(got), pa.int32()), "src": pa.array([s for s, _ in got], pa.int32()),
                         "n": [len(got)] * len(got), "total": [int(blocks.load(b)[0].sum()) for _, b in got]})
    sent = spark.range(0, n, 1, 10).mapInArrow(send, blocks.MESSAGE).persist()
    schema = "dest int, src int, n long, total long"
    direct = _arrived(blocks.per_bucket(sent, n, totals, schema))
    monkeypatch.setattr(blocks, "DIRECT", 4)
    monkeypatch.setattr(blocks, "PARTITIONS", 5)
    relay = blocks.relayed(sent, n)
    assert relay.count() <= 18 * n < sent.count()  # one row per destination and relay that reaches it
    assert blocks._dealt(relay, n, "dest").rdd.getNumPartitions() <= 5
    assert _arrived(blocks.per_bucket(sent, n, totals, schema)) == direct and len(direct) == sent.count()
    sent.unpersist()


@pytest.mark.parametrize("name", ["bytes", "words", "bpe", "ppm"])
def test_operators_do_not_depend_on_the_way(spark, monkeypatch, name):
    from gramframe.llm.automaton_dedup import remove_repeated_words
    from gramframe.llm.bpe import encode
    from gramframe.llm.ppm_scoring import score
    from gramframe.llm.suffix_dedup import remove_repeated_bytes
    op = {"bytes": remove_repeated_bytes, "words": remove_repeated_words, "bpe": encode, "ppm": score}[name]
    rng = np.random.default_rng(3)
    passage = " ".join(f"shared{i}" for i in range(60))  # an anchor in a third of the documents, each time in another context
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 300, 80)) + (f" own{i} {passage} end{i}" if i % 3 == 0 else "")) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(6)] + [(None, "no id"), (200, None), (201, ""), (200, "one id, another text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for module in (blocks, ppm_scoring, suffix_dedup):
        monkeypatch.setattr(module, "BLOCK_BYTES", 1500)
    direct = sorted(map(str, op(docs).collect()))
    assert len(direct) == len(rows)
    monkeypatch.setattr(blocks, "DIRECT", 1)
    monkeypatch.setattr(blocks, "PARTITIONS", 3)
    assert sorted(map(str, op(docs).collect())) == direct
    assert op(docs.limit(0)).count() == 0
