"""Operator 7, BPE encoding and decoding through a distinct-word table.

Blocks list their distinct words (maximal runs without ASCII white space; the tokenizer's own rules
never join text across white space, and special-token strings contain none). Each word travels to
its key bucket, where every distinct word is encoded once by the public tokenizer; the ids return to
the blocks and are joined back by position. Decoding looks every id up in the id-to-piece table
(fixed size: the vocabulary) and joins the pieces as the tokenizer does.

Defined results: null and empty texts have no tokens. The tokenizer file is read on the driver and
sent as a broadcast of its fixed size (1.7 MB), so executors need no file.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from . import blocks as B
from .names import with_long_id

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_LOADED: dict = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _tokenizer(shared):
    """The tokenizer of this worker process, built once from the broadcast text."""
    if shared.id not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        t = Tokenizer.from_str(shared.value)
        t.no_truncation()
        t.no_padding()
        _LOADED[shared.id] = t
    return _LOADED[shared.id]


class _Shared:
    """A broadcast and its number (the worker's copy of a broadcast does not carry one)."""

    def __init__(self, spark, text: str) -> None:
        self.broadcast = spark.sparkContext.broadcast(text)
        self.id = f"{spark.sparkContext.applicationId}-{hashlib.sha256(text.encode()).hexdigest()[:16]}"

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self) -> str:
        return self.broadcast.value


def _words(docs: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(word number at every position, words of each document, distinct words ordered by hash)."""
    split = [x.split() for x in B.texts(docs)]
    number: dict[bytes, int] = {}
    flat = np.fromiter((number.setdefault(w, len(number)) for d in split for w in d), np.int64, sum(map(len, split)))
    words = list(number)
    h = np.array([xxh3_64_intdigest(w) for w in words], np.uint64)
    order = np.argsort(h, kind="stable")  # ties keep the order of the block's documents
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    return rank[flat] if len(flat) else flat, np.array([len(d) for d in split], np.int64), [words[i] for i in order], h[order]


def encode(docs: DataFrame, path: str | None = None, n_blocks: int | None = None, keep_ids: bool = False, extra: list[str] | None = None) -> DataFrame:
    """One row per document: token count and digests of ids and decoded text; with ``keep_ids`` also
    the ids (array<int>) and the decoded text, with ``extra`` further columns of ``docs``."""
    spark = docs.sparkSession
    with open(path or tokenizer_path(), encoding="utf-8") as f:  # the driver's own copy of a public file
        shared = _Shared(spark, f.read())
    docs = with_long_id(docs)
    # carried under names of their own; a column named like a result is replaced by the result
    own = {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} | ({"ids", "decoded"} if keep_ids else set())
    extra = [c for c in extra or [] if c not in own]
    types = [docs.schema[c].dataType.simpleString() for c in extra]
    docs = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"__x{i}") for i, c in enumerate(extra)])
    carried = [f"__x{i}" for i in range(len(extra))]
    nb = n_blocks or B.block_count(docs)
    ng = B.bucket_count(nb)
    blocks = B.to_blocks(docs, nb, ["doc_id", "text", *carried])

    def send(b, table):
        _, _, words, h = _words(table)
        rows = []
        for g, (lo, hi) in enumerate(B.slices(B.bucket_of(h, ng), ng)):
            if hi > lo:
                rows.append((g, b, B.dump(np.frombuffer(b" ".join(words[lo:hi]), np.uint8))))
        return B.message(rows)

    def answer(g, got):
        tok = _tokenizer(shared)
        lists = [B.load(x)[0].tobytes().split(b" ") for _, x in got]
        number: dict[bytes, int] = {}
        for words in lists:
            for w in words:
                number.setdefault(w, len(number))
        distinct = list(number)
        ids, sizes = [], np.empty(len(distinct), np.int64)
        for lo in range(0, len(distinct), 20_000):
            part = [w.decode("utf-8") for w in distinct[lo:lo + 20_000]]
            for i, e in enumerate(tok.encode_batch(part, add_special_tokens=False)):
                sizes[lo + i] = len(e.ids)
                ids.append(np.array(e.ids, np.uint32))
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        base = np.cumsum(sizes) - sizes
        rows = []
        for (src, _), words in zip(got, lists):
            at = np.fromiter((number[w] for w in words), np.int64, len(words))
            rows.append((src, g, B.dump(sizes[at].astype(np.uint32), flat[_expand(base[at], sizes[at])])))
        return B.message(rows)

    def finish(b, table, got):
        if table is None:
            return pa.table({n: pa.array([], t) for n, t in _COLUMNS.items()})
        tok = _tokenizer(shared)
        at, n_words, _, _ = _words(table)
        parts = [B.load(x) for _, x in got]
        sizes = np.concatenate([p[0] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
        pool = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint32)
        base = np.cumsum(sizes) - sizes
        # the id-to-piece join, once per distinct word of the block
        pieces = _pieces(shared, tok)
        digits = _digits(len(pieces))
        flat = pool.tolist()
        spans = list(zip(base.tolist(), (base + sizes).tolist()))
        word_ids = [" ".join([digits[i] for i in flat[a:z]]) for a, z in spans]
        word_pieces = [" ".join([pieces[i] for i in flat[a:z]]) for a, z in spans]
        counts, id_sha, text_sha, id_lists, decoded = [], [], [], [], []
        ends = np.cumsum(np.concatenate([[0], n_words]))
        silent = bool((sizes == 0).any())
        for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
            own = at[lo:hi]
            if silent:
                own = own[sizes[own] > 0]  # words without tokens take no separator
            counts.append(int(sizes[own].sum()))
            if keep_ids:
                id_lists.append(pool[_expand(base[own], sizes[own])].tolist())
            own = own.tolist()
            text = " ".join([word_pieces[i] for i in own])
            id_sha.append(hashlib.sha256(" ".join([word_ids[i] for i in own]).encode()).hexdigest())
            text_sha.append(hashlib.sha256(text.encode()).hexdigest())
            if keep_ids:
                decoded.append(text)
        cols = {"doc_id": table.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(id_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
        if keep_ids:
            cols |= {"ids": pa.array(id_lists, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
        return pa.table(cols | {c: table.column(f"__x{i}") for i, c in enumerate(extra)})

    schema = SCHEMA + (", ids array<int>, decoded string" if keep_ids else "")
    schema += "".join(f", `{c}` {t}" for c, t in zip(extra, types))
    return B.per_block_with(blocks, nb, B.per_bucket(B.per_block(blocks, send, B.MESSAGE), ng, answer), finish, schema)


_COLUMNS = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def _expand(base: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions base, base + 1, ... of every item."""
    return np.repeat(base - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _pieces(shared, tok) -> list[str]:
    key = (shared.id, "pieces")
    if key not in _LOADED:
        _LOADED[key] = [tok.id_to_token(i) or "" for i in range(tok.get_vocab_size(with_added_tokens=True))]
    return _LOADED[key]


def _digits(n: int) -> list[str]:
    key = ("digits", n)
    if key not in _LOADED:
        _LOADED[key] = [str(i) for i in range(n)]
    return _LOADED[key]
