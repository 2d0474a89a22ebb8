"""Which windows of a document also start in a document with a smaller id: the shared flow of the
byte-level and word-level span removers.

Five exchanges, none of them of single rows:

1. documents to blocks (packed text);
2. each block sends its distinct contexts (``windows.contexts``) as (anchor key, context hash,
   smallest id in the block) to the key's bucket;
3. the bucket answers every context: *seen* (a smaller id holds the identical context), *open* (the
   anchor occurs with other contexts too, so parts of it may repeat) or *own*;
4. blocks send the symbols of open contexts, one per distinct context, back to the bucket, where
   the operator's own structure (``solve``: suffix array or suffix automaton) marks the windows
   that occur in a smaller document;
5. answers return to the blocks, which cut the covered symbols out of the whole texts.

Contexts count as identical when their 64-bit anchor keys and their 64-bit context hashes both agree; their symbols
are not compared (128 hashed bits: of 10 million contexts of one anchor two different ones agree with a
probability of 3 in a million). Windows inside open contexts are compared as symbols by ``solve``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B
from .windows import contexts

OWN, SEEN, OPEN = 0, 1, 2


@dataclass(frozen=True)
class Repeats:
    """``symbols(docs) -> (symbols uint64, starts, lens, state)``; ``solve(symbols, starts, nwin,
    ids, keys, width) -> bool array over all windows``; ``cut(docs, state, starts, lens, removed)``
    builds the result rows from the mask of removed symbols."""

    width: int
    gram: int
    symbols: Callable
    solve: Callable
    cut: Callable
    schema: str
    block_bytes: int = 6 << 20
    share: int = 2  # blocks per key bucket
    wire: Callable | None = None  # state -> the symbols as they travel and reach ``solve``, if narrower


def _distinct(sym, starts, lens, ids, spec):
    """Contexts of a block and its distinct ones, ordered by key: (contexts, owner of each,
    positions of the representatives, their smallest id)."""
    c = contexts(sym, starts, lens, spec.width, spec.gram)
    own = ids[c["doc"]]
    order = np.argsort(c["ctx"], kind="stable")
    if not len(order):
        z = np.zeros(0, np.int64)
        return c, own, z, z, z
    x = c["ctx"][order]
    new = np.append(True, x[1:] != x[:-1])
    at = np.flatnonzero(new)
    least = np.minimum.reduceat(own[order], at)
    cls = np.empty(len(order), np.int64)
    cls[order] = np.cumsum(new) - 1
    # the representative of a class: its first context in the document with the smallest id
    rep = np.full(len(at), len(order), np.int64)
    mine = np.flatnonzero(own == least[cls])
    np.minimum.at(rep, cls[mine], mine)
    rank = np.lexsort((c["ctx"][rep], c["key"][rep]))
    back = np.empty(len(rank), np.int64)
    back[rank] = np.arange(len(rank))
    return c, own, back[cls], rep[rank], least[rank]


def remove_repeats(docs: DataFrame, spec: Repeats) -> DataFrame:
    """Rows of ``spec.schema``, one per row of ``docs`` (doc_id, text)."""
    nb = B.block_count(docs, block_bytes=spec.block_bytes)
    ng = B.bucket_count(nb, spec.share)
    blocks = B.to_blocks(docs, nb, ["doc_id", "text"])

    def send_contexts(b, table):
        ids = B.doc_ids(table)
        sym, starts, lens, _ = spec.symbols(table)
        c, _, _, rep, least = _distinct(sym, starts, lens, ids, spec)
        key, ctx = c["key"][rep], c["ctx"][rep]
        rows = []
        for g, (lo, hi) in enumerate(B.slices(B.bucket_of(key, ng), ng)):
            if hi > lo:
                step = np.diff(key[lo:hi], prepend=np.uint64(0))
                rows.append((g, b, B.dump(step, ctx[lo:hi], least[lo:hi])))
        return B.message(rows)

    def answer(g, got):
        parts = [B.load(blob) for _, blob in got]
        key = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        ctx, doc = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
        ends = np.cumsum([len(p[0]) for p in parts])
        parts = [len(p[0]) for p in parts]
        order = np.lexsort((ctx, key))
        k, x, d = key[order], ctx[order], doc[order]
        del key, ctx, doc
        new_key = np.append(True, k[1:] != k[:-1])
        new_ctx = new_key | np.append(True, x[1:] != x[:-1])
        at = np.flatnonzero(new_ctx)
        least = np.minimum.reduceat(d, at)[np.cumsum(new_ctx) - 1]
        ka = np.flatnonzero(new_key)
        ki = np.cumsum(new_key) - 1
        several = np.add.reduceat(new_ctx.astype(np.int64), ka) > 1
        spread = np.minimum.reduceat(d, ka) != np.maximum.reduceat(d, ka)
        code = np.empty(len(order), np.uint8)
        code[order] = np.where(d > least, SEEN, np.where((several & spread)[ki], OPEN, OWN))
        return B.message([(src, g, B.dump(code[e - n:e])) for (src, _), n, e in zip(got, parts, ends)])

    def send_open(b, table, got):
        if table is None:
            return B.message([])
        ids = B.doc_ids(table)
        sym, starts, lens, state = spec.symbols(table)
        wire = sym if spec.wire is None else spec.wire(state)
        c, own, cls, rep, least = _distinct(sym, starts, lens, ids, spec)
        code = np.concatenate([B.load(x)[0] for _, x in got]) if got else np.zeros(0, np.uint8)
        # an occurrence in a later document than the class's smallest is seen in any case
        seen = (own > least[cls]) | (code[cls] == SEEN) if len(cls) else np.zeros(0, bool)
        rows = []
        pick = np.flatnonzero(code == OPEN)
        key = c["key"][rep[pick]]
        nwin = c["last"][rep[pick]] - c["first"][rep[pick]] + 1
        size = nwin + spec.width - 1
        for g, (lo, hi) in enumerate(B.slices(B.bucket_of(key, ng), ng)):
            if hi > lo:
                n = size[lo:hi]
                at = np.repeat(c["first"][rep[pick[lo:hi]]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                rows.append((g, b, B.dump(key[lo:hi], least[pick[lo:hi]], nwin[lo:hi].astype(np.uint8), wire[at])))
        # what this block already knows travels through the same exchange, addressed to itself
        here = np.flatnonzero((code[cls] == OPEN) & ~seen) if len(cls) else np.zeros(0, np.int64)
        number = np.cumsum(code == OPEN) - 1
        rows.append((ng + b, b, B.dump(*_runs(c["first"][seen], c["last"][seen]), c["first"][here], number[cls[here]] if len(here) else here, nwin.astype(np.uint8))))
        return B.message(rows)

    def solve(g, got):
        if g >= ng:
            return B.message([(g - ng, -1, got[0][1])])
        parts = [B.load(blob) for _, blob in got]
        key, doc, nwin, sym = (np.concatenate([p[i] for p in parts]) for i in range(4))
        nwin = nwin.astype(np.int64)
        size = nwin + spec.width - 1
        mark = spec.solve(sym, np.cumsum(size) - size, nwin, doc, key, spec.width)
        rows, at = [], 0
        for (src, _), p in zip(got, parts):
            n = int(p[2].astype(np.int64).sum())
            rows.append((src, g, B.dump(np.packbits(mark[at:at + n]), np.array([n]))))
            at += n
        return B.message(rows)

    def finish(b, table, got):
        if table is None:
            return spec.cut(None, None, None, None, None)
        sym, starts, lens, state = spec.symbols(table)
        edge = np.zeros(int(lens.sum()) + 1, np.int32)
        known = [B.load(x) for src, x in got if src < 0]
        if known:
            first, last, here, number, nwin = known[0]
            np.add.at(edge, first, 1)
            np.add.at(edge, last + spec.width, -1)
            bits = [B.load(x) for src, x in got if src >= 0]
            mark = np.concatenate([np.unpackbits(p[0])[:int(p[1][0])] for p in bits]) if bits else np.zeros(0, np.uint8)
            nwin = nwin.astype(np.int64)
            base = np.cumsum(nwin) - nwin
            n = nwin[number] if len(number) else number
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hit = mark[np.repeat(base[number] if len(number) else number, n) + k] > 0
            pos = (np.repeat(here, n) + k)[hit]
            np.add.at(edge, pos, 1)
            np.add.at(edge, pos + spec.width, -1)
        return spec.cut(table, state, starts, lens, np.cumsum(edge[:-1]) > 0)

    asked = B.per_block(blocks, send_contexts, B.MESSAGE)
    coded = B.per_bucket(asked, ng, answer)
    opened = B.per_block_with(blocks, nb, coded, send_open, B.MESSAGE)
    solved = B.per_bucket(opened, ng + nb, solve)
    return B.per_block_with(blocks, nb, solved, finish, spec.schema)


def _runs(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adjacent window ranges joined (contexts of one document follow each other)."""
    if not len(first):
        return first, last
    new = np.append(True, first[1:] != last[:-1] + 1)
    at = np.flatnonzero(new)
    return first[at], last[np.append(at[1:], len(first)) - 1]


def runs_of(mask: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(removed symbols, maximal removed runs) of each document."""
    total = np.concatenate([[0], np.cumsum(mask)])
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    inner = starts[(lens > 0)]
    begins[inner] = mask[inner]
    count = np.concatenate([[0], np.cumsum(begins)])
    return total[starts + lens] - total[starts], count[starts + lens] - count[starts]


def empty(schema: pa.Schema) -> pa.Table:
    return schema.empty_table()
