"""Operator 3, suffix-array dedup of byte strings.

Open contexts of a key bucket get an enhanced suffix array (suffixes at the window starts, LCP of
neighbours). A stack scan over it lists the LCP intervals of at least ``width`` bytes as a tree;
intervals whose occurrences differ in the byte to their left are the maximal repeats. Each is a
rank range, so it stands for *all* its occurrences. An occurrence in a document with a larger id
than the interval's smallest is removed.

Defined results: a null text is the empty text; a text shorter than ``width`` keeps every byte; rows
with one doc_id never remove from each other; a null doc_id compares as larger than all others.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B
from .names import with_long_id
from .repeats import Repeats, remove_repeats, runs_of
from .windows import BYTE_CODES

WIDTH, GRAM = 50, 20  # bytes of a removable string; bytes of the anchors that route windows
BLOCK_BYTES = 3 << 20  # a byte is a 64-bit symbol inside a task
DIVERSE = -1
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                    ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])
SPARK_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"


def _symbols(docs: pa.Table):
    data = B.texts(docs)
    lens = np.array([len(x) for x in data], np.int64)
    raw = np.frombuffer(b"".join(data), np.uint8)
    return BYTE_CODES[raw], np.cumsum(lens) - lens, lens, raw


def suffix_array(sym: np.ndarray, starts: np.ndarray, nwin: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Suffixes at every window start of the contexts, in order, with the LCP of neighbours.

    Returns (order, lcp, context of each suffix, offset of each suffix); ``lcp[i]`` belongs to
    ranks i-1 and i, values under ``width`` are reported as 0."""
    ctx = np.repeat(np.arange(len(nwin)), nwin)
    off = np.arange(nwin.sum()) - np.repeat(np.cumsum(nwin) - nwin, nwin)
    size = nwin[ctx] - off + width - 1
    pos = starts[ctx] + off
    words = -(-int(size.max(initial=width)) // 8)
    padded = np.concatenate([sym, np.zeros(words * 8, np.uint8)])
    keys = []
    for w in range(words):
        v = np.zeros(len(pos), np.uint64)
        for j in range(8 * w, 8 * w + 8):
            v = v << np.uint64(8) | np.where(j < size, padded[pos + j], 0).astype(np.uint64)
        keys.append(v)
    order = np.lexsort((size, *keys[::-1]))
    lcp = np.zeros(len(order), np.int64)
    alike = np.ones(len(order) - 1, bool)
    a, b = order[:-1], order[1:]
    most = np.minimum(size[a], size[b])
    for w in range(words):
        x = keys[w][a] ^ keys[w][b]
        same = np.full(len(x), 8)
        for j in range(8):  # equal leading bytes of the word
            same = np.where((same == 8) & (x >> np.uint64(56 - 8 * j) & np.uint64(255) != 0), j, same)
        lcp[1:] += np.where(alike, same, 0)
        alike &= same == 8
    lcp[1:] = np.minimum(lcp[1:], most)
    lcp[lcp < width] = 0
    return order, lcp, ctx, off


def maximal_repeats(lcp: np.ndarray, left: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Stack scan: (length, first rank, last rank, smallest id) of every LCP interval whose
    occurrences differ in their left byte and in their document. ``left`` and ``doc`` by rank."""
    found, stack = [], []
    lcps, lefts, docs = lcp.tolist(), left.tolist(), doc.tolist()
    lcps.append(0)
    for i in range(1, len(lcps)):
        h = lcps[i]
        if not h and not stack:
            continue
        # the suffix of rank i-1 as an interval of its own
        begin, lo, hi, l = i - 1, docs[i - 1], docs[i - 1], lefts[i - 1]
        while stack and stack[-1][0] > h:
            length, b, slo, shi, sl = stack.pop()
            begin, lo, hi = b, min(lo, slo), max(hi, shi)
            l = l if l == sl else DIVERSE
            if l == DIVERSE and lo != hi:
                found.append((length, begin, i - 1, lo))
        if h:
            if stack and stack[-1][0] == h:
                top = stack[-1]
                stack[-1] = (h, top[1], min(lo, top[2]), max(hi, top[3]), l if l == top[4] else DIVERSE)
            else:
                stack.append((h, begin, lo, hi, l))
    return found


def solve(sym, starts, nwin, doc, key, width) -> np.ndarray:
    """Windows of the contexts that lie in a maximal repeat which a smaller document holds too."""
    mark = np.zeros(int(nwin.sum()), bool)
    # keys in runs of bounded size: equal windows have equal keys, so no repeat spans two runs
    by_key = np.argsort(key, kind="stable")
    edges = np.flatnonzero(np.append(True, key[by_key][1:] != key[by_key][:-1]))
    load = np.cumsum(nwin[by_key])
    base = np.cumsum(nwin) - nwin
    lo = 0
    while lo < len(by_key):
        full = np.searchsorted(load, (load[lo - 1] if lo else 0) + (1 << 18), side="right")
        nxt = edges[np.searchsorted(edges, max(full, lo + 1), side="left"):]
        hi = int(nxt[0]) if len(nxt) else len(by_key)
        own = by_key[lo:hi]
        order, lcp, ctx, off = suffix_array(sym, starts[own], nwin[own], width)
        d = doc[own][ctx][order]
        pos = (starts[own][ctx] + off)[order]
        # a suffix at the start of its context has an unknown left byte and counts as diverse
        left = np.where(off[order] > 0, sym[np.maximum(pos - 1, 0)].astype(np.int64), -2 - np.arange(len(order)))
        at = (base[own][ctx] + off)[order]
        for length, first, last, least in maximal_repeats(lcp, left, d):
            hit = at[first:last + 1][d[first:last + 1] > least]
            for k in range(length - width + 1):
                mark[hit + k] = True
        lo = hi
    return mark


def _cut(docs, raw, starts, lens, removed) -> pa.Table:
    if docs is None:
        return SCHEMA.empty_table()
    n_removed, n_spans = runs_of(removed, starts, lens)
    shas, spans = [], []
    for s, n, r in zip(starts.tolist(), lens.tolist(), n_removed.tolist()):
        part = raw[s:s + n]
        if r:
            gone = removed[s:s + n]
            part = part[~gone]
            spans.append(np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist())
        else:
            spans.append([])
        shas.append(hashlib.sha256(part).hexdigest())
    return pa.table([docs.column("doc_id"), pa.array(lens), pa.array(n_removed), pa.array(n_spans, pa.int64()),
                     pa.array(shas, pa.string()), pa.array(spans, pa.list_(pa.int64()))], schema=SCHEMA)


def remove_repeated_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """One row per document: sizes, the removed spans (start and end byte of each, flattened) and
    the SHA-256 of the remaining bytes."""
    return remove_repeats(with_long_id(docs.select("doc_id", "text")), Repeats(width, gram, _symbols, solve, _cut, SPARK_SCHEMA, block_bytes=BLOCK_BYTES, share=1, wire=lambda raw: raw))
