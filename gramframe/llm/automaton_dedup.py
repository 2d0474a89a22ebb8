"""Operator 9, substring dedup of word sequences by suffix automata.

A shard holds the open contexts of the anchor keys that hash to it. Its documents pass in the order
of their ids: each is streamed through the automaton of the earlier (smaller) ones, whose matching
statistics (longest suffix ending at each word that the reference holds) mark every span of at
least ``width`` words, and then joins the reference. Shards go to the tasks that hold their
candidates, not to every executor: a reference that grows with the corpus has no broadcast bound.

Defined results: a null text has no words; a text with fewer than ``width`` words keeps all; rows
with one doc_id never remove from each other; a null doc_id compares as larger than all others.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from xxhash import xxh3_64_intdigest

from . import blocks as B
from .names import with_long_id
from .repeats import Repeats, remove_repeats, runs_of

WIDTH, GRAM = 50, 25  # words of a removable span; words of the anchors that route windows
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
SPARK_SCHEMA = "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string"


class SuffixAutomaton:
    """Generalised suffix automaton over integer symbols."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, word: list[int]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in word:
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is None:
                cur = len(nxt)
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
                last = cur
            else:
                last = self._split(last, c, q)

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        link[q] = clone
        return clone

    def matches(self, word: list[int]) -> list[int]:
        """Matching statistics: at each position, the longest suffix that the reference holds."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        out = []
        for c in word:
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                size += 1
            out.append(size)
        return out


def solve(sym, starts, nwin, doc, key, width) -> np.ndarray:
    """Windows whose words occur in the shard's documents with smaller ids."""
    mark = np.zeros(int(nwin.sum()), bool)
    base = np.cumsum(nwin) - nwin
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    at, n = 0, len(order)
    while at < n:
        end = int(np.searchsorted(k, k[at], side="right"))
        reference = SuffixAutomaton()
        while at < end:
            same = at
            while same < end and d[same] == d[at]:
                same += 1
            held = [(int(i), sym[starts[i]:starts[i] + nwin[i] + width - 1].tolist()) for i in order[at:same]]
            if len(reference.next) > 1:
                for i, word in held:
                    stats = reference.matches(word)[width - 1:]
                    mark[base[i]:base[i] + nwin[i]] = [x >= width for x in stats]
            if same < end:
                for _, word in held:
                    reference.add(word)
            at = same
    return mark


def _symbols(docs: pa.Table):
    words = [x.split() for x in B.texts(docs)]
    lens = np.array([len(w) for w in words], np.int64)
    code: dict[bytes, int] = {}
    flat = np.empty(int(lens.sum()), np.uint64)
    at = 0
    for w in words:
        for x in w:
            if x not in code:
                code[x] = xxh3_64_intdigest(x)
        flat[at:at + len(w)] = [code[x] for x in w]
        at += len(w)
    return flat, np.cumsum(lens) - lens, lens, words


def _cut(docs, words, starts, lens, removed) -> pa.Table:
    if docs is None:
        return SCHEMA.empty_table()
    n_removed, n_spans = runs_of(removed, starts, lens)
    shas = []
    for w, s, r in zip(words, starts.tolist(), n_removed.tolist()):
        kept = w if not r else [x for x, gone in zip(w, removed[s:s + len(w)].tolist()) if not gone]
        shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
    return pa.table([docs.column("doc_id"), pa.array(lens), pa.array(n_removed), pa.array(n_spans, pa.int64()), pa.array(shas, pa.string())], schema=SCHEMA)


def remove_repeated_words(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """One row per document: word counts and the SHA-256 of the kept words joined by a space."""
    return remove_repeats(with_long_id(docs.select("doc_id", "text")), Repeats(width, gram, _symbols, solve, _cut, SPARK_SCHEMA))
