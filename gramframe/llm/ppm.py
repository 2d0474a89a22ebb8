"""Prediction by partial matching over bytes (numpy, inside tasks).

The model is a byte-context trie of fixed depth, held as sorted n-gram counts. Probabilities use
escape method C with symbol exclusion: in a context with T occurrences and D distinct next symbols
a seen symbol s gets c(s) / (T + D) and the escape D / (T + D); after an escape the symbols of
the longer context are excluded from the shorter one's counts. Every symbol of a context is a symbol
of its suffix too (all counts come from one corpus), so the excluded set is that of the last longer
context seen. Below order 0 the rest of the 256 symbols is uniform. Byte 0xFF, which UTF-8 never
uses, ends a text and also pads the contexts at its start.
"""

from __future__ import annotations

import numpy as np

END = 0xFF
SYMBOLS = 256


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """(order + 1)-grams ending at every position of ``data`` after the first ``order``, packed."""
    n = len(data) - order
    wide = data.astype(np.uint64)
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(order + 1):
        out = out << np.uint64(8) | wide[j:j + n]
    return out


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in the sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _groups(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of the values by key; keys sorted."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return (k[at], *[np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values])


class Trie:
    """Counts of the n-grams of one set of contexts, all orders from ``low`` to ``order``; orders
    under ``low`` come from the shared table of 2-grams (at most 65,536 entries)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, pairs: np.ndarray, low: int = 2) -> None:
        self.order = order
        tables: dict[int, tuple[np.ndarray, np.ndarray]] = {order: (keys, counts.astype(np.float64))}
        for m in range(order - 1, low - 1, -1):
            k, c = tables[m + 1]
            tables[m] = _groups(k & np.uint64((1 << 8 * (m + 1)) - 1), c)
        pk = np.flatnonzero(pairs).astype(np.uint64)
        tables[1] = (pk, pairs[pk.astype(np.int64)].astype(np.float64))
        tables[0] = _groups(pk & np.uint64(255), tables[1][1])
        self.tables = tables
        self.contexts: dict[int, tuple[np.ndarray, ...]] = {}
        for m in range(order, -1, -1):
            k, c = tables[m]
            self.contexts[m] = _groups(k >> np.uint64(8), c, np.ones(len(k)))
        # counts that a context of order m - 1 loses when a context of order m is excluded from it
        self.lost: dict[int, np.ndarray] = {}
        for m in range(order, 0, -1):
            k, _ = tables[m]
            under = _find(tables[m - 1][0], k & np.uint64((1 << 8 * m) - 1))
            c = np.where(under >= 0, tables[m - 1][1][under], 0.0) if len(k) else np.zeros(0)
            self.lost[m] = _groups(k >> np.uint64(8), c)[1]

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each (order + 1)-gram after the bytes before it."""
        out = np.zeros(len(keys))
        open_ = np.ones(len(keys), bool)
        lost = np.zeros(len(keys))  # of the current context: counts and symbols excluded
        gone = np.zeros(len(keys))
        for m in range(self.order, -1, -1):
            gram = keys & np.uint64((1 << 8 * (m + 1)) - 1) if m < 7 else keys
            ck, total, kinds = self.contexts[m]
            ci = _find(ck, gram >> np.uint64(8))
            here = open_ & (ci >= 0)
            t = np.where(here, total[ci] - lost, 0.0) if len(ck) else np.zeros(len(keys))
            d = np.where(here, kinds[ci] - gone, 0.0) if len(ck) else np.zeros(len(keys))
            some = here & (d > 0)
            gi = _find(self.tables[m][0], gram)
            hit = some & (gi >= 0)
            if hit.any():
                out[hit] += np.log10(self.tables[m][1][gi[hit]] / (t[hit] + d[hit]))
            open_ &= ~hit
            esc = some & ~hit
            out[esc] += np.log10(d[esc] / (t[esc] + d[esc]))
            seen = here & open_
            gone[seen] = kinds[ci[seen]]
            lost[seen] = self.lost[m][ci[seen]] if m else 0.0
        out[open_] -= np.log10(np.maximum(SYMBOLS - gone[open_], 1.0))
        return out
