"""Window hashing and content-chosen anchors over symbol sequences (numpy, inside tasks).

A *window* is ``width`` consecutive symbols of one document. Every window names one anchor: the
leftmost of its ``gram``-symbol substrings with the smallest hash. The choice depends on the
window's content alone, so equal windows, in whatever document, name equal anchors at the same
offset. Consecutive windows with one anchor position form a *context*: the symbols from the first
such window's start to the last one's end. Anchors only decide which task sees a context; they
never decide equality of texts by themselves.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_LOW = np.uint64(0xFFFFFF)
PIECE = 1 << 17  # windows handled at once; bounds the memory of a long document


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(29))
    x = x * _M2
    return x ^ (x >> np.uint64(32))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def window_hash(sym: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every ``width`` consecutive symbols, by doubling."""
    n = len(sym) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, done, power, step, base = None, 0, sym, 1, int(_BASE)
    while True:
        if width & step:
            part = power[done:done + n]
            total = part.copy() if total is None else total * np.uint64(pow(base, step, 1 << 64)) + part
            done += step
        if step * 2 > width:
            return total
        power = power[:len(power) - step] * np.uint64(pow(base, step, 1 << 64)) + power[step:]
        step *= 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    step, m = 1, x
    while step * 2 <= width:
        m = np.minimum(m[:len(m) - step], m[step:])
        step *= 2
    rest = width - step
    return np.minimum(m[:len(m) - rest], m[rest:]) if rest else m


def contexts(sym: np.ndarray, starts: np.ndarray, lens: np.ndarray, width: int, gram: int) -> dict[str, np.ndarray]:
    """Contexts of all documents laid end to end in ``sym``.

    Returns arrays: ``doc`` (index), ``first`` and ``last`` (window starts, positions in ``sym``),
    ``anchor`` (position), ``key`` (hash of the anchor's symbols) and ``ctx`` (hash of the
    context's symbols and of the anchor's place in it).
    """
    out: dict[str, list] = {k: [] for k in ("doc", "first", "last", "anchor", "key", "ctx")}
    nwin = np.maximum(lens - width + 1, 0)
    docs = np.flatnonzero(nwin)
    j = 0
    while j < len(docs):
        # a run of whole documents of at most PIECE symbols, or one long document in pieces
        e = j + 1
        lo = int(starts[docs[j]])
        while e < len(docs) and int(starts[docs[e]] + lens[docs[e]]) - lo <= PIECE:
            e += 1
        hi = int(starts[docs[e - 1]] + lens[docs[e - 1]])
        for a in range(lo, max(hi - width + 1, lo + 1), PIECE):
            _piece(sym, a, min(hi, a + PIECE + width - 1), docs[j:e], starts, lens, width, gram, out)
        j = e
    dtypes = {"key": np.uint64, "ctx": np.uint64}
    return {k: np.concatenate(v) if v else np.zeros(0, dtypes.get(k, np.int64)) for k, v in out.items()}


def _piece(sym, lo, hi, docs, starts, lens, width, gram, out) -> None:
    part = sym[lo:hi]
    n = len(part) - width + 1
    if n <= 0:
        return
    # windows that lie in one document: from its start to its length less the width
    edge = np.zeros(n + 1, np.int32)
    s = np.clip(starts[docs] - lo, 0, n)
    e = np.clip(starts[docs] + lens[docs] - width + 1 - lo, 0, n)
    np.add.at(edge, s, 1)
    np.add.at(edge, e, -1)
    win = np.flatnonzero(np.cumsum(edge[:n]) > 0)
    if not len(win):
        return
    hk = mix(window_hash(part, gram))
    best = sliding_min((hk & ~_LOW) | np.arange(len(hk), dtype=np.uint64), width - gram + 1)
    anchor = (best & _LOW).astype(np.int64)[win]
    doc = np.searchsorted(starts[docs] - lo, win, side="right") - 1
    new = np.ones(len(win), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (win[1:] != win[:-1] + 1) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    first, last, anchor = win[at], win[np.append(at[1:], len(win)) - 1], anchor[at]
    hw = window_hash(part, width)
    ctx = mix(mix(hw[first]) + mix(hw[last]) * _M1 + (last - first).astype(np.uint64) * _M2 + (anchor - first).astype(np.uint64))
    out["doc"].append(docs[doc[at]])
    out["first"].append(first + lo)
    out["last"].append(last + lo)
    out["anchor"].append(anchor + lo)
    out["key"].append(hk[anchor])
    out["ctx"].append(ctx)
