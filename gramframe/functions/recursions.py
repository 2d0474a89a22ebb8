"""Fidelity kernels of the three feature maps as numpy array functions (no circuit objects).

Inputs are angle arrays ``a`` (left rows) and ``b`` (right rows) with the feature axis last;
any leading shapes that broadcast together (pairs ``(B, n)`` with ``(B, n)``, or rows
``(R, 1, n)`` against landmarks ``(1, L, n)``). Output: K with the broadcast leading shape.

Closed forms (angles a_q in radians after clipping/scaling):
  pauli, any repetitions  product over features of (1 + r_q(x).r_q(y)) / 2, r_q a Bloch vector
  custom, 1 repetition    product over features of single-qubit fidelities
  custom, 2 repetitions   left-to-right recursion, 2x2 complex state per pair
  zz, 1 repetition        left-to-right recursion, 2 complex numbers per pair
  zz, 2 repetitions       left-to-right recursion, 2x2x2 complex state per pair
These are used inside Arrow batches (pandas UDFs) by ``operators.kernels``; the product
forms also exist as native column expressions there.
"""

from __future__ import annotations

import math

import numpy as np

MAPS = ("zz", "pauli", "custom")


def check_map(name: str, repetitions: int) -> None:
    if name not in MAPS:
        raise ValueError(f"unknown feature map {name!r}; expected one of {MAPS}")
    if repetitions < 1:
        raise ValueError("repetitions must be >= 1")
    if name in ("zz", "custom") and repetitions > 2:
        raise ValueError(f"{name} with {repetitions} repetitions is not supported (state grows exponentially)")


# ---------------------------------------------------------------- per-row quantities
def pauli_vectors(a: np.ndarray, repetitions: int) -> np.ndarray:
    """Bloch vector per feature after the map: shape a.shape + (3,)."""
    ch, sh = np.cos(a / 2.0), np.sin(a / 2.0)
    ca, sa = ch * ch - sh * sh, 2.0 * sh * ch
    # theta_q = a_q + a_{q-1} / 2, theta_0 = a_0 / 2
    ct, st = ch.copy(), sh.copy()
    ct[..., 1:] = ca[..., 1:] * ch[..., :-1] - sa[..., 1:] * sh[..., :-1]
    st[..., 1:] = sa[..., 1:] * ch[..., :-1] + ca[..., 1:] * sh[..., :-1]
    x, y, z = np.ones_like(a), np.zeros_like(a), np.zeros_like(a)
    for rep in range(repetitions):
        x, y = x * ca - y * sa, x * sa + y * ca
        y, z = y * ct - z * st, y * st + z * ct
        if rep + 1 < repetitions:
            x, y, z = z, -y, x
    return np.stack([x, y, z], axis=-1)


def _site_custom(a: np.ndarray) -> np.ndarray:
    """U(a) = Rz(a^2/pi) Ry(a) as (..., 2, 2) complex."""
    c, s = np.cos(a / 2.0), np.sin(a / 2.0)
    t = a * a / np.pi
    e0, e1 = np.exp(-0.5j * t), np.exp(0.5j * t)
    u = np.empty(a.shape + (2, 2), dtype=complex)
    u[..., 0, 0] = e0 * c
    u[..., 0, 1] = -e0 * s
    u[..., 1, 0] = e1 * s
    u[..., 1, 1] = e1 * c
    return u


# ---------------------------------------------------------------- kernels
def kernel_pauli(a: np.ndarray, b: np.ndarray, repetitions: int = 2) -> np.ndarray:
    ra, rb = pauli_vectors(a, repetitions), pauli_vectors(b, repetitions)
    return np.prod((1.0 + np.sum(ra * rb, axis=-1)) / 2.0, axis=-1)


def kernel_custom_r1(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a - b * b) / (2.0 * np.pi)
    k = np.cos((a - b) / 2.0) ** 2 * np.cos(d) ** 2 + np.cos((a + b) / 2.0) ** 2 * np.sin(d) ** 2
    return np.prod(k, axis=-1)


def kernel_custom_r2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """custom map, two repetitions: 2x2 complex state T[p, p'] per pair, carried over features.

    T_0[p, p'] = A_0[p, p'] f_0[p]* g_0[p'];  T_q[p, p'] = A_q[p, p'] sum_{o, o'} T_{q-1}[o, o']
    f_q[p xor o]* g_q[p' xor o'];  K = |sum T|^2, with U(a) = Rz(a^2/pi) Ry(a), f = U(a)[:, 0],
    g = U(b)[:, 0], A = U(a)^dagger U(b). All updates are elementwise on pair-shaped arrays.
    """
    ua, ub = _site_custom(a), _site_custom(b)
    n = a.shape[-1]
    t00 = t01 = t10 = t11 = None
    for q in range(n):
        xa, xb = ua[..., q, :, :], ub[..., q, :, :]
        ca = np.conj(xa)
        # A[p, p'] = sum_r conj(Ua[r, p]) Ub[r, p']
        a00 = ca[..., 0, 0] * xb[..., 0, 0] + ca[..., 1, 0] * xb[..., 1, 0]
        a01 = ca[..., 0, 0] * xb[..., 0, 1] + ca[..., 1, 0] * xb[..., 1, 1]
        a10 = ca[..., 0, 1] * xb[..., 0, 0] + ca[..., 1, 1] * xb[..., 1, 0]
        a11 = ca[..., 0, 1] * xb[..., 0, 1] + ca[..., 1, 1] * xb[..., 1, 1]
        f0, f1 = ca[..., 0, 0], ca[..., 1, 0]      # conj(f)
        g0, g1 = xb[..., 0, 0], xb[..., 1, 0]
        if q == 0:
            t00, t01, t10, t11 = a00 * (f0 * g0), a01 * (f0 * g1), a10 * (f1 * g0), a11 * (f1 * g1)
            continue
        u00 = t00 * g0 + t01 * g1      # u[o, p'] = sum_o' T[o, o'] g[p' xor o']
        u01 = t00 * g1 + t01 * g0
        u10 = t10 * g0 + t11 * g1
        u11 = t10 * g1 + t11 * g0
        t00 = a00 * (f0 * u00 + f1 * u10)
        t01 = a01 * (f0 * u01 + f1 * u11)
        t10 = a10 * (f1 * u00 + f0 * u10)
        t11 = a11 * (f1 * u01 + f0 * u11)
    return np.abs(t00 + t01 + t10 + t11) ** 2


def kernel_zz_r1(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a.shape[-1]
    delta = (a - b) / 2.0
    w = (a[..., :-1] * a[..., 1:] - b[..., :-1] * b[..., 1:]) / (2.0 * np.pi)
    shape = np.broadcast_shapes(a.shape, b.shape)[:-1]
    u = np.broadcast_to(np.exp(1j * delta[..., 0]), shape).astype(complex)
    v = np.broadcast_to(np.exp(-1j * delta[..., 0]), shape).astype(complex)
    for q in range(1, n):
        ew = np.exp(1j * w[..., q - 1])
        ed = np.exp(1j * delta[..., q])
        u, v = (u * ew + v / ew) * ed, (u / ew + v * ew) / ed
    return np.abs(u + v) ** 2 / 4.0 ** n


def kernel_zz_r2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """zz map, two repetitions: path sum over three sign chains (s: first layer of x, t: shared
    middle layer, u: first layer of y), an 8-entry complex state per pair.

    site_q[s, t, u] = 1/4 (-1)^(z.w + w.z') e^{i a s/2} e^{i (a-b) t/2} e^{-i b u/2} (bits z, w, z'
    of the signs s, t, u); between features the state is mixed per chain by
    [[e^{i c/2}, e^{-i c/2}], [e^{-i c/2}, e^{i c/2}]] with c = alpha, alpha - beta, -beta,
    alpha = a_q a_{q+1} / pi, beta = b_q b_{q+1} / pi.  K = |sum T|^2.
    """
    n = a.shape[-1]
    states = [(s_, t_, u_) for s_ in (0, 1) for t_ in (0, 1) for u_ in (0, 1)]   # bits; sign = 1 - 2 bit
    par = {st: -0.25 if ((st[0] & st[1]) ^ (st[1] & st[2])) else 0.25 for st in states}

    def site_factors(q):
        ar, br = a[..., q], b[..., q]
        er = np.exp(0.5j * ar)      # e^{i a s/2}: s=+1 -> er, s=-1 -> conj(er)
        ep = np.exp(0.5j * (ar - br))
        el = np.exp(-0.5j * br)
        return (er, np.conj(er)), (ep, np.conj(ep)), (el, np.conj(el))

    def site(q):
        r, p, l_ = site_factors(q)
        return {st: par[st] * r[st[0]] * p[st[1]] * l_[st[2]] for st in states}

    t = site(0)
    for q in range(1, n):
        alpha = a[..., q - 1] * a[..., q] / np.pi
        beta = b[..., q - 1] * b[..., q] / np.pi
        for axis, c in ((0, alpha), (1, alpha - beta), (2, -beta)):
            pp, mm = np.exp(0.5j * c), np.exp(-0.5j * c)
            new = {}
            for st in states:
                if st[axis]:
                    continue
                other = list(st)
                other[axis] = 1
                other = tuple(other)
                x0, x1 = t[st], t[other]
                new[st] = pp * x0 + mm * x1
                new[other] = mm * x0 + pp * x1
            t = new
        sq = site(q)
        t = {st: sq[st] * t[st] for st in states}
    total = sum(t[st] for st in states)
    shape = np.broadcast_shapes(a.shape, b.shape)[:-1]
    return np.broadcast_to(np.abs(total) ** 2, shape)


WORK_BYTES = 32 << 20   # of a kernel block's work arrays
PAIR_BYTES = 512        # work per (row, landmark) pair, the largest of the recursions


def chunk_rows(landmarks: int) -> int:
    """Rows per numpy call that keep the (rows x landmarks) work arrays within WORK_BYTES."""
    return max(1, WORK_BYTES // (PAIR_BYTES * max(1, landmarks)))


def rows_x_landmarks(fn, x: np.ndarray, lm: np.ndarray, chunk: int | None = None) -> np.ndarray:
    """K (rows, landmarks) for row values x (R, n) and landmark values lm (L, n), in row chunks; by the kernel's
    block form where it has one (``with_matrix``)."""
    out = np.empty((x.shape[0], lm.shape[0]))
    chunk = chunk or chunk_rows(lm.shape[0])
    if hasattr(fn, "matrix"):
        for s in range(0, x.shape[0], chunk):
            out[s:s + chunk] = fn.matrix(x[s:s + chunk], lm)
        return out
    for s in range(0, x.shape[0], chunk):
        out[s:s + chunk] = fn(x[s:s + chunk, None, :], lm[None, :, :])
    return out


PAULI_GROUP = 2         # features whose Bloch vectors meet in one product: 4 ** 2 numbers a row
HALF_ROWS = 512         # rows whose amplitudes stay in cache
MAX_HALF = 8            # features of one half, 2 ** 8 amplitudes; beyond that pairs run the recursion


def _pauli_terms(a: np.ndarray, repetitions: int) -> list[np.ndarray]:
    """Per group of features the outer product of their (1, x, y, z) / sqrt(2): arrays (rows, 4 ** group). The
    inner product of two rows' terms is the product of (1 + r.r') / 2 over the group."""
    r = np.concatenate([np.ones((*a.shape, 1), a.dtype), pauli_vectors(a, repetitions)], axis=-1) * math.sqrt(0.5)
    out = []
    for lo in range(0, a.shape[1], PAULI_GROUP):
        term = r[:, lo]
        for q in range(lo + 1, min(lo + PAULI_GROUP, a.shape[1])):
            term = (term[:, :, None] * r[:, q, None, :]).reshape(len(a), 4 * term.shape[1])
        out.append(term)
    return out


def pauli_matrix(a: np.ndarray, b: np.ndarray, repetitions: int) -> np.ndarray:
    """K (rows, landmarks): one matrix product per group of features, no (rows x landmarks x features) array."""
    out = None
    for left, right in zip(_pauli_terms(a, repetitions), _pauli_terms(b, repetitions)):
        part = left @ right.T
        out = part if out is None else np.multiply(out, part, out=out)
    return out


# A row's amplitudes split between two features: phi[l, r] = sum over the bond o of left[t, o, l] right[t, o, r], t being
# the last sign of the left half where both halves need it (zz). Then <phi(x)|phi(y)> is, for each t, o and o', a product
# of two short inner products, so a block of rows x landmarks is a few matrix products instead of a recursion per pair.
def _cis(x: np.ndarray) -> np.ndarray:
    return np.cos(x) + 1j * np.sin(x)


def _custom_halves(a: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """custom, two repetitions: arrays (1, 2, amplitudes of the half, rows)."""
    rows, n = a.shape
    half, phase = a.T / 2.0, _cis(a.T * a.T / (2.0 * np.pi))
    c, s = np.cos(half), np.sin(half)
    u = np.empty((n, 2, 2, rows), dtype=phase.dtype)     # u[q, r, p]: Rz(a^2/pi) Ry(a)
    u[:, 0, 0], u[:, 0, 1] = phase.conj() * c, -phase.conj() * s
    u[:, 1, 0], u[:, 1, 1] = phase * s, phase * c
    first = u[:, :, 0]                               # f[p] = u[p, 0]
    left = (u[0] * first[0]).transpose(1, 0, 2)      # [p, r0]
    for q in range(1, cut):
        f0, f1 = first[q]
        carried = np.stack([left[0] * f0 + left[1] * f1, left[0] * f1 + left[1] * f0])
        left = (carried[:, :, None] * u[q].transpose(1, 0, 2)[:, None]).reshape(2, 2 * left.shape[1], rows)
    right = np.ones((2, 1, rows), dtype=u.dtype)
    for q in range(n - 1, cut - 1, -1):
        f0, f1 = first[q]
        here = u[q].transpose(1, 0, 2)[:, :, None] * right[:, None]     # [p, r, rest]
        right = np.stack([here[0] * f0 + here[1] * f1, here[0] * f1 + here[1] * f0]).reshape(2, 2 * right.shape[1], rows)
    return left[None], right[None]


def _zz_halves(a: np.ndarray, cut: int, repetitions: int) -> tuple[np.ndarray, np.ndarray]:
    """zz: arrays (2, bond, amplitudes of the half, rows), the first axis the last sign t of the left half. With two
    repetitions the bond is the sign s of the first layer at that feature; with one there is none."""
    rows, n = a.shape
    turn = _cis(a.T / 2.0)                                   # e^{i a/2}
    turn = np.stack([turn, turn.conj()], axis=1)             # [q, sign]
    mixed = _cis(a.T[:-1] * a.T[1:] / (2.0 * np.pi))         # m for equal signs of neighbours, its conjugate for unequal
    square, back = mixed * mixed, mixed.conj() * mixed.conj()
    if repetitions == 1:
        site = turn[:, :, None] * math.sqrt(0.5)             # [q, t, s = one value]
    else:
        hadamard = np.array([[0.5, 0.5], [0.5, -0.5]], a.dtype)
        site = turn[:, :, None] * turn[:, None, :] * hadamard[None, :, :, None]
    bond = site.shape[2]

    def over_s(state: np.ndarray, q: int) -> np.ndarray:
        """[t, s, amplitudes] summed with the chain of s between features q - 1 and q, over m* (put back by ``across``)."""
        if bond == 1:
            return state
        out = state * square[q - 1]
        out[:, 0] += state[:, 1]
        out[:, 1] += state[:, 0]
        return out

    def across(q: int) -> np.ndarray:
        """[t, t']: the chain of t between features q - 1 and q; with two repetitions times the m* of ``over_s``."""
        equal, unequal = (mixed[q - 1], mixed[q - 1].conj()) if bond == 1 else (np.ones_like(mixed[0]), back[q - 1])
        return np.stack([np.stack([equal, unequal]), np.stack([unequal, equal])])

    left = site[0][:, :, None]                               # [t, s, amplitudes]
    for q in range(1, cut):
        # the earlier t becomes an amplitude: [t', s', t, a]
        step = site[q][:, :, None] * across(q)[:, None]
        left = (step[:, :, :, None] * over_s(left, q).transpose(1, 0, 2, 3)[None]).reshape(2, bond, 2 * left.shape[2], rows)
    right = np.ones((2, bond, 1, rows), a.dtype)
    for q in range(n - 1, cut - 1, -1):
        before = over_s(site[q][:, :, None] * right, q).transpose(1, 0, 2, 3)                # [s', t, a]
        right = (across(q)[:, None, :, None] * before[None]).reshape(2, bond, 2 * right.shape[2], rows)
    return left, right


def _halves(name: str, repetitions: int, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = (a.shape[1] + (name == "zz")) // 2
    return _custom_halves(a, cut) if name == "custom" else _zz_halves(a, cut, repetitions)


def amplitude_matrix(name: str, repetitions: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """K (rows, landmarks) of the custom (two repetitions) and zz maps from the halves' products."""
    left_b, right_b = (h.conj() for h in _halves(name, repetitions, b))
    signs, bond, count = left_b.shape[0], left_b.shape[1], len(b)
    # landmarks side by side for every bond value: (sign, amplitudes, bond x landmarks)
    left_b, right_b = (np.ascontiguousarray(h.transpose(0, 2, 1, 3)).reshape(signs, h.shape[2], bond * count) for h in (left_b, right_b))
    out = np.empty((len(a), count), a.dtype)
    step = min(chunk_rows(count), HALF_ROWS)
    for lo in range(0, len(a), step):
        left, right = _halves(name, repetitions, a[lo:lo + step])
        total = None
        for t in range(signs):
            for o in range(bond):
                part = left[t, o].T @ left_b[t]
                part *= right[t, o].T @ right_b[t]
                total = part if total is None else np.add(total, part, out=total)
        total = total.reshape(-1, bond, count).sum(axis=1) if bond > 1 else total
        out[lo:lo + step] = total.real ** 2 + total.imag ** 2
    return out


def fidelity_matrix(name: str, repetitions: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """K (rows, landmarks) of a feature map for angles a (R, n) and b (L, n)."""
    check_map(name, repetitions)
    if name == "pauli":
        return pauli_matrix(a, b, repetitions)
    if (name, repetitions) != ("custom", 1) and 2 <= a.shape[1] <= 2 * MAX_HALF:
        return amplitude_matrix(name, repetitions, a, b)
    return rows_x_landmarks(KERNELS[(name, repetitions)], a, b)


KERNELS = {
    ("pauli", 1): lambda a, b: kernel_pauli(a, b, 1),
    ("pauli", 2): lambda a, b: kernel_pauli(a, b, 2),
    ("custom", 1): kernel_custom_r1,
    ("custom", 2): kernel_custom_r2,
    ("zz", 1): kernel_zz_r1,
    ("zz", 2): kernel_zz_r2,
}


def with_matrix(fn, matrix):
    """``fn`` (pairs) that also knows its whole-block form ``matrix(rows, landmarks)``."""
    def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return fn(a, b)
    pairs.matrix = matrix
    return pairs


def fidelity_kernel(name: str, repetitions: int):
    check_map(name, repetitions)
    pairs = (lambda a, b: kernel_pauli(a, b, repetitions)) if name == "pauli" else KERNELS[(name, repetitions)]
    return with_matrix(pairs, lambda x, lm: fidelity_matrix(name, repetitions, x, lm))
