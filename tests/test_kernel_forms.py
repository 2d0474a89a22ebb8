"""Kernel forms against sums written from their definitions, and invariants (no Spark).

zz: uniform amplitudes with phases that are quadratic in the signs, and a Hadamard sum between
repetitions. pauli: its pair part only turns the right feature, so a row is a product of single
features. custom: products of single features, their strings renamed by running parity.
"""

import itertools

import numpy as np
import pytest

from gramframe.functions.recursions import check_map, fidelity_kernel

CASES = [("pauli", 1), ("pauli", 2), ("pauli", 3), ("custom", 1), ("custom", 2), ("zz", 1), ("zz", 2)]


def zz_amplitudes(a, reps):
    bits = np.array(list(itertools.product([0, 1], repeat=len(a))))
    s = 1 - 2 * bits
    form = s @ a + (s[:, :-1] * s[:, 1:]) @ (a[:-1] * a[1:] / np.pi)
    phase, signs = np.exp(-0.5j * form), (-1.0) ** (bits @ bits.T) / 2 ** (len(a) / 2)
    amp = np.eye(1, len(bits))[0]
    for _ in range(reps):
        amp = phase * (signs @ amp)
    return amp


def spin(axis, angle):
    """cos - i sin (axis . sigma): the turn of one feature."""
    x, y, z = axis
    return np.cos(angle / 2) * np.eye(2) - 1j * np.sin(angle / 2) * np.array([[z, x - 1j * y], [x + 1j * y, -z]])


def pauli_amplitudes(a, reps):
    turn = a / 2 + np.concatenate([[0], (a[:-1] + a[1:]) / 2])
    mixed = np.array([[1, 1], [1, -1]]) / np.sqrt(2)
    amp = np.ones(1)
    for q in range(len(a)):
        once = spin((1, 0, 0), turn[q]) @ spin((0, 0, 1), a[q]) @ mixed
        amp = np.kron(amp, np.linalg.matrix_power(once, reps)[:, 0])
    return amp


def custom_amplitudes(a, reps):
    strings = list(itertools.product([0, 1], repeat=len(a)))
    single = [spin((0, 0, 1), v * v / np.pi) @ spin((0, 1, 0), v) for v in a]
    amp = {s: float(not any(s)) for s in strings}
    for _ in range(reps):
        amp = {tuple(np.cumsum(out) % 2): sum(amp[s] * np.prod([u[o, i] for u, o, i in zip(single, out, s)]) for s in strings if amp[s])
               for out in strings}
    return np.array([amp[s] for s in strings])


AMPLITUDES = {"zz": zz_amplitudes, "pauli": pauli_amplitudes, "custom": custom_amplitudes}


@pytest.mark.parametrize("name,reps", CASES)
@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_matches_sums(name, reps, n):
    rng = np.random.default_rng(n * 10 + reps)
    left, right = (np.clip(rng.normal(size=(m, n)) * 1.7, -3, 3) / 3 * np.pi for m in (5, 4))
    expected = [[abs(np.vdot(AMPLITUDES[name](x, reps), AMPLITUDES[name](y, reps))) ** 2 for y in right] for x in left]
    assert np.max(np.abs(fidelity_kernel(name, reps)(left[:, None, :], right[None, :, :]) - expected)) < 1e-12


@pytest.mark.parametrize("name,reps", CASES)
def test_invariants(name, reps):
    rng = np.random.default_rng(7)
    a = np.clip(rng.normal(size=(6, 5)), -3, 3) / 3 * np.pi
    k = fidelity_kernel(name, reps)(a[:, None, :], a[None, :, :])
    assert np.allclose(np.diag(k), 1.0)
    assert np.allclose(k, k.T)
    assert (k >= -1e-12).all() and (k <= 1 + 1e-12).all()
    assert np.linalg.eigvalsh((k + k.T) / 2).min() > -1e-9


def test_bad_maps():
    with pytest.raises(ValueError):
        check_map("nope", 1)
    with pytest.raises(ValueError):
        check_map("zz", 3)


@pytest.mark.parametrize("name,reps", CASES)
@pytest.mark.parametrize("n", [1, 2, 3, 5, 9])
def test_block_form_equals_pairs(name, reps, n, monkeypatch):
    """Blocks of rows x landmarks come from products of halves or groups, not from the pair recursion."""
    from gramframe.functions import recursions as rec
    rng = np.random.default_rng(n + reps)
    x, lm = (np.clip(rng.normal(size=(m, n)) * 1.7, -3, 3) / 3 * np.pi for m in (1100, 6))
    pairs = rec.fidelity_kernel(name, reps)
    expected = pairs(x[:, None, :], lm[None, :, :])
    if n > 1 and (name, reps) in (("custom", 2), ("zz", 1), ("zz", 2)):
        monkeypatch.setitem(rec.KERNELS, (name, reps), None)     # the recursion is not called
    assert np.max(np.abs(rec.fidelity_matrix(name, reps, x, lm) - expected)) < 1e-12
    assert np.max(np.abs(rec.rows_x_landmarks(pairs, x, lm) - expected)) < 1e-12
    assert rec.fidelity_matrix(name, reps, x[:0], lm).shape == (0, 6)
