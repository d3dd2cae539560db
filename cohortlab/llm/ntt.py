"""Number-theoretic transforms over columns of arrays: exact cyclic convolutions modulo a prime.

A transform of length ``n`` (a power of two) runs along axis 0 of an ``(n, columns)``
array of unsigned 64-bit integers below the prime.  ``forward`` leaves its result in
bit-reversed order and ``inverse`` takes it so: a convolution needs no other order.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: fixed values: (prime, a generator of its multiplicative group, largest power of two that divides prime - 1)
PRIMES = ((2013265921, 31, 27), (1811939329, 13, 26), (469762049, 3, 26), (998244353, 3, 23))


@cache
def _roots(prime: int, generator: int, half: int, back: bool) -> np.ndarray:
    """The first ``half`` powers of a primitive ``2 * half``-th root of unity (or of its inverse)."""
    w = pow(generator, (prime - 1) // (2 * half), prime)
    w = pow(w, -1, prime) if back else w
    out = np.ones(1, np.uint64)
    while len(out) < half:
        out = np.concatenate([out, reduce(out * np.uint64(pow(w, len(out), prime)), prime)])
    return out[:half, None]


def reduce(x: np.ndarray, prime: int) -> np.ndarray:
    """``x`` modulo the prime."""
    return x - x // np.uint64(prime) * np.uint64(prime)


def forward(x: np.ndarray, prime: int, generator: int) -> np.ndarray:
    n, columns = x.shape
    p = np.uint64(prime)
    half = n // 2
    while half:
        v = x.reshape(-1, 2, half, columns)
        out = np.empty_like(v)
        total = v[:, 0] + v[:, 1]
        np.minimum(total, total - p, out=out[:, 0])  # below zero wraps around to a large number
        rest = v[:, 0] + (p - v[:, 1])
        out[:, 1] = reduce(rest * _roots(prime, generator, half, False), prime) if half > 1 else np.minimum(rest, rest - p)
        x, half = out, half // 2
    return x.reshape(n, columns)


def inverse(x: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Without the division by the length."""
    n, columns = x.shape
    p = np.uint64(prime)
    half = 1
    while half < n:
        v = x.reshape(-1, 2, half, columns)
        out = np.empty_like(v)
        turned = reduce(v[:, 1] * _roots(prime, generator, half, True), prime) if half > 1 else v[:, 1]
        total = v[:, 0] + turned
        np.minimum(total, total - p, out=out[:, 0])
        rest = v[:, 0] + (p - turned)
        np.minimum(rest, rest - p, out=out[:, 1])
        x, half = out, half * 2
    return x.reshape(n, columns)


def convolve(x: np.ndarray, y: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Cyclic convolution of each column of ``x`` with that of ``y``, modulo the prime."""
    z = reduce(forward(x, prime, generator) * forward(y, prime, generator), prime)
    return reduce(inverse(z, prime, generator) * np.uint64(pow(len(x), -1, prime)), prime)
