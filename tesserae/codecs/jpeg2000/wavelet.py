"""The 5/3 and 9/7 wavelets, by lifting on even and odd places."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

ALPHA, BETA, GAMMA, DELTA, K = -1.586134342059924, -0.052980118572961, 0.882911075530934, 0.443506852043971, 1.230174104914001


@lru_cache(maxsize=1024)
def _places(n: int, first: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The rows that stand at even and at odd places of n rows extended symmetrically by six or more, and the place of the first."""
    left = 6 + (first & 1)
    right = 6 + ((n + left) & 1)
    rows = np.pad(np.arange(n), (left, right), mode="reflect")
    return rows[0::2], rows[1::2], left


def _halves(a: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Even and odd rows of a, extended symmetrically by six rows or more, and the place of its first row."""
    even, odd, left = _places(len(a), first & 1)
    return a[even], a[odd], left


def _weave(even: np.ndarray, odd: np.ndarray, at: int, n: int) -> np.ndarray:
    out = np.empty((2 * len(even), even.shape[1]), even.dtype)
    out[0::2], out[1::2] = even, odd
    return out[at : at + n]


def _synthesise(a: np.ndarray, first: int, reversible: bool) -> np.ndarray:
    """Rows from interleaved low (even) and high (odd) rows whose first place is `first`."""
    if len(a) == 1:
        return a if not first & 1 else (a >> 1 if reversible else a / 2)
    e, o, at = _halves(a, first)
    if reversible:
        e[1:] -= (o[:-1] + o[1:] + 2) >> 2
        o[:-1] += (e[:-1] + e[1:]) >> 1
    else:
        e *= K
        o /= K
        e[1:] -= DELTA * (o[:-1] + o[1:])
        o[:-1] -= GAMMA * (e[:-1] + e[1:])
        e[1:] -= BETA * (o[:-1] + o[1:])
        o[:-1] -= ALPHA * (e[:-1] + e[1:])
    return _weave(e, o, at, len(a))


def _analyse(a: np.ndarray, first: int, reversible: bool) -> np.ndarray:
    if len(a) == 1:
        return a if not first & 1 else a * 2
    e, o, at = _halves(a, first)
    if reversible:
        o[:-1] -= (e[:-1] + e[1:]) >> 1
        e[1:] += (o[:-1] + o[1:] + 2) >> 2
    else:
        o[:-1] += ALPHA * (e[:-1] + e[1:])
        e[1:] += BETA * (o[:-1] + o[1:])
        o[:-1] += GAMMA * (e[:-1] + e[1:])
        e[1:] += DELTA * (o[:-1] + o[1:])
        e /= K
        o *= K
    return _weave(e, o, at, len(a))


def inverse(bands: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], x0: int, y0: int, width: int, height: int, reversible: bool) -> np.ndarray:
    """A resolution of given place and size from its LL, HL, LH and HH bands."""
    ll, hl, lh, hh = bands
    out = np.zeros((height, width), np.int64 if reversible else np.float64)
    ex, ey = x0 & 1, y0 & 1
    out[ey::2, ex::2], out[ey::2, 1 - ex :: 2] = ll, hl
    out[1 - ey :: 2, ex::2], out[1 - ey :: 2, 1 - ex :: 2] = lh, hh
    if not out.size:
        return out
    out = _synthesise(out.T, x0, reversible).T
    return _synthesise(np.ascontiguousarray(out), y0, reversible)


def forward(a: np.ndarray, reversible: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """LL, HL, LH and HH of an array at the origin."""
    a = _analyse(np.ascontiguousarray(a), 0, reversible)
    a = _analyse(a.T, 0, reversible).T
    return a[0::2, 0::2], a[0::2, 1::2], a[1::2, 0::2], a[1::2, 1::2]
