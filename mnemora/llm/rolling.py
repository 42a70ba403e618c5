"""Numpy rolling hashes and window minima over one text at a time."""

from __future__ import annotations

import numpy as np

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BINV = np.uint64(pow(int(_B), -1, 2**64))
_POW: dict[str, np.ndarray] = {}
#: Window positions fit these low bits of a packed key; longer texts go in pieces.
POS_BITS = 24
PIECE = 1 << 22
_POS = np.uint64((1 << POS_BITS) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    key = "i" if inverse else "p"
    have = _POW.get(key)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        base = np.full(size, _BINV if inverse else _B, dtype=np.uint64)
        base[0] = 1
        have = _POW[key] = np.cumprod(base, dtype=np.uint64)
    return have[:n]


_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))


def prefix(codes: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes any substring's hash."""
    values = _BYTE[codes] if codes.dtype == np.uint8 else mix(codes.astype(np.uint64) + np.uint64(1))
    out = np.empty(len(codes) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(values * powers(len(codes)), out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of codes[start:end] for each pair; equal contents have equal hashes."""
    inv = powers(len(pre), True)
    return mix((pre[end] - pre[start]) * inv[start] + (end - start).astype(np.uint64))


def gram_hashes(pre: np.ndarray, k: int) -> np.ndarray:
    n = len(pre) - 1 - k + 1
    return mix((pre[k:] - pre[:-k]) * powers(n, True) + np.uint64(k))


def window_minima(hashes: np.ndarray, w: int) -> np.ndarray:
    """For each window of w hashes the position of the smallest, rightmost on ties.

    Hashes are compared by their top 40 bits. Needs len(hashes) <= 2**24.
    """
    n = len(hashes)
    key = (hashes & ~_POS) | (_POS - np.arange(n, dtype=np.uint64))
    span, low = 1, key
    while span * 2 <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < w:
        low = np.minimum(low[: n - w + 1], low[w - span : w - span + n - w + 1])
    return (_POS - (low & _POS)).astype(np.int64)
