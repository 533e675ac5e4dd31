"""Sets of word shingles as 64-bit hashes, and MinHash signatures of them.

Words are what lies between the bytes of the six ASCII white-space characters; only A-Z are lower-cased. Both hold on UTF-8
bytes, of which no multi-byte character has one of those. Hashing is by array operations over a whole text.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240517))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_BYTE[[9, 10, 11, 12, 13, 32]] = 0
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_STEP = _U(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(64, _STEP, dtype=np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(max(n, 2 * len(_POWERS)), _STEP, dtype=np.uint64))
    return _POWERS


def word_hashes(text: str | None) -> np.ndarray:
    if not text:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(text.encode("utf-8", "replace").lower(), np.uint8)
    blank = _BLANK[raw]
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    if not len(starts):
        return np.empty(0, np.uint64)
    gaps = np.diff(np.append(starts, len(raw)))
    at = np.arange(starts[0], len(raw)) - np.repeat(starts, gaps)
    with np.errstate(over="ignore"):
        return _mixed(np.add.reduceat(_BYTE[raw[starts[0] :]] * _powers(int(gaps.max()))[at], starts - starts[0]))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of so many words; of a shorter text, one of all its words."""
    h = word_hashes(text)
    if not len(h):
        return h
    words = min(words, len(h))
    n = len(h) - words + 1
    with np.errstate(over="ignore"):
        total = np.full(n, _U(words), dtype=np.uint64)
        for i in range(words):
            total = _mixed(total * _STEP + h[i : i + n])
    return np.unique(total)


def multipliers(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(7))
    return rng.integers(1, 2**32, (coordinates, 1), dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, (coordinates, 1), dtype=np.uint32)


def signature(shingles: np.ndarray, coefficients: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least value of each coordinate's hash over a set that isn't empty; uint32."""
    a, b = coefficients
    x = (shingles >> _U(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), 2048):
            part = x[at : at + 2048] * a + b
            part ^= part >> np.uint32(15)
            part *= np.uint32(0x2C1B3C6D)
            np.minimum(out, part.min(axis=1), out=out)
    return out
