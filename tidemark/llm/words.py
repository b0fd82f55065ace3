"""Hashes of the words of whole Arrow columns, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .tokens import column_bytes

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _STEP = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_POWERS: list[np.ndarray] = []
#: Bytes of words: all but white space in ASCII; and letters, digits and bytes beyond ASCII.
SOLID, ALNUM = np.ones(256, bool), np.zeros(256, bool)
SOLID[[32, *range(9, 14)]] = False
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_BYTE = _BYTE[_LOWER]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _STEP, np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0][:n], _POWERS[1][:n]


def words(values: pa.Array, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, with A-Z lower-cased; its value's number; the number of words of each value)."""
    data, offsets = column_bytes(values)
    size = int(offsets[-1])
    if not size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(values), np.int64)
    data = data[:size]
    solid = inside[data]
    first = np.zeros(size, bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(solid & (first | ~np.append(False, solid[:-1])))
    last = np.zeros(size, bool)
    last[offsets[1:][np.diff(offsets) > 0] - 1] = True
    ends = np.flatnonzero(solid & (last | ~np.append(solid[1:], False))) + 1
    up, down = _powers(size + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(_LOWER_BYTE[data] * up[:size], out=total[1:])
        h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    n = np.diff(np.searchsorted(starts, offsets))
    return h, np.repeat(np.arange(len(values)), n), n
