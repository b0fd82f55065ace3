"""Counts of byte strings packed by their length, in numpy.

Strings of at most 8 bytes become one big-endian unsigned word, of at most 16 bytes two, so that the order of
words is the order of bytes. Packed strings are sorted by radix, 16 bits at a time from the last, and counted in
runs. Longer strings stand in buckets of widths that double, each sorted by its bytes. No string may hold a zero
byte: zeros fill up.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from .tokens import WIDTH, ragged

_MASK = np.array([((1 << 8 * n) - 1) << (64 - 8 * n) for n in range(9)], dtype=np.uint64)


class Runs(NamedTuple):
    """Equal strings of a group: where one of them stands, its group, how many there are, in how many owners."""

    start: np.ndarray
    length: np.ndarray
    group: np.ndarray
    n: np.ndarray
    owners: np.ndarray


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and value of each maximal run of True bytes that lies in one value."""
    size = len(inside)
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last, full = np.zeros(size, bool), np.zeros(size, bool), np.diff(offsets) > 0
    first[offsets[:-1][full]] = True
    last[offsets[1:][full] - 1] = True
    starts = np.flatnonzero(inside & (first | ~np.append(False, inside[:-1])))
    ends = np.flatnonzero(inside & (last | ~np.append(inside[1:], False))) + 1
    return starts, ends - starts, np.searchsorted(offsets, starts, side="right") - 1


def radix_order(order: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """`order` sorted by the unsigned keys, the first key first; equal ones stay as they are."""
    for key in reversed(keys):
        for shift in range(0, 8 * key.dtype.itemsize, 16):
            digit = (key >> np.array(shift, key.dtype)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]  # numpy sorts 16-bit values by radix
    return order


def _word(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at: int) -> np.ndarray:
    words = np.ndarray((len(data) - 8,), dtype=">u8", buffer=data, strides=(1,))
    return words[starts + at].astype(np.uint64) & _MASK[np.clip(lengths - at, 0, 8)]


def _counted(order: np.ndarray, change: np.ndarray, starts: np.ndarray, lengths: np.ndarray, group: np.ndarray, owner: np.ndarray) -> Runs:
    new_owner = change | np.append(True, owner[order][1:] != owner[order][:-1])
    at = np.flatnonzero(change)
    one = order[at]
    return Runs(starts[one], lengths[one], group[one], np.diff(np.append(at, len(order))), np.add.reduceat(new_owner.astype(np.int64), at) if len(at) else at)


def _changes(order: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    change = np.zeros(len(order), bool)
    change[:1] = True
    for key in keys:
        k = key[order]
        change[1:] |= k[1:] != k[:-1]
    return change


def count(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, group: np.ndarray, owner: np.ndarray) -> list[Runs]:
    """The distinct strings data[start : start + length] of each group. data ends with at least WIDTH bytes of zero; owners must not fall."""
    out = []
    for least, most in ((1, 8), (9, 16)):
        use = np.flatnonzero((lengths >= least) & (lengths <= most))
        if len(use):
            s, n = starts[use], lengths[use]
            keys = [_word(data, s, n, at) for at in range(0, most, 8)] + [group[use].astype(np.uint32)]
            order = radix_order(np.arange(len(use)), keys)
            out.append(_counted(order, _changes(order, keys), s, n, group[use], owner[use]))
    width = 32
    while (lengths > width // 2).any():
        use = np.flatnonzero((lengths > max(16, width // 2)) & (lengths <= width))
        if len(use):
            s, n = starts[use], lengths[use]
            table = np.zeros((len(use), width), np.uint8)
            table[np.repeat(np.arange(len(use)), n), ragged(np.zeros(len(n), np.int64), n)] = data[ragged(s, n)]
            key = table.view(f"S{width}").ravel()
            order = np.lexsort((group[use], key))
            out.append(_counted(order, _changes(order, [key, group[use]]), s, n, group[use], owner[use]))
        width *= 2
    return out


def padded(data: np.ndarray) -> np.ndarray:
    """data with the zeros that count() asks for after it."""
    return np.concatenate([data, np.zeros(WIDTH + 8, np.uint8)])
