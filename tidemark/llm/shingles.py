"""Sets of word shingles and their minwise values, in numpy over the raw bytes of many texts."""

from __future__ import annotations

import numpy as np

from .common import mix64

#: Minwise values per set.
MINS = 64
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_UP = np.ones(1 << 12, np.uint64)
_ODD = (mix64(np.arange(5001, 5001 + MINS, dtype=np.uint64)) | np.uint64(1)).astype(np.uint64)
with np.errstate(over="ignore"):
    np.multiply.accumulate(np.full(len(_UP) - 1, 0x9E3779B97F4A7C15, np.uint64), out=_UP[1:])


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text, A-Z in lower case, and each word's text."""
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = _IS_WORD[raw]
    starts = np.flatnonzero(inside[:-1] & ~np.concatenate([[False], inside[:-2]])) if len(raw) else np.zeros(0, np.int64)
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    if len(inner):  # a word doesn't go on into the next text
        starts = np.union1d(starts, inner[inside[inner]])
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.zeros(len(raw), np.int64)
    first[starts] = starts
    place = np.arange(len(raw)) - np.maximum.accumulate(first)
    with np.errstate(over="ignore"):
        # a power for each place; beyond the table's end the place itself is mixed in
        value = _BYTE[_LOWER[raw]] * _UP[place & (len(_UP) - 1)]
        if len(place) and int(place.max()) >= len(_UP):
            value = value * (mix64((place >> 12).astype(np.uint64)) | np.uint64(1))
        value[~inside[:-1]] = 0
        hashes = np.add.reduceat(value, starts)
    return mix64(hashes), np.searchsorted(offsets, starts, "right") - 1


def sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of k-word shingles, ascending within each text, and the n + 1 offsets. A text of fewer words
    has its whole sequence as one; one without words has none."""
    hashes, of = words(raw, offsets)
    n = len(offsets) - 1
    counts = np.bincount(of, minlength=n)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(hashes), np.uint64)
        full = len(hashes) - k + 1
        if full > 0:
            for j in range(k):
                rolled[:full] = mix64(rolled[:full] + hashes[j : j + full])
        whole = np.zeros(len(hashes), bool)
        if full > 0:
            whole[:full] = of[:full] == of[k - 1 :]
        for i in np.flatnonzero((counts > 0) & (counts < k)):  # short texts
            h = np.zeros(1, np.uint64)
            for x in hashes[firsts[i] : firsts[i + 1]]:
                h = mix64(h + x)
            rolled[firsts[i]] = mix64(h + np.uint64(counts[i]))[0]
            whole[firsts[i]] = True
    values, text = rolled[whole], of[whole]
    ends = np.searchsorted(text, np.arange(n + 1))
    parts, sizes = [], np.zeros(n, np.int64)
    for i in range(n):
        if ends[i + 1] > ends[i]:
            part = np.unique(values[ends[i] : ends[i + 1]])
            parts.append(part)
            sizes[i] = len(part)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def minima(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, MINS) 32-bit minwise values; all ones for empty sets."""
    n = len(offsets) - 1
    out = np.full((n, MINS), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        at = offsets[:-1][full]
        with np.errstate(over="ignore"):
            for j in range(MINS):
                out[full, j] = np.minimum.reduceat(((values * _ODD[j]) >> np.uint64(32)).astype(np.uint32), at)
    return out


def set_keys(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums that name each set."""
    n = len(offsets) - 1
    out = np.zeros((2, n), np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        at = offsets[:-1][full]
        with np.errstate(over="ignore"):
            out[0, full] = np.add.reduceat(mix64(values), at)
            out[1, full] = np.add.reduceat(mix64(values ^ np.uint64(0xA5A5A5A55A5A5A5A)), at)
    return out[0], out[1]
