"""Suffix arrays by Larsson-Sadakane refinement, and Kasai's common prefixes, in numpy."""

from __future__ import annotations

import numpy as np

_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)
#: Bytes of the first sort, and the ranks of the empty suffixes at and beyond the end of the text.
_FIRST, _ENDS = 5, 8


def _words(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, the first one most significant; zeros after the end."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    out = np.empty(n, np.uint64)
    for k in range(min(8, n)):
        m = len(range(k, n, 8))
        out[k::8] = padded[k : k + 8 * m].view(">u8")
    return out


def _order(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The order of pairs of numbers below 2**32. Values are sorted together with their row, which is several times as
    fast as sorting rows by value; where both and the row fit 64 bits once, else the low halves and then the high."""
    n = len(high)
    at = np.arange(n, dtype=np.uint64)
    row = np.uint64(max(int(n - 1).bit_length(), 1))
    width = np.uint64(max(int(low.max(initial=0)).bit_length(), 1))
    if int(high.max(initial=0)).bit_length() + int(width) + int(row) <= 64:
        keys = high.astype(np.uint64)
        keys <<= width
        keys |= low
        keys <<= row
        keys |= at
        keys.sort()
        keys &= (np.uint64(1) << row) - np.uint64(1)
        return keys.view(np.int64)
    keys = (low.astype(np.uint64) << _HALF) | at
    keys.sort()
    by = (keys & _LOW).astype(np.int64)
    keys = (high[by].astype(np.uint64) << _HALF) | at
    keys.sort()
    return by[(keys & _LOW).astype(np.int64)]


def _begins(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Whether a row of sorted pairs differs from the one before."""
    new = np.ones(len(high), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    return new


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of the first ``depth`` bytes (at least) of their suffixes; and for each row how many
    bytes it is known to share with the row before. Up to 2**31 bytes.

    Suffixes are sorted by 5 bytes; then groups that are still equal, and only these, are refined by the rank of the
    suffix as many bytes on as are sorted already, which doubles that number each time. A rank is the number of the
    first row of the suffix's group, so refining a group leaves all others as they are."""
    n = len(text)
    shared = np.zeros(n, np.uint8 if depth < 120 else np.int64)
    if n < 2:
        return np.arange(n), shared
    words = _words(text)
    words >>= np.uint64(64 - 8 * _FIRST)
    if n <= 1 << 24:
        words <<= np.uint64(24)
        words |= np.arange(n, dtype=np.uint64)
        words.sort()
        order = (words & np.uint64((1 << 24) - 1)).astype(np.int64)
        words >>= np.uint64(24)
    else:
        order = _order((words >> _HALF).astype(np.uint32), (words & _LOW).astype(np.uint32))
        words = words[order]
    new = np.ones(n, bool)
    np.not_equal(words[1:], words[:-1], out=new[1:])
    del words
    rank = np.empty(n + _ENDS, np.uint32)
    rank[n:] = np.arange(_ENDS - 1, -1, -1)  # of suffixes that end within the first sort the shorter comes first
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(_ENDS, n + _ENDS, dtype=np.uint32), np.uint32(0)))
    # in the first round, which has nearly all rows, ranks without gaps: pairs of them take fewer bits
    dense = np.concatenate([np.arange(_ENDS, dtype=np.uint32), np.cumsum(new, dtype=np.uint32) + np.uint32(_ENDS - 1)])
    done = _FIRST
    while done < depth:
        open_ = ~new
        open_[:-1] |= ~new[1:]
        rows = np.flatnonzero(open_)  # rows of groups of two and more
        if not len(rows):
            break
        shared[~new] = done
        at = order[rows]
        own = np.cumsum(new[rows], dtype=np.uint32)
        far = rank[np.minimum(at + done, n + _ENDS - 1)]
        if dense is not None:
            far, dense = dense[far], None
        by = _order(own, far)
        order[rows] = at = at[by]
        fresh = _begins(own[by], far[by])
        new[rows] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, (rows + _ENDS).astype(np.uint32), np.uint32(0)))
        done *= 2
    shared[~new] = done
    shared[0] = 0
    return order, shared


#: Strips of the text that advance together.
_STRIPS = 8192


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int, shared: np.ndarray, least: int = 0) -> np.ndarray:
    """The length, up to ``most``, of the common prefix of each suffix and the one before it in order.

    Kasai's recurrence: going through the text, a suffix shares with its predecessor in order at least one byte less
    than the suffix one position before did. The text is cut into strips, through which the recurrence runs at once, one
    position of every strip a step. ``shared``, a lower bound from the sort, is where it begins; rows whose bound is below
    ``least`` keep that bound and aren't visited. Rows that share all sorted bytes have no order among them that the
    recurrence could go by, but their bound says all."""
    n = len(text)
    out = np.minimum(shared, most)
    rows = np.flatnonzero(out >= least)
    rows = rows[(rows > 0) & (out[rows] < most)]
    if not len(rows):
        return out
    row_of = np.full(n, -1, np.int32 if n < 1 << 31 else np.int64)
    row_of[order[rows]] = rows
    places = np.flatnonzero(row_of >= 0)  # in the order of the text
    row_of = row_of[places].astype(np.int64)
    before, bound = order[row_of - 1], out[row_of].astype(np.int64)
    words = _words(np.concatenate([text, np.zeros(most + 8, np.uint8)]))
    length = max(-(-len(places) // _STRIPS), 32)
    starts = np.arange(0, len(places), length)
    known, last = np.zeros(len(starts), np.int64), np.full(len(starts), -2, np.int64)
    for step in range(length):
        k = starts + step
        if k[-1] >= len(places):
            k = k[: np.searchsorted(k, len(places))]
        here, other = places[k], before[k]
        m = len(k)
        h = np.maximum(np.where(last[:m] == here - 1, known[:m] - 1, 0), bound[k])
        go = np.flatnonzero(h < most)
        a, b, size = here[go], other[go], h[go]
        while len(go):
            differ = words[a + size] ^ words[b + size]
            stop = np.flatnonzero(differ)
            if len(stop):
                d = differ[stop]
                lead = (d < np.uint64(1 << 56)).astype(np.int64)
                for j in range(2, 8):
                    lead += d < np.uint64(1 << (64 - 8 * j))
                h[go[stop]] = size[stop] + lead
            on = np.flatnonzero(differ == 0)
            size = size[on] + 8
            go, a, b = go[on], a[on], b[on]
            full = size >= most
            if full.any():
                h[go[full]] = most
                go, a, b, size = go[~full], a[~full], b[~full], size[~full]
        # beyond the end of the text there are no bytes
        h = np.minimum(np.minimum(h, most), n - np.maximum(here, other))
        known[:m], last[:m] = h, here
        out[row_of[k]] = h
    return out
