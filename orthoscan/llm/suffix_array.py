"""Suffix arrays by induced sorting, and permuted common prefixes, in whole-array steps.

Induced sorting (Nong, Zhang, Chan 2009): suffixes are smaller or larger than
their successors; the leftmost smaller ones are sorted by the substrings between
them, recursively, and the order of all others is induced from theirs in two
passes over the buckets of the first symbol.  What a bucket induces is placed by
array operations, in as many steps as runs of its own symbol are long.  Names of
substrings are written as two digits for the recursion, so that a text of n
symbols never has more than about the root of n buckets.

Common prefixes are computed by text position: where the symbols before a suffix
and before its predecessor in the array agree, its value is one less than the one
to its left, and only the other positions are compared (Karkkainen, Manzini,
Puglisi 2009).
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size have a bucket a symbol; larger ones are written with two digits.
BUCKETS = 512


def _smaller(t: np.ndarray) -> np.ndarray:
    """Whether each suffix of ``t``, which ends with its one least symbol, is smaller than the next one."""
    n = len(t)
    out = np.ones(n, dtype=bool)
    if n > 1:
        change = np.flatnonzero(t[:-1] != t[1:])  # holds n - 2
        rises = t[change] < t[change + 1]
        out[:-1] = np.repeat(rises, np.diff(change, prepend=-1))
    return out


class _Buckets:
    def __init__(self, t: np.ndarray, size: int):
        self.t, self.size = t, size
        counts = np.bincount(t, minlength=size)
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        self.used = np.flatnonzero(counts)
        self.smaller = _smaller(t)
        self.lms = np.flatnonzero(self.smaller[1:] & ~self.smaller[:-1]) + 1

    def _put(self, sa: np.ndarray, at: np.ndarray, pointer: np.ndarray, step: int) -> None:
        """Place the suffixes ``at`` in order, each at the pointer of its symbol, which moves on."""
        symbols = self.t[at]  # 16 bits: sorted by counting
        order = np.argsort(symbols, kind="stable")
        counts = np.bincount(symbols, minlength=self.size)
        symbols = symbols[order]
        rank = np.arange(len(at)) - (np.cumsum(counts) - counts)[symbols]
        sa[pointer[symbols] + step * rank - (step < 0)] = at[order]
        pointer += step * counts

    def induced(self, lms: np.ndarray) -> np.ndarray:
        """All suffixes, in the order that ``lms``, the leftmost smaller ones in their order, implies."""
        t, smaller = self.t, self.smaller
        sa = np.empty(len(t), dtype=np.int32 if len(t) < 1 << 31 else np.int64)
        first = t[lms]
        cut_lo, cut_hi = np.searchsorted(first, self.used, "left"), np.searchsorted(first, self.used, "right")
        left = self.starts.copy()
        for c, lo, hi in zip(self.used.tolist(), cut_lo.tolist(), cut_hi.tolist(), strict=True):
            done = int(self.starts[c])
            while done < left[c]:
                batch = sa[done : left[c]]
                done = int(left[c])
                batch = batch[batch > 0] - 1
                batch = batch[~smaller[batch]]
                if len(batch):
                    self._put(sa, batch, left, 1)
            if lo < hi:
                batch = lms[lo:hi] - 1
                self._put(sa, batch[batch >= 0], left, 1)
        right = self.ends.copy()
        right[0] = 0
        sa[0] = len(t) - 1  # the end, which induces a larger suffix only
        for c in self.used[:0:-1].tolist():
            done = int(self.ends[c])
            while right[c] < done:
                batch = sa[right[c] : done][::-1]
                done = int(right[c])
                batch = batch[batch > 0] - 1
                batch = batch[smaller[batch]]
                if len(batch):
                    self._put(sa, batch, right, -1)
            batch = sa[self.starts[c] : left[c]][::-1]
            batch = batch[batch > 0] - 1
            batch = batch[smaller[batch]]
            if len(batch):
                self._put(sa, batch, right, -1)
        return sa


def _names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ranks of the substrings from each of ``lms`` to the next, equal ones alike, given their ``order`` (positions)."""
    last = np.zeros(len(t), dtype=np.int64)
    last[lms] = np.append(lms[1:], lms[-1])
    a, b = order[:-1], order[1:]
    size = last[a] - a
    same = size == last[b] - b
    open_ = np.flatnonzero(same)
    step = 0
    while len(open_):
        differ = t[a[open_] + step] != t[b[open_] + step]
        same[open_[differ]] = False
        open_ = open_[~differ & (size[open_] > step)]
        step += 1
    rank = np.empty(len(t), dtype=np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(~same)])
    return rank[lms]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``symbols`` (integers from 0 to 65,534) in order; a suffix comes before its extensions."""
    if not len(symbols):
        return np.zeros(0, dtype=np.int64)
    t = np.append(symbols + np.uint16(1), 0).astype(np.uint16)
    buckets = _Buckets(t, int(t.max()) + 1)
    lms = buckets.lms
    if len(lms) > 1:
        by_symbol = lms[np.argsort(t[lms], kind="stable")]
        order = buckets.induced(by_symbol)
        is_lms = np.zeros(len(t), dtype=bool)
        is_lms[lms] = True
        order = order[is_lms[order]]
        names = _names(t, lms, order)
        most = int(names.max()) + 1
        if most < len(lms):
            if most <= BUCKETS:
                turn = suffix_array(names)
            else:
                base = int(np.ceil(np.sqrt(most)))
                turn = suffix_array(np.stack(np.divmod(names, base), axis=1).reshape(-1))
                turn = turn[turn % 2 == 0] // 2
            order = lms[turn]
        lms = order
    return buckets.induced(lms)[1:]


def common_prefixes(data: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """By text position: how many bytes a suffix of ``data`` (uint8) shares with the one before it in ``sa``; 0 for the first."""
    n = len(data)
    if n < 2:
        return np.zeros(n, dtype=np.int64)
    before = np.empty(n, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    own = np.ones(n, dtype=bool)  # to be compared
    both = np.flatnonzero((before > 0) & (np.arange(n) > 0))
    own[both[data[both - 1] == data[before[both] - 1]]] = False
    at = np.flatnonzero(own & (before >= 0))
    other, length = before[at], np.zeros(len(at), dtype=np.int64)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    words = np.ndarray(n + 1, dtype="<u8", buffer=padded, strides=(1,))
    most = n - np.maximum(at, other)
    open_ = np.arange(len(at))
    while len(open_):
        k = length[open_]
        x = words[at[open_] + k] ^ words[other[open_] + k]
        k = k + np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3)
        length[open_] = np.minimum(k, most[open_])
        open_ = open_[(x == 0) & (k < most[open_])]
    value = np.zeros(n, dtype=np.int64)
    value[at] = length
    anchor = np.maximum.accumulate(np.where(own, np.arange(n), 0))
    return np.maximum(0, value[anchor] - (np.arange(n) - anchor))
