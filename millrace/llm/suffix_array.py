"""Suffix arrays by induced sorting, and permuted longest common prefixes, in whole-array steps.

Suffixes are of type S if they are smaller than the next one, else of type L; leftmost S suffixes (LMS) follow an L. LMS
substrings are sorted by induction and named; while names repeat, pairs of names are named again, each round over twice the
length, until the LMS suffixes are in order. From them one pass upward induces the L suffixes and one downward the S suffixes.
A pass takes a bucket, of suffixes with one first symbol, at a time, and as many rounds as that symbol stands in a row.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type S. The last symbol is the unique smallest."""
    n = len(t)
    step = np.empty(n, dtype=np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int32) - t[:-1])
    step[-1] = 1
    where = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(where[::-1])[::-1]] > 0


class _Buckets:
    def __init__(self, t: np.ndarray) -> None:
        self.sizes = np.bincount(t)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes


def _place(sa: np.ndarray, t: np.ndarray, found: np.ndarray, heads: np.ndarray, sign: int) -> None:
    """Puts suffixes at the heads (or, downward, tails) of their buckets, in the order given."""
    symbols = t[found]
    order = np.argsort(symbols, kind="stable")
    found, symbols = found[order], symbols[order]
    counts = np.bincount(symbols, minlength=len(heads))
    rank = np.arange(len(found)) - np.repeat(np.cumsum(counts) - counts, counts)
    sa[heads[symbols] + (rank if sign > 0 else -1 - rank)] = found
    heads += sign * counts


def _induce(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, b: _Buckets) -> np.ndarray:
    """The suffix array that the LMS suffixes, in this order, induce."""
    sa = np.full(len(t), -1, dtype=np.int32)
    tails = b.ends.copy()
    _place(sa, t, lms[::-1], tails, -1)
    heads = b.starts.copy()

    def upward(chunk: np.ndarray) -> None:
        before = chunk[chunk > 0] - 1
        before = before[~is_s[before]]
        if len(before):
            _place(sa, t, before, heads, 1)

    symbols = np.flatnonzero(b.sizes)
    for c in symbols.tolist():
        at = int(b.starts[c])
        while at < heads[c]:
            at, chunk = int(heads[c]), sa[at : int(heads[c])]
            upward(chunk)
        upward(sa[int(tails[c]) : int(b.ends[c])])

    tails = b.ends.copy()

    def downward(chunk: np.ndarray) -> None:
        before = chunk[chunk > 0][::-1] - 1
        before = before[is_s[before]]
        if len(before):
            _place(sa, t, before, tails, -1)

    sa[0] = len(t) - 1  # the last symbol's suffix has no smaller one to be induced from
    tails[t[-1]] -= 1
    for c in symbols[::-1].tolist():
        at = int(b.ends[c])
        while at > tails[c]:
            at, chunk = int(tails[c]), sa[int(tails[c]) : at]
            downward(chunk)
        downward(sa[int(b.starts[c]) : int(heads[c])])
    return sa


def _names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings, by place; order: the substrings sorted, as places in lms."""
    stops = np.append(lms[1:], lms[-1])  # the last one is the last symbol alone
    lengths = stops - lms + 1
    a, b = order[:-1], order[1:]
    same = lengths[a] == lengths[b]
    live = np.flatnonzero(same)
    for k in range(int(lengths.max(initial=1))):
        live = live[lengths[a[live]] > k]
        if not len(live):
            break
        differ = t[lms[a[live]] + k] != t[lms[b[live]] + k]
        same[live[differ]] = False
        live = live[~differ]
    names = np.empty(len(lms), dtype=np.int64)
    names[order] = np.concatenate([[0], np.cumsum(~same)])
    return names


def _sorted_lms(names: np.ndarray) -> np.ndarray:
    """The order of the LMS suffixes, from the names of their substrings."""
    n, span = len(names), 1
    while True:
        most = int(names.max(initial=0)) + 1
        if most == n:
            out = np.empty(n, dtype=np.int64)
            out[names] = np.arange(n)
            return out
        after = np.zeros(n, dtype=np.int64)
        after[: n - span] = names[span:] + 1
        key = names * (most + 1) + after
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])
        names = np.empty(n, dtype=np.int64)
        names[order] = fresh
        span *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffix array of t, an array of small whole numbers whose last one is its unique smallest."""
    if len(t) < 2:
        return np.arange(len(t))
    is_s = _types(t)
    lms = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(np.int32)
    b = _Buckets(t)
    if len(lms) > 1:
        rough = _induce(t, is_s, lms, b)
        place = np.full(len(t), -1, dtype=np.int32)
        place[lms] = np.arange(len(lms))
        order = place[rough]
        order = order[order >= 0]
        lms = lms[_sorted_lms(_names(t, lms, order))]
    return _induce(t, is_s, lms, b)


def permuted_lcp(t: np.ndarray, sa: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """For each place, the length of the common prefix of its suffix and the one before it in the suffix array.

    rest: the number of symbols after each place, itself included, up to which a prefix may reach. A value follows from the
    place before, less one, wherever both suffixes have equal symbols before them; only the others are compared, eight
    symbols at a time. t has values below 256.
    """
    n = len(t)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([t.astype(np.uint8), np.zeros(8, dtype=np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]
    words = np.ascontiguousarray(words).view("<u8").ravel()
    here = np.arange(n)
    implied = np.zeros(n, dtype=bool)
    ok = (here > 0) & (before > 0)
    at = here[ok]
    implied[at] = (t[at - 1] == t[before[at] - 1]) & (rest[at - 1] == rest[at] + 1) & (rest[before[at] - 1] == rest[before[at]] + 1)
    plcp = np.zeros(n, dtype=np.int64)
    live = np.flatnonzero(~implied & (before >= 0))
    while len(live):
        a = live + plcp[live]
        c = before[live] + plcp[live]
        inside = np.minimum(rest[live], rest[before[live]]) > plcp[live]
        live, a, c = live[inside], a[inside], c[inside]
        diff = words[np.minimum(a, n - 1)] ^ words[np.minimum(c, n - 1)]
        same = np.where(diff == 0, 8, np.bitwise_count((diff & -diff) - np.uint64(1)) >> 3)
        plcp[live] += same
        live = live[same == 8]
    plcp = np.where(before >= 0, np.minimum(plcp, np.minimum(rest, rest[before])), 0)
    last = np.maximum.accumulate(np.where(implied, -1, here))
    return np.where(implied, np.maximum(plcp[last] - (here - last), 0), plcp)
