"""Runs of repeated words: maximal stretches with a period, by a suffix tree and its branching tandem repeats.

A tandem repeat is a string twice in a row; it is branching if the word after it isn't the one that would go on with it. Both
halves of a branching repeat of 2q words are leaves below one inner node of depth q, under different children. So for each
node the leaves of all children but the largest look for a partner, q places on and q places back, among the node's leaves:
each leaf is looked at O(log n) times. A run ends with a branching repeat of its period; rotating that to the left as long as
the words agree gives the run's start, and repeats of multiples of a period end with it in the same run and are merged.

The tree is held as a suffix array with common prefixes, whose intervals are the inner nodes; a node's leaves are a range of
ranks, so membership is two comparisons. A run of `least` words or more holds strings of half as many words that come twice
in its document, and is covered by them. So the tree is built of the stretches that such strings cover, put apart from each
other by separators; a document without any has no runs. Documents go through a worker in blocks of about BLOCK words, each
whole; memory is that of a block or of the longest document.

Words are what stands between ASCII white space. Null texts count as empty. Repeated rows get equal rows, null ids are kept,
other columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, text_of

#: Words of documents that are looked at together, and of stretches in one tree.
BLOCK, TREE = 400_000, 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def suffix_order(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array and the ranks of a string whose last symbol is unique, by doubling the length that is sorted by."""
    n, span = len(t), 1
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: n - span] = rank[span:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])
        rank[order] = new
        span *= 2
        if new[-1] == n - 1:
            return order, rank
        if span >= n:
            raise ValueError("the last symbol must be unique")


def common_prefixes(t: np.ndarray, order: np.ndarray, rank: np.ndarray) -> list[int]:
    """For each rank, the length of the common prefix of its suffix and the one before it; -1 at both ends."""
    n, words, places, ranks = len(t), t.tolist(), order.tolist(), rank.tolist()
    out, h = [-1] * (n + 1), 0
    for i in range(n):
        r = ranks[i]
        if r == 0:
            h = 0
            continue
        j = places[r - 1]
        while words[i + h] == words[j + h]:  # ends at a separator at the latest
            h += 1
        out[r] = h
        if h:
            h -= 1
    return out


def small_children(lcp: list[int]) -> np.ndarray:
    """Rows (first rank, end, depth, node's first rank, node's end) of all children but each node's largest."""
    out: list[tuple[int, int, int, int, int]] = []
    stack: list[tuple[int, list[int]]] = [(-1, [])]
    for k in range(1, len(lcp)):
        depth, left = lcp[k], k - 1
        while depth < stack[-1][0]:
            d, cuts = stack.pop()
            left = cuts[0]
            if d:
                if len(cuts) == 2:  # two children
                    a, b = cuts
                    out.append((a, b, d, a, k) if b - a <= k - b else (b, k, d, a, k))
                else:
                    ends = [*cuts[1:], k]
                    largest = max(range(len(cuts)), key=lambda i: ends[i] - cuts[i])
                    out += [(a, b, d, left, k) for i, (a, b) in enumerate(zip(cuts, ends)) if i != largest]
        if depth > stack[-1][0]:
            stack.append((depth, [left, k]))
        else:
            stack[-1][1].append(k)
    return np.array(out, dtype=np.int64).reshape(-1, 5)


def branching_repeats(t: np.ndarray) -> np.ndarray:
    """Rows (end, half) of the branching tandem repeats of t, each once, sorted. t has a unique last symbol."""
    order, rank = suffix_order(t)
    first, end, depth, low, high = small_children(common_prefixes(t, order, rank)).T
    sizes = end - first
    leaf = np.arange(int(sizes.sum())) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)
    i = order[leaf]
    depth, low, high = (np.repeat(x, sizes) for x in (depth, low, high))
    found = []
    for a in (i, i - depth):  # as the first half, as the second
        inside = (a >= 0) & (a + depth < len(t))
        a, d, lo, hi = a[inside], depth[inside], low[inside], high[inside]
        other = rank[np.where(a == i[inside], a + d, a)]
        both = (other >= lo) & (other < hi)
        a, d = a[both], d[both]
        branching = t[a + d] != t[a + 2 * d]
        found.append(np.stack([a + 2 * d, d])[:, branching])
    return np.unique(np.concatenate(found, axis=1), axis=1).T


def _rotated(t: np.ndarray, start: int, period: int) -> int:
    """The first place from which t has the period up to start + period."""
    step = 16
    while True:
        low = max(start - step, 0)
        differ = np.flatnonzero(t[low:start] != t[low + period : start + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        start, step = low, step * 2
        if not start:
            return 0


def maximal_runs(t: np.ndarray, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of at least `least` symbols and twice their smallest period, sorted."""
    words, runs, last, here = t.tolist(), [], -1, []
    for end, half in branching_repeats(t).tolist():
        if end != last:
            last, here = end, []
        start = end - 2 * half
        if any(half % q == 0 and s <= start for s, q in here):
            continue  # of a run that is known by its smallest period
        if start and words[start - 1] == words[start + half - 1]:
            start = _rotated(t, start, half)
        here.append((start, half))
        if end - start >= least:
            runs.append((start, end - start, half))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def stretches(ids: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[tuple[int, int]]:
    """The stretches that strings of `width` words cover which come twice in a document; bounds: where documents begin, and the end.

    Strings are told apart by hashes, so a stretch may come in vain, but none is missed.
    """
    n = len(ids) - width + 1
    if n <= 0:
        return
    document = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    key = document[:n].astype(np.uint64)
    for k in range(width):
        key = (key ^ (key >> np.uint64(29))) * _MIX + ids[k : n + k].astype(np.uint64)
    key = (key ^ (key >> np.uint64(32))) * _MIX
    at = np.flatnonzero(document[:n] == document[width - 1 :])  # within a document
    order = at[np.argsort(key[at], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(ids) + 1, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    starts = np.flatnonzero(twice)
    if not len(starts):
        return
    apart = np.flatnonzero((np.diff(starts) > width) | (document[starts[1:]] != document[starts[:-1]]))
    yield from zip(starts[np.concatenate([[0], apart + 1])].tolist(), (starts[np.concatenate([apart, [len(starts) - 1]])] + width).tolist())


def runs_of(documents: list[list[bytes]], least: int = 12) -> list[list[tuple[int, int, int]]]:
    """The runs of each of some documents, given as words."""
    known: dict[bytes, int] = {}
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in documents], dtype=np.int64)])
    ids = np.fromiter((known.setdefault(w, len(known)) for d in documents for w in d), dtype=np.int64, count=int(bounds[-1]))
    found: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    held: list[tuple[int, int]] = []

    def settle() -> None:
        pieces, places = [], []
        for k, (a, b) in enumerate(held):
            pieces += [ids[a:b], [len(known) + k]]
            places.append(a)
        t = np.concatenate(pieces).astype(np.int64)
        starts = np.cumsum([0] + [b - a + 1 for a, b in held[:-1]])
        for start, length, period in maximal_runs(t, least):
            k = int(np.searchsorted(starts, start, side="right")) - 1
            place = places[k] + start - int(starts[k])
            d = int(np.searchsorted(bounds, place, side="right")) - 1
            found[d].append((place - int(bounds[d]), length, period))
        held.clear()

    size = 0
    for a, b in stretches(ids, bounds, max(1, (least + 1) // 2)):
        held.append((a, b))
        size += b - a
        if size >= TREE:
            settle()
            size = 0
    if held:
        settle()
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but for those that a run holds after its first period."""
    if not runs:
        return words
    stays = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        stays[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(stays).tolist()]


def periodic_runs(docs: DataFrame, least: int = 12, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed, the words left, of each row.

    Texts go once through a worker and are not moved.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, first, words = batch.column(1), 0, []
            size = 0
            for row in range(batch.num_rows):
                words.append(texts[row].as_buffer().to_pybytes().split())
                size += len(words[-1])
                if size >= BLOCK or row + 1 == batch.num_rows:
                    found = runs_of(words, least)
                    rows = pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found], _RUNS)
                    left = pa.array([b" ".join(collapsed(w, r)) for w, r in zip(words, found)], pa.binary()).cast(pa.string())
                    counts = pa.array([len(w) for w in words], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(words)), counts, rows, left], ["doc_id", "n_words", "runs", "collapsed"])
                    first, words, size = row + 1, [], 0

    base = docs.select(docs[id_col].alias("doc_id"), text_of(docs[text_col]).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    return map_arrow(base, run, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string", "runs")
