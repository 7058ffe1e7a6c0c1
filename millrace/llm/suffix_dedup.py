"""Removal of repeated passages by suffix arrays over shards.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a document before, or before in the same one.

Windows, the strings of LENGTH bytes, are dealt by their minimizer, the least hash of the ANCHOR-byte strings inside: equal
windows have equal ones. Neighbouring windows with one minimizer make a run, and its windows one string, so runs are few and
are dealt by their minimizer's and string's hashes alone:

1. Each task finds the runs of its documents. Of equal strings in a batch only the first is dealt; the others' windows have
   all started earlier, wherever. So a passage that a third of all documents share sends one row a batch.
2. Runs come together by minimizer, sorted by string; those of a minimizer that one in SAMPLE of the documents shows to be hot (the
   edge of a passage that many documents hold amid other text) by minimizer and string. Later runs of a string are settled in
   the same way. First ones whose
   minimizer has other strings too, or which hold their minimizer twice, need their bytes; the rest is kept.
3. The bytes are fetched from the texts, by document, and come together by minimizer. They fill shards of up to SHARD bytes;
   a suffix array by induced sorting and permuted common prefixes of each tell which windows are equal. Of these all but the
   first go. A minimizer with over HOT_STRINGS strings (the edge of a passage among many neighbours) isn't gathered: its
   strings stay spread, and Spark groups their windows by 128-bit hashes, with map-side combine; frequent windows stay spread.
4. The windows that go are gathered by document and cut out of its text.

Strings are compared by 64-bit hashes within equal 64-bit minimizers. Null texts count as empty; texts shorter than LENGTH
bytes stay whole. Null ids come last; documents with one id are in the order of their texts' hashes, and rows equal in id and
text are one document and get equal rows. Ids are whole numbers; others are refused. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import fits, map_arrow, spread_join, staged, text_of
from .suffix_array import permuted_lcp, suffix_array

LENGTH, ANCHOR = 100, 48
SPAN = LENGTH - ANCHOR + 1
SHARD = 3_000_000
#: A minimizer with more strings is hot; so many hot ones, of 8 bytes each, may be broadcast.
HOT_STRINGS, BROADCAST_ROWS = 1_000, 300_000
#: One in so many texts, by hash, tells which minimizers have over HOT_STRINGS runs. That decides where runs go, never what goes.
SAMPLE = 16
#: Odd multipliers for the rolling and the final hash.
_STEP, _MIX = 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD
_RUN = "m long, h long, d long, t long, at int, n int, gone boolean, twice boolean"


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each ANCHOR-byte string: polynomials over 1, 2, 4, ... bytes, put together for the bits of ANCHOR."""
    power, size, level = _STEP, 1, (data.astype(np.uint64) + np.uint64(1)) * np.uint64(_MIX)
    level ^= level >> np.uint64(29)
    total: np.ndarray | None = None
    done = 0
    while True:
        if ANCHOR & size:
            tail = level[done : done + len(data) - ANCHOR + 1]
            total = tail.copy() if total is None else total[: len(tail)] * np.uint64(power) + tail
            done += size
        if done == ANCHOR:
            break
        level = level[:-size] * np.uint64(power) + level[size:]
        power, size = power * power & (1 << 64) - 1, 2 * size
    total ^= total >> np.uint64(32)
    total *= np.uint64(_MIX)
    return total ^ total >> np.uint64(29)


def least_of_windows(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def runs_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, first window, number of windows (SPAN at most), and whether the minimizer stands there twice."""
    hashes = anchor_hashes(data)
    least = least_of_windows(hashes, SPAN)
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    sizes = np.diff(np.append(starts, len(least)))
    pieces = -(-sizes // SPAN)
    own = np.repeat(np.arange(len(sizes)), pieces)
    offset = (np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * SPAN
    at, n = starts[own] + offset, np.minimum(sizes[own] - offset, SPAN)
    # places whose hash is the least of a window around them; a run holds its minimizer twice if two of them have its hash
    edge = np.full(SPAN - 1, 2**64 - 1, dtype=np.uint64)
    places = np.flatnonzero(~least_of_windows(np.concatenate([edge, ~least, edge]), SPAN) == hashes)
    kinds, kind = np.unique(hashes[places], return_inverse=True)
    keys = np.sort(kind * len(data) + places)
    mine = np.searchsorted(kinds, least[at]) * len(data)
    twice = np.searchsorted(keys, mine + at + n - 1 + SPAN) - np.searchsorted(keys, mine + at) > 1
    return least[at], at, n, twice


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_64_intdigest

    for batch in batches:
        found, hashed, keys = [], [], []
        for d, t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            data = text.as_py().encode()
            if len(data) < LENGTH:
                continue
            m, at, n, twice = runs_of(np.frombuffer(data, np.uint8))
            found.append((m, at, n, twice))
            hashed += [xxh3_64_intdigest(data[a:b]) for a, b in zip(at.tolist(), (at + n + LENGTH - 1).tolist())]
            keys.append((d, t))
        if not found:
            continue
        m, at, n, twice = (np.concatenate(x) for x in zip(*found))
        lengths = [len(x[0]) for x in found]
        d, t = (np.repeat(np.array(x, dtype=np.int64), lengths) for x in zip(*keys))
        h = np.array(hashed, dtype=np.uint64)
        order = np.lexsort((at, t, d, h, m))
        m, h, d, t, at, n, twice = (x[order] for x in (m, h, d, t, at, n, twice))
        equal = np.concatenate([[False], (m[1:] == m[:-1]) & (h[1:] == h[:-1])])
        again = equal & np.concatenate([[False], (d[1:] == d[:-1]) & (t[1:] == t[:-1]) & (at[1:] == at[:-1])])
        m = np.where(equal, h ^ d.astype(np.uint64) * np.uint64(_MIX), m)  # what is settled is dealt anywhere
        columns = [m.view(np.int64), h.view(np.int64), d, t, at.astype(np.int32), n.astype(np.int32), equal, twice]
        yield pa.RecordBatch.from_arrays([pa.array(c[~again]) for c in columns], ["m", "h", "d", "t", "at", "n", "gone", "twice"])


def _settle_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in order of minimizer, string and document. Out: runs that go (gone), and first ones whose bytes are needed.

    Of a minimizer's strings the first waits until a second one comes, whichever batch that is in.
    """
    names = ["m", "h", "d", "t", "at", "n", "gone"]
    last: tuple | None = None  # minimizer, string, document and place of the last row; the waiting row, if any
    for batch in batches:
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in [*names, "twice"]]
        settled = rows[6].astype(bool)
        if settled.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[settled]) for c in rows[:7]], names)
        m, h, d, t, at, n, _, twice = (c[~settled] for c in rows)
        if not len(m):
            continue

        def previous(values: np.ndarray, k: int) -> np.ndarray:
            first = values[0] if last is None else last[0][k]
            return np.concatenate([[first], values[:-1]])

        same_m, same_h = m == previous(m, 0), h == previous(h, 1)
        row = (d == previous(d, 2)) & (t == previous(t, 3)) & (at == previous(at, 4))
        if last is None:
            same_m[0] = False
        same_h &= same_m
        gone, fresh = same_h & ~row, ~same_h
        group = np.cumsum(~same_m)  # 0: goes on from the batch before
        strings = np.bincount(group, weights=fresh, minlength=int(group[-1]) + 1)
        waiting = last[1] if last is not None else None
        if same_m[0]:
            strings[0] += 1
            if waiting is not None and strings[0] > 1:
                yield waiting
                waiting = None
        several = strings[group] > 1
        need = fresh & (several | twice.astype(bool))
        out = gone | need
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in (m, h, d, t, at, n, gone)], names)
        begins = np.flatnonzero(~same_m)
        if len(begins):  # the last group is of this batch; its only string waits unless it went out
            k = int(begins[-1])
            wait = not several[k] and not need[k]
            waiting = pa.RecordBatch.from_arrays([pa.array(c[k : k + 1]) for c in (m, h, d, t, at, n, gone)], names) if wait else None
        last = ((m[-1], h[-1], d[-1], t[-1], at[-1]), waiting)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for d, t, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
            data = text.as_py().encode()
            out += [(w["m"], w["h"], d, t, w["at"], w["hot"], data[w["at"] : w["at"] + w["n"] + LENGTH - 1]) for w in wanted]
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["m", "h", "d", "t", "at", "hot", "string"])


def _gone(d: np.ndarray, t: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A batch of windows that go; the last three columns are for windows that Spark groups."""
    none = pa.nulls(len(d), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(d), pa.array(t), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), none, none], ["d", "t", "at", "n", "x", "y"])


def judge_shard(strings: list[bytes], d: np.ndarray, t: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Windows of the strings that are equal to an earlier one, as runs in the strings' documents."""
    lengths = np.array([len(s) for s in strings])
    text = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8).astype(np.uint16)
    text = np.where(text == 255, 1, text + 2)  # UTF-8 has no bytes 0xFE or 0xFF
    symbols = np.concatenate([text, [0]]).astype(np.uint16)
    starts = np.cumsum(lengths + 1) - lengths - 1
    own = np.repeat(np.arange(len(strings)), lengths + 1)
    rest = np.append(np.repeat(starts + lengths, lengths + 1) - np.arange(len(own)), 0)
    sa = suffix_array(symbols)
    plcp = permuted_lcp(symbols, sa, rest)
    order = sa[rest[sa] >= LENGTH]  # nothing else stands between suffixes that agree in a window
    kind = np.cumsum(plcp[order] < LENGTH)
    o = own[order]
    place = at[o] + order - starts[o]
    by = np.lexsort((place, t[o], d[o], kind))
    later = np.concatenate([[False], kind[by][1:] == kind[by][:-1]])
    lost = np.sort(order[by[later]])
    if not len(lost):
        return _gone(*(np.zeros(0, dtype=np.int64),) * 4)
    begins = np.flatnonzero(np.concatenate([[True], (np.diff(lost) != 1) | (own[lost[1:]] != own[lost[:-1]])]))
    first, n = lost[begins], np.diff(np.append(begins, len(lost)))
    o = own[first]
    return _gone(d[o], t[o], at[o] + first - starts[o], n)


def _windows(d: int, t: int, at: int, string: bytes) -> pa.RecordBatch:
    from xxhash import xxh3_128_intdigest

    n = len(string) - LENGTH + 1
    hashes = np.array([divmod(xxh3_128_intdigest(string[i : i + LENGTH]), 1 << 64) for i in range(n)], dtype=np.uint64).view(np.int64)
    columns = [np.full(n, d), np.full(n, t), np.arange(at, at + n, dtype=np.int32), np.ones(n, dtype=np.int32), hashes[:, 0], hashes[:, 1]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["d", "t", "at", "n", "x", "y"])


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings in order of minimizer and hash, of equal ones the first; hot ones last. Shards end between minimizers."""
    rows: list[tuple] = []
    size, last = 0, None

    def shard() -> pa.RecordBatch:
        d, t, at, strings = zip(*rows)
        return judge_shard(list(strings), np.array(d), np.array(t), np.array(at, dtype=np.int64))

    for batch in batches:
        for m, h, d, t, at, hot, string in zip(*(batch.column(c).to_pylist() for c in ("m", "h", "d", "t", "at", "hot", "string"))):
            if (m, h) == last:
                continue
            if hot:
                yield _windows(d, t, at, string)
            else:
                if size > SHARD and m != last[0]:
                    yield shard()
                    rows, size = [], 0
                rows.append((d, t, at, string))
                size += len(string) + 1
            last = (m, h)
    if rows:
        yield shard()


def _hot_minimizers(keyed: DataFrame) -> DataFrame:
    """m of the minimizers with most runs, BROADCAST_ROWS at most."""
    some = keyed.where(F.pmod("t", F.lit(SAMPLE)) == 0).select("d", "t", "text")
    counted = map_arrow(some, _find_runs, _RUN).where("not gone").groupBy("m").agg(F.count(F.lit(1)).alias("runs"))
    return staged(counted.where(F.col("runs") * SAMPLE > HOT_STRINGS).orderBy(F.desc("runs"), "m").limit(BROADCAST_ROWS).select("m"), "suffix-edges")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The keyed documents (d_id, d, t, text), and d, t, at, n: n windows from byte `at` on that go."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be whole numbers, as their order says what is first")
    text = docs.select(F.col(id_col).alias("d_id"), text_of(text_col).alias("text"))
    mark = F.xxhash64("text", F.col("d_id").isNull())  # keeps a null id apart from the greatest number, as which it is sorted
    keyed = text.select("d_id", F.coalesce(F.col("d_id").cast("long"), F.lit(2**63 - 1)).alias("d"), mark.alias("t"), "text")
    edges = F.broadcast(_hot_minimizers(keyed).withColumn("edge", F.lit(True)))
    runs = map_arrow(keyed.select("d", "t", "text"), _find_runs, _RUN).join(edges, "m", "left")
    edge = F.coalesce("edge", F.lit(False))  # all first strings of such a minimizer are needed, as if it stood in them twice
    runs = runs.select("m", "h", "d", "t", "at", "n", "gone", (F.col("twice") | edge).alias("twice"), F.when(edge, F.col("h")).otherwise(F.col("m")).alias("deal"))
    runs = runs.repartition("deal").drop("deal").sortWithinPartitions("m", "h", "d", "t", "at")
    settled = staged(map_arrow(runs, _settle_runs, "m long, h long, d long, t long, at int, n int, gone boolean"), "suffix-runs")
    needed = settled.where("not gone")
    hot = staged(needed.groupBy("m").agg(F.count(F.lit(1)).alias("strings")).where(F.col("strings") > HOT_STRINGS).select("m", F.lit(True).alias("hot")), "suffix-hot")
    needed = needed.join(F.broadcast(hot) if fits(hot, BROADCAST_ROWS) else hot, "m", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    wanted = needed.groupBy("d", "t").agg(F.collect_list(F.struct("m", "h", "at", "n", "hot")).alias("wanted"))
    fetched = map_arrow(keyed.join(wanted, ["d", "t"]).select("d", "t", "text", "wanted"), _fetch, "m long, h long, d long, t long, at int, hot boolean, string binary")
    deal = F.when(F.col("hot"), F.col("h")).otherwise(F.col("m"))
    strings = fetched.repartition(deal).sortWithinPartitions("hot", "m", "h", "d", "t", "at")
    judged = staged(map_arrow(strings, _judge, "d long, t long, at int, n int, x long, y long"), "suffix-judged")
    parts = [settled.where("gone").select("d", "t", "at", "n"), judged.where("x IS NULL").select("d", "t", "at", "n")]
    grouped = judged.where("x IS NOT NULL")
    if grouped.take(1):
        first = grouped.groupBy("x", "y").agg(F.min(F.struct("d", "t", "at")).alias("first"), F.count(F.lit(1)).alias("windows"))
        met = spread_join(grouped, staged(first.where("windows > 1"), "suffix-first"), ["x", "y"], "windows")
        parts.append(met.where(F.struct("d", "t", "at") != F.col("first")).select("d", "t", "at", "n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return keyed, out


def spans_of(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of bytes, as starts and ends, that these windows cover."""
    order = np.argsort(at, kind="stable")
    starts, ends = at[order], np.maximum.accumulate(at[order] + n[order] + LENGTH - 1)
    fresh = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[fresh], ends[np.append(np.flatnonzero(fresh)[1:] - 1, len(ends) - 1)]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, totals = [], []
        for text, lost in zip(batch.column("text"), batch.column("lost")):
            data = text.as_py().encode()
            removed = spans = 0
            parts, upto = [], 0
            if lost.is_valid:
                at, n = (lost.values.field(k).to_numpy().astype(np.int64) for k in ("at", "n"))
                starts, ends = spans_of(at, n)
                for a, b in zip(starts.tolist(), ends.tolist()):
                    parts.append(data[upto:a])
                    upto = b
                removed, spans = int((ends - starts).sum()), len(starts)
            parts.append(data[upto:])
            kept.append(b"".join(parts))
            totals.append((len(data), removed, spans))
        if kept:
            yield pa.RecordBatch.from_arrays([batch.column("d_id"), *[pa.array(c, pa.int64()) for c in zip(*totals)], pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that stay) of each row."""
    keyed, gone = repeats(docs, id_col, text_col)
    lost = gone.groupBy("d", "t").agg(F.collect_list(F.struct("at", "n")).alias("lost"))
    joined = keyed.join(lost, ["d", "t"], "left").select("d_id", "text", "lost")
    kind = keyed.schema["d_id"].dataType.simpleString()
    return map_arrow(joined, _cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
