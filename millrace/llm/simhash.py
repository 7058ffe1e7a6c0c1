"""SimHash near-dedup with deletion-variant signatures.

A fingerprint has a bit for each bit of the shingles' hashes that is set in over half of them. To find all pairs that differ in
at most 4 bits, fingerprints are cut into 3 segments: 4 differences leave one segment with at most one. So each segment is
indexed once for each of its bits, with that bit as a wildcard; two fingerprints that link share such a variant. Variants are
dealt by hash and sorted, and each run of equal variants is verified. Equal fingerprints are one row before that.

In a run of up to SMALL_RUN fingerprints all pairs are verified, and a pair is told by one of the variants that it shares. In
a longer one each fingerprint is compared with those that nothing has reached yet, so a dense group costs little and gives a
spanning tree, no pairs: it keeps all that the components need. A run of over LONG_RUN, where most are unrelated, is cut by
LINK_BITS + 1 pieces of the bits in turn: two that link agree in one of them, so only runs of equal pieces are compared, and
the trees of all pieces are made into one. A run holds 8 bytes for each different fingerprint, in one task.

Null texts count as empty. Texts without words have fingerprint zero and link as any other. Null ids are never the smallest;
a group of null ids alone has a null component. Repeated rows get equal results. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, spread_join, staged, text_of
from .components import components, forest

BITS, SEED, LINK_BITS = 64, 42, 4
#: (first bit, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
SMALL_RUN, LONG_RUN = 32, 4_096
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def shingle_hashes(text: str, width: int) -> Iterator[np.ndarray]:
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *[e + 1 for e in ends[:-1]]]
    lasts = ends[width - 1 :] or ends[-1:]
    for at in range(0, len(lasts), BLOCK):
        yield np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[at : at + BLOCK], lasts[at : at + BLOCK])], dtype=np.uint64)


def fingerprint(text: str, width: int = 4) -> int:
    counts, n = np.zeros(BITS, dtype=np.int64), 0
    for hashes in shingle_hashes(text, width):
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 4, keep: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (as a signed long) of each row, and the columns in keep."""
    keep = keep or {}
    base = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(k) for k, c in keep.items()], text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in batch.column("text")], dtype=np.uint64).view(np.int64)
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(found)], [*names, "fp"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema if f.name != "text")
    return map_arrow(base, run, f"{kinds}, fp long")


def variants(prints: DataFrame) -> DataFrame:
    """variant and fp: 64 of each fingerprint. A variant is its wildcard's place and the rest of that segment."""
    each = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("bit"))
    cases = [f"WHEN bit < {first + n} THEN (shiftrightunsigned(fp, {first}) & {(1 << n) - 1}L) & ~shiftleft(1L, bit - {first})" for first, n in SEGMENTS]
    return each.select(F.expr(f"shiftleft(cast(bit AS bigint), 24) | (CASE {' '.join(cases)} END)").alias("variant"), "fp")


_FIRST = np.array([first for first, n in SEGMENTS for _ in range(n)], dtype=np.uint64)
_PLACE = np.array([k for k, (_, n) in enumerate(SEGMENTS) for _ in range(n)])


def _pairs_of_small_runs(variant: np.ndarray, fp: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for d in range(1, longest):
        i = np.flatnonzero(variant[d:] == variant[:-d])
        if not len(i):
            break
        diff = fp[i] ^ fp[i + d]
        close = np.bitwise_count(diff) <= LINK_BITS
        i, diff = i[close], diff[close]
        bit = (variant[i] >> 24).astype(np.int64)
        at = diff >> _FIRST[bit]
        told = np.zeros(len(i), dtype=bool)
        for k, (first, n) in enumerate(SEGMENTS):  # told by the wildcard that differs, or the first one, of the first segment that may tell
            here = _PLACE[bit] == k
            own = at & np.uint64((1 << n) - 1)
            wild = np.uint64(1) << (bit.astype(np.uint64) - _FIRST[bit])
            ok = (own == wild) | ((own == 0) & (bit == first))
            for earlier, m in SEGMENTS[:k]:
                ok &= np.bitwise_count(diff >> np.uint64(earlier) & np.uint64((1 << m) - 1)) > 1
            told |= here & ok
        yield fp[i[told]], fp[i[told] + d]


def _tree_of_long_run(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links connect, by breadth-first search over those not reached yet."""
    left, a, b = fp, [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            here = todo.pop()
            close = np.bitwise_count(left ^ here) <= LINK_BITS
            if close.any():
                found = left[close]
                left = left[~close]
                a.append(np.full(len(found), here))
                b.append(found)
                todo.extend(found)
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def _tree_of_run(fp: np.ndarray, bits: tuple[int, ...] = tuple(range(BITS))) -> tuple[np.ndarray, np.ndarray]:
    """_tree_of_long_run, of runs of any length; bits: those in which the fingerprints may differ."""
    bits = tuple(b for b in bits if (fp[0] ^ fp).any() and ((fp ^ fp[0]) >> np.uint64(b) & np.uint64(1)).any())
    if len(fp) <= LONG_RUN or len(bits) <= LINK_BITS:
        return _tree_of_long_run(fp)
    a, b = [], []
    for k in range(LINK_BITS + 1):
        mine = bits[k :: LINK_BITS + 1]
        piece = fp & np.uint64(sum(1 << i for i in mine))
        order = np.argsort(piece, kind="stable")
        cuts = np.flatnonzero(np.diff(piece[order])) + 1
        for run in np.split(fp[order], cuts):
            if len(run) > 1:
                x, y = _tree_of_run(run, tuple(i for i in bits if i not in mine))
                a.append(x)
                b.append(y)
    x, y = np.concatenate(a), np.concatenate(b)
    kept = forest(x, y) if len(x) else np.zeros(0, dtype=np.int64)
    return x[kept], y[kept]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal variants; a run that a batch cuts is held until it is whole."""

    def of(variant: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], variant[1:] != variant[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(variant)]]))
        small = np.repeat(sizes <= SMALL_RUN, sizes)
        found = list(_pairs_of_small_runs(variant[small], fp[small], SMALL_RUN))
        found += [_tree_of_run(fp[s : s + n]) for s, n in zip(starts[sizes > SMALL_RUN], sizes[sizes > SMALL_RUN])]
        for a, b in found:
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    held_v, held_f = [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        variant, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        last = int(np.searchsorted(variant, variant[-1]))  # where the last run begins
        if last or (held_v and held_v[0][0] != variant[0]):
            whole_v, whole_f = np.concatenate([*held_v, variant[:last]]), np.concatenate([*held_f, fp[:last]])
            if len(whole_v):
                yield from of(whole_v, whole_f)
            held_v, held_f = [], []
        held_v.append(variant[last:])
        held_f.append(fp[last:])
    if held_v:
        yield from of(np.concatenate(held_v), np.concatenate(held_f))


def links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of different fingerprints; whatever chains of links connect, these connect."""
    dealt = variants(prints).repartition("variant").sortWithinPartitions("variant", "fp")
    return map_arrow(dealt, _links, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(marked: DataFrame) -> DataFrame:
    """fp, root (the least fingerprint that it reaches) and component_id, from staged rows (doc_id, fp)."""
    prints = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-prints")
    member = components(links(prints.select("fp")))
    rooted = prints.join(member, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = staged(rooted, "simhash-roots")
    least = staged(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "simhash-components")
    return spread_join(rooted.select("fp", "root"), least, ["root"], "n").select("fp", "root", "component_id")


def _classed(marked: DataFrame) -> DataFrame:
    """The rows of marked, which have fp, with root and component_id; a fingerprint may be that of a third of all rows."""
    known = classes(marked).join(marked.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "fp")
    return spread_join(marked, staged(known, "simhash-classes"), ["fp"], "n")


def near_dedup(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, fp, component_id of each row."""
    marked = staged(fingerprints(docs, width), "simhash-documents")
    return _classed(marked).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = 4) -> DataFrame:
    """The rows of docs with, of each component, one alone: that with the smallest id, then the smallest hash of all columns.

    Rows equal in all columns count as one. Texts are moved once, to meet the decision about their row.
    """
    row_hash = F.xxhash64(*[F.col(c) for c in docs.columns])
    marked = staged(fingerprints(docs, width, {"row_hash": row_hash}), "simhash-documents")
    best = _classed(marked).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_hash")).alias("best"))
    best = best.select(F.col("best.doc_id").alias("k_id"), F.col("best.row_hash").alias("k_hash"))
    count = marked.groupBy(F.col("doc_id").alias("n_id"), F.col("row_hash").alias("n_hash")).agg(F.count(F.lit(1)).alias("k_rows"))
    best = best.join(count, F.col("k_id").eqNullSafe(F.col("n_id")) & (F.col("k_hash") == F.col("n_hash"))).drop("n_id", "n_hash")
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").alias("id"), row_hash.alias("hash"))
    joined = keyed.join(best, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("hash") == F.col("k_hash")))
    once, more = joined.where("k_rows = 1"), joined.where("k_rows > 1").dropDuplicates(["k_id", "k_hash"])
    return once.unionByName(more).select("doc.*")
