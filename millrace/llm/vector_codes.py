"""Product codes of vectors: each of PARTS parts of a vector becomes the index of the nearest entry of that part's codebook.

Components are made whole numbers, floor(SCALE * x). Codebooks begin as the parts of the rows with the smallest ids, and each
round assigns all rows and takes the floored means of what each entry got; entries that got nothing stay. Spark adds up one row
for each entry and partition; the driver holds the codebooks alone.

The nearest entry is found by a VA file: an entry's coordinates are quantised to BITS bits, into cells between the least and the
greatest coordinate that fall into them. For each vector, tables by coordinate and cell hold the least and the greatest squared
difference that the cell allows; summed over an entry's cells they bound its distance. Only entries whose lower bound isn't above
the least upper bound are refined, with distances in whole numbers; ties go to the smaller index.

Rows count whose vector is not null, has no null or non-finite component, and as many components as the one with the smallest id,
of those with a positive multiple of PARTS; other rows are dropped. Numbers beyond +-2^24 after scaling are taken as 2^24, so
distances fit a long. Null ids come last; rows with one id begin the codebook in the order of their vectors; repeated rows
get equal codes. Other columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Bits of a coordinate's cell; vectors whose bounds are held at once; the greatest whole number.
BITS, BLOCK, MOST = 4, 2_048, 1 << 24


@dataclass
class Codebooks:
    """entries[part, index] are whole numbers; all empty where no row counts."""

    entries: np.ndarray

    @property
    def width(self) -> int:
        """Components of a vector."""
        return self.entries.shape[0] * self.entries.shape[2]


class Cells:
    """The VA file of one part's entries."""

    def __init__(self, entries: np.ndarray, bits: int = BITS) -> None:
        k, d = entries.shape
        self.entries, n = entries.astype(np.int64), 1 << bits
        ranked = np.argsort(np.argsort(entries, axis=0, kind="stable"), axis=0, kind="stable")
        cell = ranked * n // k  # as many entries in each cell
        place = np.arange(d) * n + cell
        self.low, self.high = np.full(d * n, MOST, dtype=np.int64), np.full(d * n, -MOST, dtype=np.int64)
        np.minimum.at(self.low, place, entries)
        np.maximum.at(self.high, place, entries)
        self.low, self.high = (x.reshape(d, n).astype(np.float32) for x in (self.low, self.high))
        self.which = np.zeros((d * n, k), dtype=np.float32)
        self.which[place, np.arange(k)[:, None]] = 1
        #: More than what sums of d terms lose in single precision.
        self.slack = np.float32((d + 4) * 2.0**-22)

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each vector's squared distance to each entry: not above it, not below it."""
        below, above = self.low - x[:, :, None], x[:, :, None] - self.high
        least = np.maximum(np.maximum(below, above), 0)
        most = np.maximum(-below, -above)
        lower = (least * least).reshape(len(x), -1) @ self.which
        upper = (most * most).reshape(len(x), -1) @ self.which
        return lower * (1 - self.slack), upper * (1 + self.slack)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each vector, and its squared distance."""
        index, error = np.empty(len(x), dtype=np.int64), np.empty(len(x), dtype=np.int64)
        for at in range(0, len(x), BLOCK):
            mine = x[at : at + BLOCK]
            lower, upper = self.bounds(mine.astype(np.float32))
            row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])
            differ = mine[row] - self.entries[entry]
            distance = np.einsum("ij,ij->i", differ, differ)
            starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))  # each row has one at least
            best = np.minimum.reduceat(distance, starts)
            is_best = np.flatnonzero(distance == np.repeat(best, np.diff(np.append(starts, len(row)))))
            index[at : at + BLOCK] = entry[is_best[np.unique(row[is_best], return_index=True)[1]]]
            error[at : at + BLOCK] = best
        return index, error


def whole_numbers(vectors: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors count, and those as whole numbers."""
    counts = pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False)
    fit = np.flatnonzero(counts.to_numpy(zero_copy_only=False))
    flat = vectors.take(pa.array(fit)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fit), width)  # a null is NaN here
    good = np.isfinite(x).all(axis=1)
    return fit[good], np.clip(np.floor(x[good] * scale), -MOST, MOST).astype(np.int64)


def first_codebooks(rows: DataFrame, parts: int, entries: int, scale: int, id_col: str, vector_col: str) -> Codebooks:
    """The parts of the rows with the smallest ids: so many rows come to the driver, at most."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    base = rows.select(rows[id_col].alias("id"), rows[vector_col].alias("vector")).where(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & finite)
    order = [F.col("id").asc_nulls_last(), v]
    first = base.orderBy(*order).first()
    if first is None:
        return Codebooks(np.zeros((parts, 0, 0), dtype=np.int64))
    width = len(first["vector"])
    taken = [r["vector"] for r in base.where(F.size(v) == width).orderBy(*order).limit(entries).collect()]
    x = np.clip(np.floor(np.array(taken, dtype=np.float64) * scale), -MOST, MOST).astype(np.int64)
    return Codebooks(x.reshape(len(taken), parts, width // parts).transpose(1, 0, 2).copy())


def _refined(rows: DataFrame, books: Codebooks, scale: int, vector_col: str) -> Codebooks:
    """One round: floored means of what each entry gets."""
    parts, k, d = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [Cells(e) for e in books.entries]
        counts, sums = np.zeros((parts, k), dtype=np.int64), np.zeros((parts, k, d), dtype=np.int64)
        for batch in batches:
            _, x = whole_numbers(batch.column(0), parts * d, scale)
            for p in range(parts):
                mine = x[:, p * d : (p + 1) * d]
                index, _ = files[p].nearest(mine)
                order = np.argsort(index, kind="stable")
                used, starts = np.unique(index[order], return_index=True)
                if len(used):
                    counts[p, used] += np.diff(np.append(starts, len(order)))
                    sums[p, used] += np.add.reduceat(mine[order], starts, axis=0)
        p, e = np.nonzero(counts)
        if len(p):
            lists = pa.FixedSizeListArray.from_arrays(pa.array(sums[p, e].ravel()), d).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(counts[p, e]), lists], ["part", "entry", "n", "sums"])

    got = map_arrow(rows.select(rows[vector_col]), run, "part long, entry long, n long, sums array<long>", "vectors")
    total = got.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(d)]).alias("sums"))
    new = books.entries.copy()
    for r in total.collect():  # a row for each entry
        new[r["part"], r["entry"]] = np.array(r["sums"], dtype=np.int64) // r["n"]
    return Codebooks(new)


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> Codebooks:
    """The codebooks after some rounds, each one pass over the rows."""
    books = first_codebooks(rows, parts, entries, scale, id_col, vector_col)
    for _ in range(rounds if books.width else 0):
        books = _refined(rows, books, scale, vector_col)
    return books


def encode(rows: DataFrame, books: Codebooks, scale: int = SCALE, keep: tuple[str, ...] = (), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, codes (an index for each part), error (squared distance in whole numbers) and the columns in keep of the rows that count."""
    parts, _, d = books.entries.shape
    base = rows.select(rows[vector_col].alias("vector"), rows[id_col].alias("vec_id"), *[rows[c] for c in keep])
    names = base.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [Cells(e) for e in books.entries]
        for batch in batches:
            which, x = whole_numbers(batch.column(0), parts * d, scale) if d else (np.zeros(0, dtype=np.int64), None)
            if not len(which):
                continue
            found = [files[p].nearest(x[:, p * d : (p + 1) * d]) for p in range(parts)]
            codes = np.stack([index for index, _ in found], axis=1).astype(np.int32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), parts).cast(pa.list_(pa.int32()))
            errors = pa.array(np.sum([error for _, error in found], axis=0))
            at = pa.array(which)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in names], lists, errors], [*names, "codes", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[1:])
    return map_arrow(base, run, f"{kinds}, codes array<int>, error long", "vectors")


def decode(codes: np.ndarray, books: Codebooks, scale: int = SCALE) -> np.ndarray:
    """The middle of the cells of the whole numbers that codes stand for, as components."""
    taken = [books.entries[p][codes[:, p]] for p in range(books.entries.shape[0])]
    return (np.concatenate(taken, axis=1) + 0.5) / scale


def digits(books: Codebooks) -> str:
    """All components by part, entry and place, in decimal, joined by commas."""
    return ",".join(map(str, books.entries.ravel().tolist()))
