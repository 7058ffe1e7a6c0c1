"""Connected components of a graph of links, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join; the edges are written to the shared folder after each step, so no lineage grows and
no link comes to the driver. Each partition first reduces its own edges to a spanning forest. A node with many neighbours, as
the centre of a large component, is no key of one task: its minimum is made with map-side combine and broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, spread_join, staged


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of edges that make a spanning forest of the graph."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    kept = []
    for i, (x, y) in enumerate(zip(flat[: len(a)].tolist(), flat[len(a) :].tolist())):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(i)
    return np.array(kept, dtype=np.int64)


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield batch.take(pa.array(forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links the larger neighbours of each node to its least neighbour, or the node if that is less. Edges go from larger (a)
    to smaller (b), so only nodes that are both the end of some edges and the beginning of others have a lesser neighbour."""
    ends = edges.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    low = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("least"))
    low = staged(ends.join(low, "b", "left"), "link-stars")
    return spread_join(edges, low, ["b"], "n").select("a", F.coalesce("least", "b").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links the smaller neighbours of each node, and the node, to the least of them."""
    low = staged(edges.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("n")), "link-stars")
    joined = spread_join(edges, low, ["a"], "n").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return joined.unionByName(low.select("a", F.col("least").alias("b"))).where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node that each node with a link reaches. edges: two long columns, a and b."""
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = staged(map_arrow(edges.distinct(), _forests, "a long, b long"), "links")
    before = None
    while True:
        state = tuple(current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if state == before:
            break
        before = state
        current = staged(_small_star(staged(_large_star(current), "links")), "links")
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
