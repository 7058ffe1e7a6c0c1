"""Recursion over tables: what a graph's edges reach, by a fixpoint that goes on from what is new alone.

Nodes with the same edges, in and out, are twins: whatever reaches one reaches all in as many hops, and they reach the same. The
fixpoint runs over one node of each set of twins, and sets become rows at the end alone, so what is joined, compared and stored on
the way doesn't grow with pairs of twins. Each round joins the rows of the round before (the delta) with the edges, takes away what is
known, and stores the rest as the next delta; it ends when a delta is empty, after as many rounds as the longest of the shortest
paths. Edges are stored once. What is known is kept as stored deltas, which a row leaves never, so a lost executor costs its own part
of one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..storage import staged
from ..tables import table

#: Deltas that stand side by side before they are stored as one.
DELTAS = 8
#: Twins, or starts that are twins, that stand in one list, in the mean.
BLOCK = 256
#: Rows of the result that one task makes, in the mean.
ROWS = 1_000_000


def _digest() -> F.Column:
    """Of the edges that go from a node and come to it, in any order."""
    return F.struct(*(f(F.when(F.col(c).isNotNull(), F.xxhash64(c))) for c in ("goes", "comes") for f in (F.count, F.bit_xor)))


def twins(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node, twin: for each node of the edges e (source, target; distinct) one node with the same edges; and the edges between those.

    Digests of a node's edges propose its twins. Of two sets with an edge between them, as many edges as pairs must go from one to the
    other, else the nodes of both stand alone, so digests that meet by chance do no harm.
    """
    goes = F.struct(F.col("source").alias("node"), F.col("target").alias("goes"), F.lit(None).alias("comes"))
    comes = F.struct(F.col("target").alias("node"), F.lit(None).alias("goes"), F.col("source").alias("comes"))
    ends = e.select(F.explode(F.array(goes, comes)).alias("end")).select("end.*")
    nodes = staged(ends.groupBy("node").agg(_digest().alias("digest")), "reach-nodes")
    sets = nodes.groupBy("digest").agg(F.min("node").alias("twin"), F.count(F.lit(1)).alias("n"))
    nodes = staged(nodes.join(sets, "digest").select("node", "twin", "n"), "reach-twins")
    between = staged(_between(e, nodes), "reach-between")
    false = between.where("edges <> pairs").select(F.explode(F.array("source_twin", "target_twin")).alias("twin")).distinct()
    if false.limit(1).count():
        alone = nodes.join(false.withColumn("alone", F.lit(True)), "twin", "left")
        nodes = staged(alone.select("node", F.when(F.col("alone"), F.col("node")).otherwise(F.col("twin")).alias("twin"), F.when(F.col("alone"), 1).otherwise(F.col("n")).alias("n")), "reach-twins")
        between = staged(_between(e, nodes), "reach-between")
    return nodes.select("node", "twin"), between.select(F.col("source_twin").alias("source"), F.col("target_twin").alias("target"))


def _between(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """source_twin, target_twin, the edges from one's set to the other's, and the pairs that there are."""
    out, into = (nodes.select(F.col("node").alias(c), F.col("twin").alias(f"{c}_twin"), F.col("n").alias(f"{c}_n")) for c in ("source", "target"))
    both = e.join(out, "source").join(into, "target").groupBy("source_twin", "target_twin")
    return both.agg(F.count(F.lit(1)).alias("edges"), (F.first("source_n") * F.first("target_n")).alias("pairs"))


def _lists(rows: DataFrame, name: str) -> DataFrame:
    """twin, number, and the nodes of each twin's rows in lists of about BLOCK."""
    blocks = rows.groupBy("twin").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    return rows.join(blocks, "twin").groupBy(F.col("twin").alias(f"{name}_twin"), F.pmod(F.xxhash64("node"), F.col("blocks")).alias(f"{name}_number")).agg(F.collect_list("node").alias(name))


def reach(edges: DataFrame, starts: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """start, node, hops: every node that each start reaches, itself in 0 hops included, with the least number of hops.

    edges: source, target; starts: start. Nulls are no nodes; repeated edges and cycles do no harm. max_rounds cuts the search after
    so many hops.
    """
    e = staged(edges.where("source IS NOT NULL AND target IS NOT NULL").select("source", "target").distinct(), "reach-edges")
    own = staged(starts.where("start IS NOT NULL").select("start").distinct(), "reach-starts")
    nodes, between = twins(e)
    begun = staged(own.join(nodes, F.col("start") == F.col("node")).select("node", "twin"), "reach-begun")
    # a start's twins take at least one hop, so no pair is known before the first round
    delta = begun.select(F.col("twin").alias("start"), F.col("twin").alias("node")).distinct()
    known, several, hops = None, 0, 0
    while hops != max_rounds and delta.limit(1).count():
        hops += 1
        new = delta.join(between, F.col("node") == F.col("source")).select("start", F.col("target").alias("node")).distinct()
        if known is not None:
            new = new.join(known.select("start", "node"), ["start", "node"], "left_anti")
        delta = staged(new.withColumn("hops", F.lit(hops).cast("long")), "reach-delta")
        known, several = delta if known is None else known.unionByName(delta), several + 1
        if several == DELTAS:
            known, several = staged(known, "reach-known"), 1
    out = own.select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("hops"))
    if known is None:
        return out
    known = known.select(F.col("start").alias("starts_twin"), F.col("node").alias("nodes_twin"), "hops")
    pairs = staged(known.join(_lists(begun, "starts"), "starts_twin").join(_lists(nodes, "nodes"), "nodes_twin").select("hops", "starts", "nodes"), "reach-pairs")
    rows = pairs.agg(F.sum(F.size("starts").cast("long") * F.size("nodes"))).first()[0] or 0
    # lists are small, what they make isn't: they are dealt by the number of rows, which Spark must not gather again
    pairs = pairs.repartition(max(1, -(-rows // ROWS)))
    return out.unionByName(pairs.select(F.explode("starts").alias("start"), "nodes", "hops").select("start", F.explode("nodes").alias("node"), "hops").where("start <> node"))


def rank(edges: DataFrame, rounds: int, damping: float = 0.85) -> DataFrame:
    """node, links and rank after some rounds in which each node deals its rank to the nodes it links to, equally.

    Nodes that link nowhere deal theirs to all. Ranks sum to the number of nodes. A node that many link to is no hot key: what it is
    dealt is added up before it moves.
    """
    e = staged(edges.where("source IS NOT NULL AND target IS NOT NULL").select("source", "target").distinct(), "rank-edges")
    nodes = e.select(F.col("source").alias("node")).union(e.select("target")).distinct()
    out = e.groupBy("source").agg(F.count(F.lit(1)).alias("links"))
    ranks = nodes.join(out, F.col("node") == F.col("source"), "left").select("node", F.coalesce("links", F.lit(0)).alias("links"), F.lit(1.0).alias("rank"))
    ranks = staged(ranks, "rank-0")
    n = ranks.count()
    for k in range(rounds):
        idle = ranks.where("links = 0").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("s")).first()["s"]
        dealt = ranks.where("links > 0").select("node", (F.col("rank") / F.col("links")).alias("share"))
        got = e.join(dealt, F.col("source") == F.col("node")).groupBy("target").agg(F.sum("share").alias("got"))
        base = (1 - damping) + damping * idle / n
        ranks = staged(ranks.join(got, F.col("node") == F.col("target"), "left").select("node", "links", (base + damping * F.coalesce("got", F.lit(0.0))).alias("rank")), f"rank-{k + 1}")
    return ranks


def page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target: from each page to the addresses that it links to, and from each address to the pages with such a link."""
    hrefs = F.explode(F.expr(r"""regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)"""))
    links = table(spark, sf_dir, "pages").select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("page"), hrefs.alias("address"))
    both = F.array(F.struct(F.col("page").alias("source"), F.col("address").alias("target")), F.struct(F.col("address").alias("source"), F.col("page").alias("target")))
    return links.select(F.explode(both).alias("e")).select("e.*").distinct()


_EDGES = """links AS (
  SELECT DISTINCT 'page:' || page_id AS source, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS target FROM pages),
e AS MATERIALIZED (SELECT source, target FROM links UNION SELECT target, source FROM links)"""


@query(
    f"""WITH RECURSIVE {_EDGES},
r(start, node, hops) AS (
  SELECT 'page:' || page_id, 'page:' || page_id, 0 FROM pages WHERE page_id % 100 = 0
  UNION
  SELECT r.start, e.target, r.hops + 1 FROM r JOIN e ON r.node = e.source WHERE r.hops < 24)
SELECT start, node, min(hops)::BIGINT AS hops FROM r GROUP BY start, node"""
)
def recursive_cte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pages with ids divisible by 100 reach by links that pages share."""
    starts = table(spark, sf_dir, "pages").where("page_id % 100 = 0").select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("start"))
    return reach(page_edges(spark, sf_dir), starts)


def _rank_sql(rounds: int) -> str:
    steps = [f"WITH {_EDGES}", "out AS (SELECT source, count(*) AS links FROM e GROUP BY source)", "r0 AS MATERIALIZED (SELECT source AS node, links, 1.0::DOUBLE AS rank FROM out)"]
    for k in range(rounds):
        got = f"SELECT e.target, sum(r.rank / r.links) AS got FROM e JOIN r{k} r ON e.source = r.node GROUP BY e.target"
        steps.append(f"r{k + 1} AS MATERIALIZED (SELECT node, links, 0.15 + 0.85 * coalesce(got, 0) AS rank FROM r{k} LEFT JOIN ({got}) ON node = target)")
    return ",\n".join(steps) + f"\nSELECT node, links, round(rank, 9) AS rank FROM r{rounds}"


@query(_rank_sql(8))
def page_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of pages and addresses after eight rounds."""
    return rank(page_edges(spark, sf_dir), 8).withColumn("rank", F.round("rank", 9))
