"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. Native DataFrame code only.

The first pass reads each text once and keeps two numbers: length and prefix hash of the normalised text. They are counted
with map-side combine. A row that is alone with its length is alone with its (length, prefix) too, so one grouped count
holds both levels. Only rows of a (length, prefix) pair met twice or more take part in the full-hash stage.

Null texts count as empty. Empty texts equal each other. Null ids sort last; repeated rows are separate rows, of which one
stays. An empty table gives an empty result. Columns besides id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, fits, spread_join, staged, text_of

#: So many (length, prefix) pairs, of 24 bytes each, may be broadcast.
BROADCAST_KEYS = 200_000
#: A pair with more rows than this is dealt over several tasks.
ROWS_A_TASK = 50_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, f"[{WS}]+", "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, digest_all: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, full_hash (SHA-256 of the normalised text).

    The longest original text stays, then the smallest id. full_hash is null for rows that refinement settled without
    reading the full content, unless digest_all asks for it.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    read = base.select("doc_id", F.length("text").alias("n_chars"), normalised(F.col("text")).alias("norm"))
    keyed = read.select("doc_id", "n_chars", "norm", F.length("norm").alias("n_len"), F.xxhash64(F.left("norm", F.lit(prefix_chars))).alias("p_hash"))
    pairs = staged(keyed.groupBy("n_len", "p_hash").agg(F.count(F.lit(1)).alias("n_pair")).where("n_pair > 1"), "dedup-pairs")
    full, met_twice = F.unhex(F.sha2("norm", 256)), F.col("n_pair").isNotNull()
    if fits(pairs, BROADCAST_KEYS):
        met = keyed.join(F.broadcast(pairs), ["n_len", "p_hash"], "left")
        met = met.withColumn("full_hash", full if digest_all else F.when(met_twice, full))
    else:  # beyond the bound hashes move instead of texts, so they are taken first
        met = spread_join(keyed.withColumn("full_hash", full).drop("norm"), pairs.withColumn("rows", F.col("n_pair")), ["n_len", "p_hash"], "rows", "left")
        if not digest_all:
            met = met.withColumn("full_hash", F.when(met_twice, F.col("full_hash")))
    rows = met.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars", "full_hash", "n_pair")
    rows = staged(rows.withColumn("fan", F.ceil(F.coalesce("n_pair", F.lit(0)) / ROWS_A_TASK)).drop("n_pair"), "dedup-rows")

    single = rows.where("fan = 0").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "full_hash")
    multi = rows.where("fan > 0")
    first = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), "doc_id", "row")
    groups = multi.groupBy(F.col("full_hash").alias("g_hash"), F.col("fan").alias("g_fan")).agg(F.count(F.lit(1)).alias("group_size"), F.min(first).alias("best"))
    groups = groups.select("g_hash", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("g_fan") - 1)).alias("g_salt"))
    on = (F.col("full_hash") == F.col("g_hash")) & (F.pmod("row", "fan") == F.col("g_salt"))
    several = multi.join(groups, on).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "full_hash")
    return single.unionByName(several)
