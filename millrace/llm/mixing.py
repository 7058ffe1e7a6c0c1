"""Mixing sources to target weights by weighted fair queueing. Native DataFrame code.

Each source's documents are shuffled by a hash of their id and text. A document's virtual finish time is the number of its source's
words up to and with it, passes before this one included, over the source's target. The finish times of all sources are
sorted by range, and the mix ends where the words taken reach the budget.

Targets share the words of all sources by weight (1, 2, 3, repeating, over sources in code-point order, null last); none is
above max_passes times its source, and what is over goes to the others by weight.

Null texts and texts without words have size 0 and are never taken. A source without words has target 0. Repeated rows are
separate documents, in any order, as nothing tells them apart; only rows equal in id and text stand in one run of the queue. An empty table gives an empty result. Columns besides id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, staged, text_of

#: Rows of one shuffled run of a source; a source is cut into as many runs as it needs.
RUN_ROWS = 4_000
#: Entries of which the end of the mix is found in one task; more are cut by range again.
END_ROWS = 1_000_000


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{WS}]+")).cast("long")


def shuffle_key(id_col: Column, text: Column, seed: str) -> Column:
    """60 bits that order a source's documents."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), F.md5(text)), 256)
    return F.conv(F.substring(hexed, 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_passes: int) -> DataFrame:
    """From (source, size) rows: source, rank, n_rows, source_size, target.

    Water filling in closed form: with sources in order of cap / weight, (budget left) / (weight left) rises as long as the
    sources taken out are capped, and falls after; the level is its maximum. Sums are of whole numbers, so targets agree to
    the last bit between runs.
    """
    total = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size"))
    ranked = total.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_passes)
    every = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    filled = ranked.select(
        "*",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left_size"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left_weight"),
    )
    level = filled.withColumn("level", F.max(F.col("left_size") / F.col("left_weight")).over(every))
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return level.select("source", "rank", "n_rows", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_passes: int = 3, seed: str = "mix", keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, passes, taken (passes times size).

    keep: more columns to carry along, by name.
    """
    keep = keep or {}
    key = shuffle_key(F.col(id_col), text_of(text_col), seed)
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text_of(text_col)).alias("size"), key.alias("key"), *[c.alias(k) for k, c in keep.items()])
    sized = staged(sized, "mix-sizes")
    sources = staged(source_targets(sized, weights, max_passes), "mix-sources")  # its size on disk decides how it is joined

    known = sized.join(sources.withColumnRenamed("source", "s_source"), F.col("source").eqNullSafe(F.col("s_source")))
    run = F.shiftright(F.shiftright("key", 28) * F.ceil(F.col("n_rows") / RUN_ROWS), 32)
    known = known.withColumn("run", run).drop("source", "s_source", "n_rows")
    runs = known.groupBy("rank", "run").agg(F.sum("size").alias("run_size"))
    earlier = Window.partitionBy("rank").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("rank", "run", F.coalesce(F.sum("run_size").over(earlier), F.lit(0)).alias("run_start"))
    within = Window.partitionBy("rank", "run").orderBy("key", F.col("doc_id").asc_nulls_first(), "size", *keep).rowsBetween(Window.unboundedPreceding, 0)
    queued = known.join(runs, ["rank", "run"]).withColumn("served", F.col("run_start") + F.sum("size").over(within))
    queued = staged(queued.select("doc_id", "rank", "size", "source_size", "target", "served", *keep), "mix-queue")

    end = _end_of_mix(queued, sources, max_passes)
    if end is None:
        passes = F.lit(0).cast("long")
    else:
        last = F.struct(F.lit(end["finish"]), *[F.lit(end[c]).cast("long") for c in ("rank", "pass", "served")])
        taken = [F.when(_begins(F.lit(p)) & (F.struct(_finish(F.lit(p)), F.col("rank"), F.lit(p).cast("long"), F.col("served")) <= last), 1).otherwise(0) for p in range(max_passes)]
        passes = F.when(F.col("size") > 0, sum(taken[1:], taken[0])).otherwise(0).cast("long")
    return queued.withColumn("passes", passes).select("doc_id", "size", "source_size", "target", "passes", (F.col("passes") * F.col("size")).alias("taken"), *keep)


def _begins(p: Column) -> Column:
    """Whether a source's pass begins before its target is met; later passes take no part."""
    return p * F.col("source_size") <= F.col("target")


def _finish(p: Column) -> Column:
    return (p * F.col("source_size") + F.col("served")).cast("double") / F.col("target")


def _end_of_mix(queued: DataFrame, sources: DataFrame, max_passes: int) -> dict | None:
    """The last entry of the range-sorted finish times that the budget holds.

    Only sums of the sort's ranges come to the driver, one for each partition, and one row of one range. A range of over END_ROWS
    entries is cut by range again.
    """
    budget = sources.agg(F.sum("source_size")).first()[0]
    if not budget:
        return None
    spark = queued.sparkSession
    entries = queued.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max_passes - 1).cast("long"))))
    order = ["finish", "rank", "pass", "served"]
    entries = entries.where(_begins(F.col("pass"))).withColumn("finish", _finish(F.col("pass")))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    entries, before, earlier = entries.select(*order, "size"), 0, None
    while True:
        ranged = staged(entries.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "mix-ranges")
        totals = {r["range"]: (r["n"], r["rows"]) for r in ranged.groupBy("range").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).collect()}
        crossing = None
        for part in sorted(totals):
            if before + totals[part][0] > budget:
                crossing = part
                break
            before += totals[part][0]
        if crossing is None:
            return _last(ranged, order)
        # the range that crosses the budget; where it holds nothing, the end is the last entry before it
        inside = ranged.where(F.col("range") == crossing).drop("range")
        earlier = _last(ranged.where(F.col("range") < crossing), order) or earlier
        if totals[crossing][1] <= END_ROWS or len(totals) == 1:
            break
        entries = inside
    running = inside.withColumn("upto", F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return _last(running.where(F.col("upto") <= budget - before), order) or earlier


def _last(entries: DataFrame, order: list[str]) -> dict | None:
    row = entries.agg(F.max(F.struct(*order)).alias("end")).first()["end"]
    return None if row is None else row.asDict()


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs.

    Rows meet their number of passes by id and a hash of all columns; rows equal in all of them pool their passes.
    """
    row_hash = F.xxhash64(*[F.col(c) for c in docs.columns])
    mixed = mix(docs, keep={"row_hash": row_hash}, **options).where("passes > 0")
    passes = mixed.groupBy(F.col("doc_id").alias("m_id"), F.col("row_hash").alias("m_hash")).agg(F.sum("passes").alias("passes"), F.count(F.lit(1)).alias("rows"))
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(options.get("id_col", "doc_id")).alias("id"), row_hash.alias("hash"))
    joined = keyed.join(passes, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("hash") == F.col("m_hash")))
    once, more = joined.where("rows = 1"), joined.where("rows > 1").dropDuplicates(["m_id", "m_hash"])
    every = once.unionByName(more).select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("passes"))).alias("again"))
    return every.select("doc.*")
