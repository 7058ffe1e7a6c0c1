"""The most frequent values of a column, by mergeable summaries and one exact recount.

A summary of m counters (Misra-Gries) is made of each partition: counts go up batch by batch, and when there are more than m, the
(m + 1)-th greatest count is taken off all of them, and what is left with nothing goes. Summaries merge in the same way: add, then
take off. Each taking-off by c takes c from m + 1 counters at least, so what has been taken off any value is at most n / (m + 1),
n being the rows, however the summaries are merged; each summary carries the exact sum of its c's as its error.

Summaries of partitions meet in a tree of FAN_IN at a time, of fewer when they are large, so a task holds HELD counters or two summaries. The candidates that are left
are counted exactly in a second pass. A value that isn't among them stands at most `error` times; so if the k-th candidate has more,
the k are the most frequent ones. If not, the summary is made again with GROW times the counters, or at once with as many as leave
less error than the k-th candidate has rows, and, beyond MOST, all values are counted, by Spark's own grouping: the result is exact
at any size, and ties go to the smaller value. Nulls don't count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..storage import staged
from ..tables import table

FAN_IN, COUNTERS, GROW, MOST = 16, 1_000, 8, 512_000
#: Counters that a task merges at most (two summaries, if these have more), and values that wait for it at least.
HELD, WAITING = 512_000, 20_000
_SCHEMA = "piece long, value {kind}, low long, error long, rows long"


def _less(values: pa.Array, counts: np.ndarray, m: int) -> tuple[pa.Array, np.ndarray, int]:
    """A summary of at most m counters, and what was taken off."""
    if len(counts) <= m:
        return values, counts, 0
    off = int(np.partition(counts, len(counts) - m - 1)[len(counts) - m - 1])
    stays = np.flatnonzero(counts > off)
    return values.take(pa.array(stays)), counts[stays] - off, off


def _added(parts: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
    both = pa.table({"value": pa.concat_arrays([v for v, _ in parts]), "n": pa.array(np.concatenate([n for _, n in parts]))})
    summed = both.group_by("value").aggregate([("n", "sum")]).combine_chunks()
    return summed.column("value").combine_chunks(), summed.column("n_sum").to_numpy().astype(np.int64)


def _rows(piece: int, values: pa.Array, counts: np.ndarray, error: int, rows: int) -> pa.RecordBatch:
    """A counter a row; a summary without counters is one row with a null value, so its error and rows aren't lost."""
    if not len(values):
        values, counts = pa.nulls(1, values.type), np.zeros(1, dtype=np.int64)
    same = [pa.array(np.full(len(values), x, dtype=np.int64)) for x in (piece, error, rows)]
    return pa.RecordBatch.from_arrays([same[0], values, pa.array(counts), same[1], same[2]], ["piece", "value", "low", "error", "rows"])


def summary(df: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """value, low, error, rows: at most `counters` values; each stands between low and low + error times in `rows` non-null rows, any
    other value at most error times. Without counters one row with a null value; without rows none."""
    base = df.select(F.col(column).alias("value")).where("value IS NOT NULL")
    schema = _SCHEMA.format(kind=base.schema["value"].dataType.simpleString())

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts, waiting, error, rows = [], 0, 0, 0
        for batch in batches:
            counted = pc.value_counts(batch.column(0))
            parts.append((counted.field("values"), counted.field("counts").to_numpy().astype(np.int64)))
            waiting, rows = waiting + len(counted), rows + batch.num_rows
            if waiting >= max(counters, WAITING):
                values, counts, off = _less(*_added(parts), counters)
                parts, waiting, error = [(values, counts)], 0, error + off
        if parts:
            values, counts, off = _less(*_added(parts), counters)
            yield _rows(TaskContext.get().partitionId(), values, counts, error + off, rows)

    def merged(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        pieces = table.group_by("piece").aggregate([("error", "max"), ("rows", "max")])
        known = table.filter(pc.is_valid(table.column("value")))
        values, counts = _added([(known.column("value").combine_chunks(), known.column("low").to_numpy().astype(np.int64))]) if known.num_rows else (pa.nulls(0, table.schema.field("value").type), np.zeros(0, dtype=np.int64))
        values, counts, off = _less(values, counts, counters)
        error, rows = (pc.sum(pieces.column(c)).as_py() for c in ("error_max", "rows_max"))
        return pa.Table.from_batches([_rows(pc.min(table.column("piece")).as_py() // fan_in, values, counts, error + off, rows)])

    fan_in = max(2, min(FAN_IN, HELD // counters))
    level = staged(base.mapInArrow(of_partition, schema), "heavy-hitters-pieces")
    pieces = level.agg(F.coalesce(F.max("piece") + 1, F.lit(0)).alias("n")).first()["n"]
    while pieces > 1:
        level = level.groupBy(F.floor(F.col("piece") / fan_in).alias("g")).applyInArrow(merged, schema)
        pieces = -(-pieces // fan_in)
    return level.select("value", "low", "error", "rows")


def frequent(df: DataFrame, column: str, k: int, counters: int = COUNTERS) -> DataFrame:
    """value, n and rank of the k most frequent values, exactly."""
    base = df.select(F.col(column).alias("value")).where("value IS NOT NULL")
    order = [F.desc("n"), F.col("value")]
    while counters <= MOST:
        found = staged(summary(base, "value", counters), "heavy-hitters")
        error, rows = found.agg(F.coalesce(F.max("error"), F.lit(0)), F.coalesce(F.max("rows"), F.lit(0))).first()
        known = F.broadcast(found.where("value IS NOT NULL").select("value"))  # at most MOST
        counted = staged(base.join(known, "value", "left_semi").groupBy("value").agg(F.count(F.lit(1)).alias("n")), "heavy-hitters-counts")
        best = counted.orderBy(*order).limit(k).collect()
        if error == 0 or (len(best) == k and best[-1]["n"] > error):
            break
        counters = max(counters * GROW, rows // best[-1]["n"] + 1 if len(best) == k else 0)
    else:
        counted = base.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    best = counted.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))  # of k rows


_TOP = "SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS rank FROM ({}) QUALIFY rank <= {}"


@query(_TOP.format("SELECT l_partkey AS value, count(*) AS n FROM lineitem GROUP BY l_partkey", 20))
def approx_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty parts that are shipped most often."""
    return frequent(table(spark, sf_dir, "lineitem"), "l_partkey", 20)


@query(_TOP.format(r"SELECT w AS value, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY w", 50))
def approx_top_k_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty most frequent words of a-z in all documents."""
    words = F.explode(F.expr(r"regexp_extract_all(lower(text), '([a-z]+)', 1)"))
    return frequent(table(spark, sf_dir, "documents").select(words.alias("w")), "w", 50)


@query("SELECT l_suppkey, count(*) AS n, true AS bounded FROM lineitem GROUP BY l_suppkey ORDER BY n DESC, l_suppkey LIMIT 40")
def agg_count_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a count-min sketch of the table says of its forty most frequent suppliers: never less than there are, and not more by over
    a two-thousandth of all rows (which a sketch of depth 15 misses once in a million items)."""
    l = table(spark, sf_dir, "lineitem")
    made = l.agg(F.count_min_sketch("l_suppkey", F.lit(0.0005), F.lit(0.999999), F.lit(11)).alias("s"), F.count("l_suppkey").alias("n")).first()
    sketch = spark.sparkContext._jvm.org.apache.spark.util.sketch.CountMinSketch.readFrom(bytes(made["s"]))
    best = frequent(l, "l_suppkey", 40)
    told = [(r["value"], int(sketch.estimateCount(r["value"]))) for r in best.collect()]  # forty
    about = spark.createDataFrame(told, "value long, about long")
    bounded = (F.col("about") >= F.col("n")) & (F.col("about") <= F.col("n") + 0.0005 * made["n"])
    return best.join(about, "value").select(F.col("value").alias("l_suppkey"), "n", bounded.alias("bounded"))
