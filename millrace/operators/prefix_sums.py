"""Windows over one order of all rows, or over keys of any size, without one task for all: two-level prefix sums.

Rows are dealt by range of (keys, order) into pieces, which are stored once. Each piece works out its own running values; one small
row for each piece and key at a piece's edge tells what comes before: its sums, counts, extremes and last rows are carried on in
the order of the pieces. A key with all rows is spread over all pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..storage import staged
from ..tables import table

#: How a value is carried over an edge: what a piece gives, and how what came before is put to a row's own.
_KINDS = {
    "sum": (F.sum, F.sum, lambda before, own: F.coalesce(before + own, own, before)),
    "count": (F.count, F.sum, lambda before, own: F.coalesce(before, F.lit(0)) + own),
    "min": (F.min, F.min, F.least),
    "max": (F.max, F.max, F.greatest),
}


def pieces_of(df: DataFrame, by: list[str], order: list[str], pieces: int | None = None) -> DataFrame:
    """df with _piece, its number in the order of (by, order); staged, so numbers hold. Nulls come first."""
    n = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in (*by, *order)])
    return staged(ranged.withColumn("_piece", F.spark_partition_id()), "prefix-pieces")


def running(df: DataFrame, order: list[str], values: dict[str, tuple[str, str]], by: list[str] | None = None, pieces: int | None = None) -> DataFrame:
    """df with running values: values maps a new column to (kind, column), kind being sum, count, min, max, row_number or lag.

    Each is over the rows of the same keys up to the row itself (lag: the row before), in the order given, which has to be unique
    within keys. Sums of whole numbers and decimals are exact; of doubles they depend on the pieces. Null keys are keys.
    """
    by = by or []
    unknown = {kind for kind, _ in values.values()} - {*_KINDS, "row_number", "lag"}
    if unknown:
        raise ValueError(f"running: no {', '.join(sorted(unknown))}")
    cut = pieces_of(df, by, order, pieces)
    sorts = [F.col(c).asc_nulls_first() for c in order]
    inside = Window.partitionBy("_piece", *by).orderBy(*sorts)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order])

    def carry(name: str) -> tuple[Column, Column, Column]:
        """A row's own value within its piece; a piece's; what the pieces before carry."""
        kind, column = values[name]
        earlier = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
        if kind == "row_number":
            return F.row_number().over(inside).cast("long"), F.count(F.lit(1)), F.sum(f"_total_{name}").over(earlier)
        if kind == "lag":  # in a struct, so that a row before with a null isn't taken for none
            return F.lag(F.struct(column)).over(inside), F.max_by(F.struct(column), place), F.last(f"_total_{name}", ignorenulls=True).over(earlier)
        own, over, _ = _KINDS[kind]
        return own(column).over(upto), own(column), over(f"_total_{name}").over(earlier)

    totals = cut.groupBy("_piece", *by).agg(*[carry(n)[1].alias(f"_total_{n}") for n in values])
    # a key that stands in one piece alone carries nothing, so only keys at the pieces' edges are kept
    if by:
        several = totals.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*[F.col(c).alias(f"_k_{c}") for c in by])
        totals = totals.join(several, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by], "left_semi")
    edges = totals.select(*[F.col(c).alias(f"_e_{c}") for c in by], F.col("_piece").alias("_e"), *[carry(n)[2].alias(f"_before_{n}") for n in values])
    edges = staged(edges, "prefix-edges")  # of the keys in several pieces a piece holds two at most, or one that fills it
    own = cut.select("*", *[carry(n)[0].alias(f"_own_{n}") for n in values])
    on = F.col("_piece") == F.col("_e")
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"_e_{c}"))
    met = own.join(F.broadcast(edges), on, "left")

    def put(name: str) -> Column:
        kind, before, mine = values[name][0], F.col(f"_before_{name}"), F.col(f"_own_{name}")
        if kind == "row_number":
            return mine + F.coalesce(before, F.lit(0))
        if kind == "lag":
            return F.coalesce(mine, before)[values[name][1]]
        return _KINDS[kind][2](before, mine)

    return met.select(*df.columns, *[put(n).alias(n) for n in values])


@query("SELECT event_id, row_number() OVER w AS place, (sum((value * 100)::DECIMAL(18, 0)::BIGINT) OVER w)::BIGINT AS cents, max(user_id) OVER w AS highest, lag(event_type) OVER (ORDER BY ts, event_id) AS before FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def win_running_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running values over all events in order of time."""
    e = table(spark, sf_dir, "events").withColumn("c", (F.col("value") * 100).cast("decimal(18,0)").cast("long"))
    out = running(e, ["ts", "event_id"], {"place": ("row_number", "c"), "cents": ("sum", "c"), "highest": ("max", "user_id"), "before": ("lag", "event_type")})
    return out.select("event_id", "place", "cents", "highest", "before")


@query("SELECT event_id, row_number() OVER w AS place, (sum(user_id) OVER w)::BIGINT AS users, min(user_id) OVER w AS lowest FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def win_running_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running values by five keys, each of which fills several pieces."""
    e = table(spark, sf_dir, "events")
    return running(e, ["ts", "event_id"], {"place": ("row_number", "event_id"), "users": ("sum", "user_id"), "lowest": ("min", "user_id")}, ["event_type"]).select("event_id", "place", "users", "lowest")
