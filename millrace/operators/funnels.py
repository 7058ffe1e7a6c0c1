"""Patterns of rows in order: how far each first step gets along a chain of steps, each within a time limit of the one before.

Each step is an as-of join to the next row of its kind, on time turned round; so rows never multiply, every row moves once for each
step, and a key with a third of all rows is spread over pieces of time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from ..registry import query
from ..tables import table
from .joins import asof_join


def _micros(df: DataFrame, time: str) -> Column:
    c = F.col(time)
    if isinstance(df.schema[time].dataType, TimestampNTZType):
        return ((c - F.expr("TIMESTAMP_NTZ '1970-01-01'")).cast("interval second").cast("decimal(24,6)") * 1_000_000).cast("long")
    return F.unix_micros(c)


def funnel(rows: DataFrame, key: str, time: str, row_id: str, steps: dict[str, Column], seconds: int, width: int = 86_400) -> DataFrame:
    """key, an id for each step, and reached (how many steps were made), for each row that is a first step.

    The next step is made by the key's first later row of its kind (of equal times the smallest id), if that comes within so many
    seconds; times must grow from step to step. Rows with a null key or time make no step. row_id is a whole number; width: seconds in
    a piece.
    """
    base = rows.select(key, F.col(row_id).cast("long").alias("id"), _micros(rows, time).alias("t"), *[c.alias(f"is_{name}") for name, c in steps.items()]).dropna(subset=[key, "t"])
    first, *rest = steps
    out = base.where(f"is_{first}").select(key, F.col("id").alias(first), F.col("t").alias("at"))
    for name in rest:
        right = base.where(f"is_{name}").select(key, (-F.col("t")).alias("back"), F.col("id").alias("next"), F.col("t").alias("next_at"), (-F.col("id")).alias("tie"))
        met = asof_join(out.withColumn("back_from", -F.col("at") - 1), right, [key], "back_from", "back", ["next", "next_at"], "tie", width * 1_000_000)
        made = F.col("asof_next_at") - F.col("at") <= seconds * 1_000_000
        out = met.withColumn(name, F.when(made, F.col("asof_next"))).withColumn("at", F.when(made, F.col("asof_next_at"))).select(key, *list(steps)[: list(steps).index(name) + 1], "at")
    reached = sum((F.col(name).isNotNull().cast("long") for name in steps), F.lit(0).cast("long"))
    return out.select(key, *steps, reached.alias("reached"))


_STEP = "(SELECT * FROM events WHERE event_type = '{}')"


@query(
    f"""WITH c AS (
  SELECT v.user_id, v.event_id AS view, CASE WHEN c.ts <= v.ts + INTERVAL 12 HOUR THEN c.event_id END AS click, CASE WHEN c.ts <= v.ts + INTERVAL 12 HOUR THEN c.ts END AS at
  FROM {_STEP.format('view')} v ASOF LEFT JOIN {_STEP.format('click')} c ON v.user_id = c.user_id AND v.ts < c.ts)
SELECT c.user_id, view, click, CASE WHEN p.ts <= c.at + INTERVAL 12 HOUR THEN p.event_id END AS purchase,
       1 + (click IS NOT NULL)::BIGINT + coalesce(p.ts <= c.at + INTERVAL 12 HOUR, false)::BIGINT AS reached
FROM c ASOF LEFT JOIN {_STEP.format('purchase')} p ON c.user_id = p.user_id AND c.at < p.ts"""
)
def event_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views, the click within twelve hours of each, and the purchase within twelve hours of that."""
    kinds = {k: F.col("event_type") == k for k in ("view", "click", "purchase")}
    return funnel(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", kinds, 12 * 3600)
