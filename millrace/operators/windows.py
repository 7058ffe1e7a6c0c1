"""Window functions, and the best rows of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query, statement
from ..tables import table


def top_k(df: DataFrame, k: int, by: list[str], order: list[Column]) -> DataFrame:
    """The first k rows of each group; order has to end with a unique column.

    A rank below a filter is planned as a group limit before the shuffle, so each task sends k rows of a group at most.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("_rank") <= k).withColumn("rank", F.col("_rank").cast("long")).drop("_rank")


_BY_ORDER = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


def _ranked(name: str, call: str) -> None:
    statement(name, f"SELECT o_orderkey, cast({call} {_BY_ORDER} AS bigint) AS r FROM orders")


_ranked("win_row_number", "row_number()")
_ranked("win_ntile", "ntile(3)")
statement("win_rank", "SELECT p_partkey, cast(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS bigint) AS r, cast(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS bigint) AS d FROM part")
statement("win_percent_rank", "SELECT p_partkey, percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS p, cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size) AS c FROM part")
statement("win_lag_lead", f"SELECT o_orderkey, lag(o_orderkey, 1) {_BY_ORDER} AS before, lead(o_orderkey, 2, -1) {_BY_ORDER} AS after FROM orders")
_WHOLE = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
statement("win_first_last_nth", f"SELECT o_orderkey, first_value(o_orderkey) {_WHOLE} AS f, last_value(o_orderkey) {_WHOLE} AS l, nth_value(o_orderkey, 2) {_WHOLE} AS n FROM orders")
statement("win_rows_frame", "SELECT event_id, sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM events", "SELECT event_id, (sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))::BIGINT AS s FROM events")
statement("win_range_num", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM part")
statement("win_range_interval", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS n FROM events")
statement("win_running_total", "SELECT o_orderkey, cast(sum(cast(o_totalprice AS decimal(12,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS double) AS total FROM orders")
statement(
    "win_sessions",
    "SELECT user_id, session, count(*) AS n, min(ts) AS first, max(ts) AS last FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '6' HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, session",
    "SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS first, max(ts) AS last FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '6' HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, session",
)


@query("SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 3")
def win_topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return top_k(c, 3, ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")])
