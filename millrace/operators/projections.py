"""Filters, projections, casts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, statement
from ..tables import table


def money(c: str | Column, digits: int = 12) -> Column:
    """A double that stands for an amount, as an exact decimal: sums don't depend on the order of rows."""
    return (F.col(c) if isinstance(c, str) else c).cast(f"decimal({digits},2)")


@query("SELECT * FROM nation")
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus IN ('O', 'F') AND o_orderpriority LIKE '1%' AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31'")
def filter_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    dates = F.col("o_orderdate").between(F.expr("timestamp_ntz '1996-01-01'"), F.expr("timestamp_ntz '1999-12-31'"))
    return o.where((F.col("o_totalprice") > 200000) & F.col("o_orderstatus").isin("O", "F") & F.col("o_orderpriority").like("1%") & dates).select("o_orderkey", "o_totalprice")


statement("project_arith", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, -l_quantity AS minus FROM lineitem")
statement(
    "case_coalesce",
    "SELECT p_partkey, CASE WHEN p_size > 30 THEN 'large' WHEN p_size > 10 THEN 'medium' ELSE 'small' END AS size_class, coalesce(nullif(p_type, 'PROMO'), 'none') AS type_or_none, greatest(p_size, 25) AS at_least_25, least(p_size, 25) AS at_most_25 FROM part",
)
statement(
    "div_mod",
    "SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit_price, l_orderkey div 7 AS seventh, l_orderkey % 7 AS rest, -l_orderkey % 7 AS minus_rest FROM lineitem",
    "SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit_price, l_orderkey // 7 AS seventh, l_orderkey % 7 AS rest, -l_orderkey % 7 AS minus_rest FROM lineitem",
)
statement(
    "casts",
    "SELECT c_custkey, cast(c_acctbal AS decimal(12,2)) AS amount, cast(floor(c_acctbal) AS int) AS whole, cast(c_custkey AS string) AS text, cast(c_nationkey AS bigint) AS wide, try_cast(c_name AS int) AS none, cast(round(cast(c_acctbal AS decimal(12,2)), 1) AS decimal(12,1)) AS tenth FROM customer",
)
statement(
    "null_logic",
    "SELECT o_orderkey, nullif(o_orderstatus, 'O') IS NULL AS open, nullif(o_orderstatus, 'O') IS DISTINCT FROM 'F' AS not_filled, coalesce(nullif(o_orderstatus, 'O') = 'F', false) AS filled FROM orders",
)
statement("select_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
