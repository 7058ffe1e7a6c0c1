"""Decision-support queries over the star schema. Money is summed as exact decimals, so results don't depend on row order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.projections import money
from ..registry import query, statement
from ..tables import table

_NET = "cast(l_extendedprice AS decimal(12,2)) * (1 - cast(l_discount AS decimal(12,2)))"


@query(f"""
SELECT l_orderkey, o_orderdate, cast(sum({_NET}) AS DOUBLE) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""")
def revenue_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten open orders of a segment with the most revenue."""
    day = F.expr("timestamp_ntz '1998-03-15'")
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < day).select("o_orderkey", "o_custkey", "o_orderdate")
    l = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") > day)
    joined = l.join(o.join(c, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    revenue = F.sum(money("l_extendedprice") * (1 - money("l_discount"))).cast("double")
    return joined.groupBy("l_orderkey", "o_orderdate").agg(revenue.alias("revenue")).orderBy(F.desc("revenue"), "l_orderkey").limit(10)


@query(f"""
SELECT l_returnflag, l_linestatus, sum(l_quantity::BIGINT)::BIGINT AS sum_qty,
       cast(sum(cast(l_extendedprice AS decimal(12,2))) AS DOUBLE) AS sum_base,
       cast(sum({_NET}) AS DOUBLE) AS sum_net,
       cast(sum({_NET} * (1 + cast(l_tax AS decimal(12,2)))) AS DOUBLE) AS sum_charge, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY l_returnflag, l_linestatus""")
def q1_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.expr("timestamp_ntz '2001-09-02'"))
    net = money("l_extendedprice") * (1 - money("l_discount"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("sum_qty"),
        F.sum(money("l_extendedprice")).cast("double").alias("sum_base"),
        F.sum(net).cast("double").alias("sum_net"),
        F.sum(net * (1 + money("l_tax"))).cast("double").alias("sum_charge"),
        F.count(F.lit(1)).alias("n"),
    )


statement(
    "q5_local_suppliers",
    f"SELECT n_name, cast(sum({_NET}) AS double) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP_NTZ '1996-01-01' AND o_orderdate < TIMESTAMP_NTZ '1998-01-01' GROUP BY n_name",
    f"SELECT n_name, cast(sum({_NET}) AS double) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY n_name",
)
_Q6 = "SELECT cast(sum(cast(l_extendedprice AS decimal(12,2)) * cast(l_discount AS decimal(12,2))) AS double) AS revenue FROM lineitem WHERE l_shipdate >= {0} '1996-01-01' AND l_shipdate < {0} '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24"
statement("q6_forecast", _Q6.format("TIMESTAMP_NTZ"), _Q6.format("TIMESTAMP"))
_Q7 = "SELECT s.n_name AS supplier_nation, c.n_name AS customer_nation, cast(year(l_shipdate) AS bigint) AS y, cast(sum(" + _NET + ") AS double) AS volume FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation s ON s_nationkey = s.n_nationkey JOIN nation c ON c_nationkey = c.n_nationkey WHERE s.n_regionkey = 3 AND c.n_regionkey = 1 GROUP BY ALL"
statement("q7_volume", _Q7)
_Q14 = "SELECT round(100.0 * cast(sum(CASE WHEN p_type = 'PROMO' THEN {0} ELSE 0 END) AS double) / cast(sum({0}) AS double), 9) AS share FROM lineitem JOIN part ON l_partkey = p_partkey"
statement("q14_promotion", _Q14.format(_NET))
statement("q18_large_orders", "SELECT c_name, o_orderkey, o_totalprice, s.q AS quantity FROM (SELECT l_orderkey, sum(cast(l_quantity AS bigint)) AS q FROM lineitem GROUP BY l_orderkey HAVING sum(cast(l_quantity AS bigint)) > 200) s JOIN orders ON o_orderkey = s.l_orderkey JOIN customer ON c_custkey = o_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 100", "SELECT c_name, o_orderkey, o_totalprice, s.q::BIGINT AS quantity FROM (SELECT l_orderkey, sum(cast(l_quantity AS bigint)) AS q FROM lineitem GROUP BY l_orderkey HAVING sum(cast(l_quantity AS bigint)) > 200) s JOIN orders ON o_orderkey = s.l_orderkey JOIN customer ON c_custkey = o_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
