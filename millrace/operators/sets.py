"""Sorting, limits, set operations, generators, recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, statement
from ..tables import table

statement("sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
statement("sort_offset", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 20")
statement("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
statement("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
statement("intersect_distinct", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
statement("intersect_all", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 INTERSECT ALL SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
statement("except_distinct", "SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_quantity > 10")
statement("except_all", "SELECT l_suppkey AS k FROM lineitem EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'N'")
statement("values_list", "SELECT o_orderkey, label FROM orders JOIN (VALUES ('1-URGENT', 'now'), ('5-LOW', NULL)) AS t(priority, label) ON o_orderpriority = priority")
statement("cte_reuse", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT a.o_custkey FROM big a WHERE a.n > (SELECT avg(n) FROM big)")


@query("SELECT event_id, i - 1 AS pos, parts[i] AS part FROM (SELECT event_id, string_split(event_type || '-' || user_id, '-') AS parts FROM events), unnest(range(1, len(parts) + 1)) AS u(i)")
def explode_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split(F.concat_ws("-", "event_type", F.col("user_id").cast("string")), "-")
    e = table(spark, sf_dir, "events").select("event_id", F.posexplode(parts).alias("pos", "part"))
    return e.withColumn("pos", F.col("pos").cast("long"))


@query("SELECT n_nationkey, unnest(range(0, n_regionkey + 1)) AS step FROM nation")
def explode_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_regionkey").cast("long"))).alias("step"))


@query("SELECT n, count(p_partkey) AS parts FROM (SELECT unnest(range(0, 60, 3)) AS n) r LEFT JOIN part ON p_size BETWEEN n AND n + 2 GROUP BY n")
def range_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by size, with a row for each range of three sizes even where there is none."""
    sizes = table(spark, sf_dir, "part").groupBy((F.col("p_size") - F.col("p_size") % 3).cast("long").alias("n")).agg(F.count(F.lit(1)).alias("parts"))
    return spark.range(0, 60, 3).withColumnRenamed("id", "n").join(sizes, "n", "left").select("n", F.coalesce("parts", F.lit(0)).alias("parts"))
