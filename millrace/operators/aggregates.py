"""Aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, statement
from ..tables import table

statement("agg_count", "SELECT l_returnflag, count(*) AS n, count(nullif(l_linestatus, 'F')) AS n_open FROM lineitem GROUP BY l_returnflag")
statement("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey, l_linenumber) AS pairs FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT (l_suppkey, l_linenumber)) AS pairs FROM lineitem GROUP BY l_returnflag")
statement("agg_sum_int", "SELECT p_brand, sum(p_size) AS sizes, min(p_size) AS least, max(p_name) AS last FROM part GROUP BY p_brand", "SELECT p_brand, sum(p_size)::BIGINT AS sizes, min(p_size) AS least, max(p_name) AS last FROM part GROUP BY p_brand")
statement("agg_sum_decimal", "SELECT o_orderstatus, cast(sum(cast(o_totalprice AS decimal(12,2))) AS double) AS total FROM orders GROUP BY o_orderstatus")
statement("agg_avg", "SELECT l_linestatus, round(cast(sum(cast(l_quantity AS decimal(12,2))) AS double) / count(*), 6) AS mean FROM lineitem GROUP BY l_linestatus")
statement("agg_global", "SELECT count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders")
statement("agg_stddev_var", "SELECT p_brand, round(stddev_samp(p_size), 8) AS deviation, round(var_pop(p_size), 8) AS variance FROM part GROUP BY p_brand")
statement("agg_corr", "SELECT round(corr(p_size, p_retailprice), 9) AS r, round(covar_pop(p_size, p_retailprice), 6) AS c FROM part")
# these two keep all distinct values of a group in one buffer; selection.exact_percentiles doesn't
statement("agg_percentile", "SELECT p_brand, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY p_size), 9) AS p90, cast(percentile_disc(0.25) WITHIN GROUP (ORDER BY p_size) AS double) AS p25 FROM part GROUP BY p_brand")
statement("agg_median", "SELECT p_type, median(p_size) AS middle FROM part GROUP BY p_type")
statement("agg_mode", "SELECT o_orderstatus, mode() WITHIN GROUP (ORDER BY o_orderpriority) AS priority FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, arg_min(o_orderpriority, (-n, o_orderpriority)) AS priority FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_orderstatus")
statement(
    "agg_skew_kurt",
    "SELECT round(skewness(p_size) * sqrt(count(*) * (count(*) - 1)) / (count(*) - 2), 8) AS skew, round(kurtosis(p_size), 8) AS kurt FROM part",
    "SELECT round(skewness(p_size), 8) AS skew, round(kurtosis_pop(p_size), 8) AS kurt FROM part",
)
statement("agg_filter", "SELECT event_type, count(*) FILTER (WHERE user_id % 2 = 0) AS even, count(*) FILTER (WHERE user_id % 2 = 1) AS odd FROM events GROUP BY event_type")
statement("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
statement("agg_listagg", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
statement("agg_max_by", "SELECT user_id, max_by(event_type, event_id) AS last, min_by(event_type, event_id) AS first FROM events GROUP BY user_id")
statement("agg_bool", "SELECT l_returnflag, bool_and(l_quantity < 50) AS every_below, bool_or(l_quantity = 50) AS some_50 FROM lineitem GROUP BY l_returnflag")
statement("agg_bits", "SELECT n_regionkey, bit_or(n_nationkey) AS o, bit_xor(n_nationkey) AS x FROM nation GROUP BY n_regionkey")
statement("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag)::TINYINT AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())")
statement("rollup", "SELECT n_regionkey, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, c_mktsegment)")
statement("cube", "SELECT p_brand, p_type, count(*) AS n, grouping_id(p_brand, p_type) AS g FROM part GROUP BY CUBE (p_brand, p_type)")


@query("SELECT event_type, sum(d = 0)::BIGINT AS \"0\", sum(d = 1)::BIGINT AS \"1\", sum(d = 2)::BIGINT AS \"2\" FROM (SELECT event_type, (user_id % 3)::INT AS d FROM events) GROUP BY event_type")
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 3).cast("int").alias("d"))
    return e.groupBy("event_type").pivot("d", [0, 1, 2]).agg(F.count(F.lit(1)))


@query("SELECT p_partkey, 'size' AS name, p_size::BIGINT AS value FROM part UNION ALL SELECT p_partkey, 'key', p_partkey FROM part")
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("size"), F.col("p_partkey").alias("key"))
    return p.unpivot("p_partkey", ["size", "key"], "name", "value")


@query("SELECT o_orderpriority, array_to_string(list_sort(list(DISTINCT o_orderstatus)), '') AS statuses FROM orders GROUP BY o_orderpriority")
def agg_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.array_join(F.sort_array(F.collect_set("o_orderstatus")), "").alias("statuses"))


@query("SELECT s_nationkey, sum(l_quantity::BIGINT)::BIGINT AS quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey")
def agg_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates below the join first, so that only one row for each supplier meets the dimension."""
    below = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    return below.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey").agg(F.sum("q").alias("quantity"))


def _near(estimate: Column, exact: Column, share: float = 0.1) -> Column:
    return F.abs(estimate - exact) <= share * exact


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS exact, true AS near FROM lineitem GROUP BY l_returnflag")
def agg_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact number, and whether the estimate is within a tenth of it."""
    exact = F.count_distinct("l_partkey")
    l = table(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    return l.agg(exact.alias("exact"), F.approx_count_distinct("l_partkey", 0.02).alias("about")).select("l_returnflag", "exact", _near(F.col("about"), F.col("exact")).alias("near"))


def bitmap_distinct(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """key and the exact number of its distinct whole numbers, by bitmaps of 32,768 values, which merge with or."""
    maps = df.groupBy(key, F.bitmap_bucket_number(value).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("m"))
    return maps.groupBy(key).agg(F.sum(F.bitmap_count("m")).alias(name))


@query("SELECT l_returnflag, true AS hll, true AS theta, true AS kll, true AS middle, true AS frequencies, 8::BIGINT AS bins, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
def agg_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches that merge: distinct counts (HLL, theta), quantiles (KLL, percentile), frequencies, a histogram, a bitmap."""
    l = table(spark, sf_dir, "lineitem")
    made = l.groupBy("l_returnflag").agg(
        F.median("l_quantity").alias("exact"),
        F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey", 12)).alias("hll"),
        F.theta_sketch_estimate(F.theta_sketch_agg("l_partkey")).alias("theta"),
        F.kll_sketch_get_quantile_bigint(F.kll_sketch_agg_bigint(F.col("l_quantity").cast("long")), F.lit(0.5)).alias("kll"),
        F.percentile_approx("l_quantity", 0.5, 1000).alias("middle"),
        (F.length(F.count_min_sketch("l_partkey", F.lit(0.01), F.lit(0.95), F.lit(7))) > 0).alias("frequencies"),
        F.size(F.histogram_numeric("l_quantity", F.lit(8))).cast("long").alias("bins"),
    )
    near = [_near(F.col(c), F.col("parts")).alias(c) for c in ("hll", "theta")] + [_near(F.col(c), F.col("exact")).alias(c) for c in ("kll", "middle")]
    # a distinct count beside the sketches would make them for each distinct value first
    suppliers = bitmap_distinct(l.withColumnRenamed("l_returnflag", "flag"), "flag", "l_suppkey", "suppliers")
    parts = l.groupBy(F.col("l_returnflag").alias("of")).agg(F.count_distinct("l_partkey").alias("parts"))
    made = made.join(suppliers, F.col("l_returnflag").eqNullSafe(F.col("flag"))).join(parts, F.col("l_returnflag").eqNullSafe(F.col("of")))
    return made.select("l_returnflag", *near, "frequencies", "bins", "suppliers")


@query("SELECT l_returnflag, sum(l_quantity) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 1) AS revenue FROM lineitem GROUP BY l_returnflag")
def agg_sum_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of doubles; whole ones are exact, others are rounded, as their last digits turn with the order."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    return l.agg(F.sum("l_quantity").alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 1).alias("revenue"))


@query("SELECT l_returnflag, avg(l_quantity) AS quantity, round(avg(l_extendedprice), 3) AS price FROM lineitem GROUP BY l_returnflag")
def agg_avg_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("quantity"), F.round(F.avg("l_extendedprice"), 3).alias("price"))


@query("SELECT l_returnflag, ((2 * sum((l_extendedprice::DECIMAL(12, 2) * 100)::BIGINT)::HUGEINT * 10000 + count(*)) // (2 * count(*)))::BIGINT AS millionths FROM lineitem GROUP BY l_returnflag")
def agg_avg_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The average of a decimal has four more digits; here as a whole number of millionths."""
    mean = F.avg(F.col("l_extendedprice").cast("decimal(12,2)"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg((mean * 1_000_000).cast("long").alias("millionths"))



@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag")
def agg_bitmap_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitmap_distinct(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_suppkey", "n")
