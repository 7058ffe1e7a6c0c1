"""Joins: built-in ones, and as-of, range and salted joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType

from ..registry import query, statement
from ..tables import table


def axis(df: DataFrame, name: str) -> Column:
    """A column's place on a line: numbers as they are, times as whole seconds.

    Times without a zone are counted on their own clock, which knows no summer time, so what lies an hour apart there does here.
    """
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, NumericType):
        return c
    if isinstance(kind, (TimestampNTZType, DateType)):
        return ((c.cast("timestamp_ntz") - F.expr("TIMESTAMP_NTZ '1970-01-01'")).cast("interval second")).cast("long")
    return F.unix_seconds(c)


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, take: list[str], tie: str, width: int = 86_400) -> DataFrame:
    """Each row of left with `take` of the last row of right that has its keys and no later time; null if there is none.

    Both sides go through one shuffle by keys and piece of time, as one frame in order of time, and the last right row is carried
    along: rows never multiply as they would in a join with a range condition. What a piece has at its beginning comes from one
    row for each key and piece, so a key with a third of all rows is spread over its pieces. width: seconds in a piece, for
    times; units for numbers. Of right rows with equal times, the greatest `tie` counts. Null keys meet nothing.
    """
    def kind(df: DataFrame, c: Column) -> str:
        return df.select(c.alias("c")).schema["c"].dataType.simpleString()

    def piece(df: DataFrame, time: str) -> Column:
        return F.floor(axis(df, time) / width)

    value = F.struct(*[F.col(c) for c in take])
    a = left.select(*keys, F.col(left_time).alias("_time"), piece(left, left_time).alias("_piece"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_tie"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(kind(right, value)).alias("_value"))
    b = right.dropna(subset=keys).select(*keys, F.col(right_time).alias("_time"), piece(right, right_time).alias("_piece"), F.lit(0).alias("_side"), F.col(tie).cast("long").alias("_tie"), F.lit(None).cast(kind(left, F.struct(*left.columns))).alias("_row"), value.alias("_value"))
    rows = a.unionByName(b)
    within = Window.partitionBy(*keys, "_piece").orderBy("_time", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    carried = rows.withColumn("_last", F.last("_value", ignorenulls=True).over(within)).where("_side = 1")
    ends = rows.select(*keys, "_piece", F.when(F.col("_side") == 0, F.struct("_time", "_tie", "_value")).alias("_end")).groupBy(*keys, "_piece").agg(F.max("_end")["_value"].alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_piece").alias("_p"), F.last("_end", ignorenulls=True).over(before).alias("_before")).where("_before IS NOT NULL")
    on = F.col("_piece") == F.col("_p")
    for k in keys:
        on &= F.col(k) == F.col(f"_k_{k}")
    met = carried.join(ends, on, "left").withColumn("_last", F.coalesce("_last", "_before"))
    return met.select("_row.*", *[F.col(f"_last.{c}").alias(f"asof_{c}") for c in take])


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, width: int) -> DataFrame:
    """Rows with equal keys where right's time is between left's and `width` seconds later, both included.

    An equality join on keys and pieces of time, of which a left row stands in two, and a check: a key with a third of all rows
    is spread over its pieces. Columns besides keys differ; both times are of one type.
    """
    if left.schema[left_time].dataType != right.schema[right_time].dataType:
        raise ValueError("interval_join: the times are of different types")

    def piece(df: DataFrame, time: str) -> Column:
        return F.floor(axis(df, time) / width)

    first = piece(left, left_time)
    a = left.withColumn("_piece", F.explode(F.array(first, first + 1)))
    met = a.join(right.withColumn("_piece", piece(right, right_time)), [*keys, "_piece"])
    return met.where((F.col(right_time) >= F.col(left_time)) & (F.col(right_time) <= F.col(left_time) + F.expr(f"INTERVAL '{width}' SECOND"))).drop("_piece")


def salted_join(large: DataFrame, small: DataFrame, key: str, salts: int, how: str = "inner", by: Column | None = None) -> DataFrame:
    """An equality join in which each key of large is dealt over `salts` tasks and small is repeated as often.

    For keys so frequent that splitting at run time doesn't do; `how` may be inner or left.
    """
    a = large.withColumn("_salt", F.pmod(F.xxhash64(*large.columns) if by is None else by, F.lit(salts)).cast("int"))
    b = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [key, "_salt"], how).drop("_salt")


def dimension(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; else as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def not_listed(df: DataFrame, key: str, listed: DataFrame, name: str = "not_listed") -> DataFrame:
    """df with the truth of SQL's `key NOT IN (listed)`, null where that is unknown. listed has one column.

    Spark has a nested loop for a NOT IN that may be null beside another condition, and broadcasts the list for one that stands
    alone. Here each value of the list meets its keys once, by an equality; how many values and nulls there are comes from one row.
    """
    value = F.col(listed.columns[0])
    held = listed.select(value.alias("_value")).groupBy("_value").agg(F.count(F.lit(1)).alias("_times"))
    told = held.agg(F.count(F.lit(1)).alias("_values"), F.count_if(F.col("_value").isNull()).alias("_nulls"))
    met = df.join(held.where("_value IS NOT NULL").select("_value"), F.col(key) == F.col("_value"), "left").join(F.broadcast(told))
    unknown = F.col(key).isNull() | (F.col("_nulls") > 0)
    truth = F.when(F.col("_values") == 0, True).when(F.col("_value").isNotNull(), False).when(~unknown, True)
    return met.withColumn(name, truth).drop("_value", "_values", "_nulls")


statement("join_inner", "SELECT c_custkey, c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 100000")
statement("join_left", "SELECT o_orderkey, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 45")
statement("join_right", "SELECT s_suppkey, n_name FROM nation RIGHT JOIN supplier ON n_nationkey = s_nationkey AND n_regionkey = 1")
statement(
    "join_full",
    "SELECT c.k AS customer_nation, s.k AS supplier_nation, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey < 18 GROUP BY c_nationkey) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 6 GROUP BY s_nationkey) s ON c.k = s.k",
)
statement("join_semi", "SELECT o_orderkey FROM orders LEFT SEMI JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R'", "SELECT o_orderkey FROM orders SEMI JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R'")
statement("join_anti", "SELECT o_orderkey FROM orders LEFT ANTI JOIN lineitem ON o_orderkey = l_orderkey", "SELECT o_orderkey FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey")
statement("exists_subquery", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
statement("scalar_subquery", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer WHERE c_nationkey = (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 2)")
statement("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
statement("join_theta", "SELECT a.o_orderkey AS earlier, b.o_orderkey AS later FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate < b.o_orderdate WHERE a.o_totalprice > 300000")
statement("join_using", "SELECT doc_id, quality, source FROM documents JOIN labels USING (doc_id)")
statement("join_self_nulls", "SELECT a.n_nationkey AS n, b.r_name FROM nation a LEFT JOIN region b ON nullif(a.n_regionkey, 3) <=> b.r_regionkey", "SELECT a.n_nationkey AS n, b.r_name FROM nation a LEFT JOIN region b ON nullif(a.n_regionkey, 3) IS NOT DISTINCT FROM b.r_regionkey")
statement(
    "join_lateral",
    "SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2)",
    "SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) AS t",
)


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select("l_partkey")
    return not_listed(table(spark, sf_dir, "part"), "p_partkey", listed).where("not_listed").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT nullif(l_partkey, 7) FROM lineitem) OR p_partkey < 20")
def not_in_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a null among them, no other key is known not to be in the list; keys below 20 come by the other condition alone."""
    listed = table(spark, sf_dir, "lineitem").select(F.expr("nullif(l_partkey, 7)"))
    return not_listed(table(spark, sf_dir, "part"), "p_partkey", listed).where("not_listed OR p_partkey < 20").select("p_partkey")


@query("SELECT p.event_id, p.ts, v.event_id AS asof_event_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts")
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    return asof_join(left, e.where("event_type = 'view'"), ["user_id"], "ts", "ts", ["event_id"], "event_id").drop("user_id")


@query("SELECT a.event_id AS view_id, b.event_id AS click_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL '2' HOUR WHERE a.event_type = 'view' AND b.event_type = 'click'")
def join_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts"))
    clicks = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts"))
    return interval_join(views, clicks, ["user_id"], "view_ts", "click_ts", 7200).select("view_id", "click_id")


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return salted_join(table(spark, sf_dir, "customer"), small, "c_nationkey", 4, by=F.col("c_custkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


def _hinted(name: str, hint: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small = table(spark, sf_dir, "supplier").hint(hint)
        joined = table(spark, sf_dir, "lineitem").join(small, F.col("l_suppkey") == F.col("s_suppkey"))
        return joined.groupBy("s_name").agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"))

    run.__name__ = name
    query("SELECT s_name, sum(l_quantity::BIGINT)::BIGINT AS quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name")(run)


_hinted("join_sort_merge", "merge")
_hinted("join_shuffle_hash", "shuffle_hash")


@query("SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def join_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star join: the small sides are broadcast after a count of their rows."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(dimension(n), F.col("c_nationkey") == F.col("n_nationkey")).join(dimension(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))
