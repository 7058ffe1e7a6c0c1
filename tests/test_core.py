"""All queries of the core against DuckDB, and the helpers against brute force."""

import threading

import pytest
from support import SF
from pyspark.sql import functions as F

from millrace import registry, storage, tables
from millrace.operators import joins, windows
from millrace.storage import staged


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(name, same_as_sql):
    same_as_sql(registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql(name, spark):
    assert registry.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["q1_pricing_summary", "revenue_top10", "q7_volume", "agg_sum_decimal"])
def test_results_do_not_depend_on_partitions(name, spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(tuple, registry.QUERIES[name](spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert len(entry.entry(spark).take(1)) == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("width", [1, 4, 1000])
def test_asof_join_against_brute_force(spark, width):
    left = [(1, 10, 5), (2, 10, 1), (3, 20, 9), (4, None, 3), (5, 10, 7), (6, 30, 50), (7, 10, 40), (8, 10, 40)]
    right = [(100, 10, 2), (101, 10, 5), (102, 10, 5), (103, 20, 10), (104, None, 1), (105, 30, 3), (106, 10, 12)]
    a = spark.createDataFrame(left, "id long, k long, t long")
    b = spark.createDataFrame(right, "rid long, k long, t long")
    got = {r["id"]: r["asof_rid"] for r in joins.asof_join(a, b, ["k"], "t", "t", ["rid"], "rid", width).collect()}
    want = {i: max(((u, r) for r, j, u in right if j == k and k is not None and u <= t), default=(0, None))[1] for i, k, t in left}
    assert got == want


def test_interval_join_against_brute_force(spark):
    from datetime import datetime, timedelta

    zero = datetime(2024, 1, 1)
    left = [(i, i % 2, zero + timedelta(seconds=37 * i, milliseconds=500)) for i in range(30)] + [(99, None, zero)]
    right = [(i, i % 2, zero + timedelta(seconds=41 * i)) for i in range(30)] + [(98, 0, zero + timedelta(milliseconds=500)), (97, None, zero)]
    a = spark.createDataFrame(left, "i long, k long, t timestamp_ntz")
    b = spark.createDataFrame(right, "j long, k long, u timestamp_ntz")
    got = sorted((r["i"], r["j"]) for r in joins.interval_join(a, b, ["k"], "t", "u", 90).collect())
    assert got == sorted((i, j) for i, k, t in left for j, m, u in right if k is not None and k == m and t <= u <= t + timedelta(seconds=90))


def test_salted_join_keeps_rows(spark):
    a = spark.range(1000).select(F.lit(1).alias("k"), "id")
    b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert joins.salted_join(a, b, "k", 8).count() == 1000


def test_top_k_is_planned_with_a_group_limit(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    best = windows.top_k(df, 2, ["g"], [F.desc("id")])
    assert sorted(r["id"] for r in best.collect()) == [94, 95, 96, 97, 98, 99]
    assert "WindowGroupLimit" in best._jdf.queryExecution().toString()


def test_filter_and_columns_reach_the_scan(spark):
    plan = registry.QUERIES["filter_pred"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    pushed, read = plan.split("PushedFilters")[1].split("ReadSchema")
    assert "GreaterThan(o_totalprice,200000.0)" in pushed and "o_custkey" not in read.split(">")[0]


def test_staged_survives_its_source(spark):
    df = staged(spark.range(10), "test")
    assert df.count() == 10 and "parquet" in df.inputFiles()[0]


def test_a_run_deletes_its_own_tables_alone(spark):
    first = staged(spark.range(3), "test")
    with storage.Run() as mine:
        second = staged(spark.range(4), "test")
        thread = threading.Thread(target=lambda: others.append(staged(spark.range(6), "test")))
        others = []
        thread.start()
        thread.join()
        third = mine.staged(second, "test")
    assert first.count() == 3 and third.count() == 4 and others[0].count() == 6
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        second.collect()


def test_null_keys_in_joins(spark):
    a = spark.createDataFrame([(1, None), (2, 3)], "i int, k int")
    assert a.alias("a").join(a.alias("b"), F.col("a.k") == F.col("b.k")).count() == 1
    assert a.alias("a").join(a.alias("b"), F.col("a.k").eqNullSafe(F.col("b.k"))).count() == 2


def test_names_in_strings_are_no_tables(spark):
    got = tables.sql(spark, SF, """SELECT 'orders' AS a, "part's {x}" AS b, r_name AS `nation` FROM region -- lineitem
        WHERE r_name != 'it''s region'""")
    assert got.columns == ["a", "b", "nation"] and got.count() == 5
    assert set(got.select("a", "b").first()) == {"orders", "part's {x}"}


ODD_ORDERS = [
    *[(None, "F", "1"), (3, None, "1"), (4, "F", None), (5, "", "1"), (6, "F", ""), (7, "", ""), (8, " ", "F"), (9, "O", "F"), (10, "F ", " é"), (11, "&amp;F", "&lt;b&gt;")],
    *[(12, "a<x>b</x>", "F"), (13, "<x>F</x>", "1"), (14, "<x/>", "1"), (15, "<!-- c -->F", "1"), (16, "a<!-- c -->b", "1"), (17, "", "a<!-- c -->b"), (18, "<![CDATA[<F>]]>", "F")],
    *[(19, "O</p><p>P", "F"), (20, "</p><p>", "F"), (21, "O</p>F<p>", "1"), (22, "<p>F</p>", "1"), (23, "a", "<x/>b<x/>F")],
]


def test_xpath_of_odd_documents(spark, tmp_path):
    spark.createDataFrame(ODD_ORDERS, "o_orderkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    document = """concat('<o key="', o_orderkey + 1, '"><p>', o_orderstatus, '</p><p>', o_orderpriority, '</p></o>')"""
    calls = ["xpath_long(x, 'o/@key') AS key", "xpath_string(x, 'o/p[2]') AS second", "xpath(x, 'o/p/text()') AS parts", "xpath_boolean(x, 'o/p = \"F\"') AS done"]
    one_by_one = tables.table(spark, str(tmp_path), "orders").selectExpr("o_orderkey", f"{document} AS x").selectExpr("o_orderkey", *calls)
    got = registry.QUERIES["xpath"](spark, str(tmp_path))
    assert got.schema == one_by_one.schema
    assert sorted(map(repr, got.collect())) == sorted(map(repr, one_by_one.collect()))


def test_xpath_reads_a_plain_document_once_and_keeps_long_keys(spark, tmp_path):
    spark.createDataFrame([(2**53, "F", "1-URGENT")], "o_orderkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = registry.QUERIES["xpath"](spark, str(tmp_path))
    assert list(map(tuple, got.collect())) == [(2**53, 2**53 + 1, "1-URGENT", ["F", "1-URGENT"], True)]
    above, below = got._jdf.queryExecution().optimizedPlan().toString().splitlines()[:2]
    assert below.count("XPath") == 1 and above.count("XPath") == above.count("ELSE invoke(XPath")


def test_a_broken_import_is_shown(monkeypatch):
    import __spark_entry__ as entry

    def broken(name):
        raise ModuleNotFoundError("No module named 'xxhash'", name="xxhash")

    monkeypatch.setattr(entry.importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        entry.queries()
