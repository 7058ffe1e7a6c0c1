"""Joins on ranges and times against brute force, with ends of all kinds and at the changes of a clock."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from support import SF

from millrace import registry
from millrace.operators import joins, ranges

INF = float("inf")


@pytest.fixture
def new_york(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield
    spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("day", [datetime(2024, 11, 3), datetime(2024, 3, 10)])
def test_times_without_a_zone_know_no_summer_time(spark, new_york, day):
    times = [day + timedelta(minutes=10 * i) for i in range(36)]
    a = spark.createDataFrame([(i, 1, t) for i, t in enumerate(times)], "i long, k long, t timestamp_ntz")
    b = a.select(F.col("i").alias("j"), "k", F.col("t").alias("u"))
    got = sorted((r["i"], r["j"]) for r in joins.interval_join(a, b, ["k"], "t", "u", 7200).collect())
    assert got == [(i, j) for i in range(36) for j in range(i, min(i + 13, 36))]
    last = joins.asof_join(a, b.where("j % 7 = 0"), ["k"], "t", "u", ["j"], "j", 1800)
    assert sorted((r["i"], r["asof_j"]) for r in last.collect()) == [(i, i - i % 7) for i in range(36)]
    points = ranges.range_join(a, b.withColumn("v", F.col("u") + F.expr("INTERVAL 25 MINUTES")), "t", "u", "v", 600)
    assert sorted((r["i"], r["j"]) for r in points.collect()) == [(i, j) for i in range(36) for j in range(max(i - 2, 0), i + 1)]


def test_interval_join_refuses_times_of_different_types(spark):
    a = spark.createDataFrame([(1, datetime(2024, 1, 1))], "k int, t timestamp_ntz")
    with pytest.raises(ValueError):
        joins.interval_join(a, a.select("k", F.col("t").cast("timestamp").alias("u")), ["k"], "t", "u", 60)


def some_ranges(rng, n):
    out = []
    for i in range(n):
        low = rng.choice([rng.uniform(-50, 50), rng.randint(-50, 50), -INF])
        high = rng.choice([low + rng.choice([0, 1, 3, 40, 1e6]), low - 2, INF])
        out.append((i, rng.randint(0, 2), float(low), float(high)))
    return [*out, (n, None, 0.0, 9.0), (n + 1, 1, None, 5.0), (n + 2, 1, 5.0, None), (n + 3, 1, -1e18, 1e18)]


@pytest.mark.parametrize(("seed", "width"), [(1, 1.0), (2, 10.0), (3, 0.01)])
def test_overlaps_against_brute_force(spark, seed, width):
    rng = random.Random(seed)
    left, right = some_ranges(rng, 60), some_ranges(rng, 60)
    a, b = spark.createDataFrame(left, "i long, k long, al double, ah double"), spark.createDataFrame(right, "j long, k long, bl double, bh double")

    def meet(x, y):
        ends = (x[2], x[3], y[2], y[3])
        return None not in ends and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3]

    got = sorted((r["i"], r["j"]) for r in ranges.overlap_join(a, b.drop("k"), ("al", "ah"), ("bl", "bh"), width).collect())
    assert got == sorted((x[0], y[0]) for x in left for y in right if meet(x, y))
    keyed = sorted((r["i"], r["j"]) for r in ranges.overlap_join(a, b, ("al", "ah"), ("bl", "bh"), width, ("k",)).collect())
    assert keyed == sorted((x[0], y[0]) for x in left for y in right if meet(x, y) and x[1] is not None and x[1] == y[1])


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_points_in_ranges_against_brute_force(spark, how):
    rng = random.Random(4)
    points = [(i, float(rng.choice([rng.uniform(-60, 60), rng.randint(-60, 60)]))) for i in range(80)] + [(98, None), (99, 4e17), (100, INF)]
    right = some_ranges(rng, 40)[:40] + [(50, 1, 3e17, 5e17)]
    a, b = spark.createDataFrame(points, "i long, p double"), spark.createDataFrame(right, "j long, k long, low double, high double")
    met = {(i, r[0]) for i, p in points for r in right if p is not None and r[2] <= p < r[3]}
    some = {i for i, _ in met}
    rows = ranges.range_join(a, b, "p", "low", "high", 5.0, how).collect()
    if how in ("inner", "left"):
        expected = sorted(met) + ([(i, None) for i, _ in points if i not in some] if how == "left" else [])
        assert sorted(((r["i"], r["j"]) for r in rows), key=str) == sorted(expected, key=str)
    else:
        assert sorted(r["i"] for r in rows) == sorted(i for i, _ in points if (i in some) == (how == "left_semi"))


def test_a_long_range_makes_few_rows(spark):
    b = spark.createDataFrame([(0.0, 3e6)], "low double, high double")
    assert ranges._in_bins(ranges._ranges(b, "low", "high", 1.0).withColumn("_at", F.col("_level")), 1.0).count() <= 3


@pytest.mark.parametrize("how", ["right", "full", "outer", "cross"])
def test_range_join_refuses_joins_that_repeat_right_rows(spark, how):
    a, b = spark.createDataFrame([(1.0,)], "p double"), spark.createDataFrame([(0.0, 9.0)], "low double, high double")
    with pytest.raises(ValueError):
        ranges.range_join(a, b, "p", "low", "high", 1.0, how)


@pytest.mark.parametrize("name", ["join_overlap", "join_overlap_ship", "join_range"])
def test_no_nested_loop(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize(("plain", "hot"), [(64, 10_000), (2, 10_000), (0, 10_000), (0, 1)])
def test_hot_keys_go_by_bins_and_others_whole(spark, monkeypatch, plain, hot):
    monkeypatch.setattr(ranges, "PLAIN", plain)
    monkeypatch.setattr(ranges, "HOT", hot)
    rows = [(i, None if i == 7 else min(i % 11, 3), float(i % 17), float(i % 17 + i % 5)) for i in range(120)]
    a, b = spark.createDataFrame(rows, "i long, k long, al double, ah double"), spark.createDataFrame(rows[::2], "j long, k long, bl double, bh double")
    got = ranges.overlap_join(a, b, ("al", "ah"), ("bl", "bh"), 1.0, ("k",))
    assert got.columns == ["k", "i", "al", "ah", "j", "bl", "bh"]
    want = sorted((i, j) for i, k, al, ah in rows for j, m, bl, bh in rows[::2] if k is not None and k == m and al < bh and bl < ah and al < ah and bl < bh)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == want


def test_pairs_of_many_ranges_at_the_same_times_are_stored_small(spark, tmp_path):
    """Pairs grow with the square of the rows, so what a pair takes on disk tells if they can be kept."""
    def some(n, name, length):
        place, more = (F.pmod(F.xxhash64("id", F.lit(f"{name}{k}")), F.lit(1_000_000)) / 1_000_000.0 for k in "ab")
        return spark.range(n).select(F.col("id").alias(name), (place * 5_000).alias(f"{name}_low"), more.alias("m")).select(name, f"{name}_low", (F.col(f"{name}_low") + length).alias(f"{name}_high"))

    a, b = some(2_000, "i", F.lit(1_200.0)), some(12_000, "j", 60 + F.col("m") * 5_000)
    ranges.overlap_join(a, b, ("i_low", "i_high"), ("j_low", "j_high"), 1200.0).select("i", "j").write.parquet(str(tmp_path / "pairs"))
    pairs = spark.read.parquet(str(tmp_path / "pairs")).count()
    assert pairs == a.crossJoin(b).where("i_low < j_high AND j_low < i_high").count() > 1_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.8 * pairs


@pytest.mark.parametrize("tile", [1, 7])
def test_ranges_of_one_cell_meet_others_in_pieces(spark, monkeypatch, tile):
    monkeypatch.setattr(ranges, "TILE", tile)
    rows = [(i, float(i % 3), float(i % 3 + 1 + i % 4 * 30)) for i in range(90)]
    a, b = spark.createDataFrame(rows, "i long, al double, ah double"), spark.createDataFrame(rows, "j long, bl double, bh double")
    got = ranges.overlap_join(a, b, ("al", "ah"), ("bl", "bh"), 10.0)
    assert got.columns == ["i", "al", "ah", "j", "bl", "bh"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(x + y for x in rows for y in rows if x[1] < y[2] and y[1] < x[2])
