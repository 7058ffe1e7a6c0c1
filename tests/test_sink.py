"""Upserts with null, odd, repeated and moving keys and partitions, and the segment table's commits."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from millrace.sources import segments, tables_sink
from millrace.storage import fresh_path

SCHEMA = "k long, v string, p string"


def made(spark, rows):
    path = fresh_path(spark, "sink-test")
    spark.createDataFrame(rows, SCHEMA).write.partitionBy("p").parquet(path)
    return path


def rows_of(spark, path):
    schema = spark.createDataFrame([], SCHEMA).schema
    return sorted((tuple(r) for r in tables_sink.read_table(spark, path, schema).select("k", "v", "p").collect()), key=str)


@pytest.mark.parametrize(
    ("old", "changes", "expected"),
    [
        ([(1, "a", None), (2, "b", None)], [(1, "c", None)], [(1, "c", None), (2, "b", None)]),
        ([(1, "a", "01"), (2, "b", "1"), (3, "c", "02")], [(1, "d", "01")], [(1, "d", "01"), (2, "b", "1"), (3, "c", "02")]),
        ([(1, "a", "x"), (2, "b", "x"), (3, "c", "y")], [(1, "d", "y")], [(1, "d", "y"), (2, "b", "x"), (3, "c", "y")]),
        ([(1, "a", "x"), (3, "c", "y")], [(1, "d", "y")], [(1, "d", "y"), (3, "c", "y")]),
        ([(1, "a", None), (3, "c", "y")], [(1, "d", "y")], [(1, "d", "y"), (3, "c", "y")]),
        ([(1, "a", "x")], [(1, "d", None), (5, "e", "")], [(1, "d", None), (5, "e", None)]),
        ([(1, "a", "2024-01-01"), (2, "b", "a b/c=d%")], [(2, "z", "a b/c=d%"), (4, "n", "new")], [(1, "a", "2024-01-01"), (2, "z", "a b/c=d%"), (4, "n", "new")]),
        ([(1, "a", "x")], [], [(1, "a", "x")]),
    ],
)
def test_upsert(spark, old, changes, expected):
    path = made(spark, old)
    tables_sink.upsert(spark, path, spark.createDataFrame(changes, SCHEMA), "k", "p")
    assert rows_of(spark, path) == sorted(expected, key=str)


@pytest.mark.parametrize("changes", [[(1, "b", "x"), (1, "c", "x")], [(None, "b", "x")]])
def test_upsert_refuses_repeated_and_null_keys(spark, changes):
    path = made(spark, [(1, "a", "x")])
    with pytest.raises(ValueError):
        tables_sink.upsert(spark, path, spark.createDataFrame(changes, SCHEMA), "k", "p")
    assert rows_of(spark, path) == [(1, "a", "x")]


def test_untouched_partitions_stay_as_they_are(spark):
    path = made(spark, [(i, "a", f"p{i % 3}") for i in range(30)])
    def files():
        return set(glob.glob(path.removeprefix("file:").replace("//", "/") + "/p=p1/*.parquet"))

    before = files()
    tables_sink.upsert(spark, path, spark.createDataFrame([(0, "b", "p0"), (2, "b", "p0")], SCHEMA), "k", "p")
    assert before and files() == before
    assert len(rows_of(spark, path)) == 30


@pytest.fixture
def segment_table(spark):
    segments.register(spark)
    return fresh_path(spark, "segments-test")


def read(spark, path, schema="id long, name string"):
    return spark.read.format(segments.NAME).schema(schema).load(path)


def test_segments_append_and_overwrite(spark, segment_table):
    df = spark.range(100).select("id", F.col("id").cast("string").alias("name"))
    assert read(spark, segment_table).count() == 0
    df.repartition(3).write.format(segments.NAME).mode("append").save(segment_table)
    df.limit(0).write.format(segments.NAME).mode("append").save(segment_table)
    df.withColumn("name", F.lit(None).cast("string")).write.format(segments.NAME).mode("append").save(segment_table)
    got = read(spark, segment_table)
    assert got.count() == 200 and got.where("name IS NULL").count() == 100 and got.where("name IS NOT NULL AND id < 7").count() == 7
    df.where("id < 5").write.format(segments.NAME).mode("overwrite").save(segment_table)
    assert sorted(r["id"] for r in read(spark, segment_table).collect()) == [0, 1, 2, 3, 4]


def test_a_failed_task_leaves_no_rows(spark, segment_table):
    df = spark.range(40).select("id", F.col("id").cast("string").alias("name"))
    df.write.format(segments.NAME).mode("append").save(segment_table)

    def breaks(batches):
        from pyspark import TaskContext

        for b in batches:
            yield b
            if TaskContext.get().partitionId() == 1:
                raise RuntimeError("killed")

    broken = df.repartition(4).mapInArrow(breaks, df.schema)
    with pytest.raises(Exception, match="killed"):
        broken.write.format(segments.NAME).mode("append").save(segment_table)
    assert read(spark, segment_table).count() == 40


@pytest.mark.parametrize(("where", "files"), [("id = 37", 1), ("id >= 90", 1), ("id < 10 AND id > 3", 1), ("id IN (5, 95)", 2), ("id > 1000", 0), ("id IS NOT NULL", 10), ("name = 'x'", 10)])
def test_filters_leave_segments_out(spark, segment_table, where, files):
    spark.range(100).selectExpr("id", "if(id % 2 = 0, 'a', 'z') AS name").repartitionByRange(10, "id").write.format(segments.NAME).mode("append").save(segment_table)
    df = read(spark, segment_table).where(where)
    expected = spark.range(100).selectExpr("id", "if(id % 2 = 0, 'a', 'z') AS name").where(where)
    assert sorted(df.collect()) == sorted(expected.collect())
    assert df.rdd.getNumPartitions() == max(files, 1)
    assert os.path.isdir(segment_table.removeprefix("file:").replace("//", "/"))
