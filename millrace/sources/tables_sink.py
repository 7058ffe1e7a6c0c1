"""A table of Parquet folders that is changed by key: only the partitions that changes touch are written again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..registry import query
from ..storage import fresh_path, staged
from ..tables import table


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table, by its declared schema: folder names are text, and without it '01' would be read as the number 1."""
    return spark.read.schema(schema).parquet(path)


def upsert(spark: SparkSession, path: str, changes: DataFrame, key: str, partition: str, schema: StructType | None = None) -> None:
    """Rows of changes take the place of the row with their key, wherever it stood, or come new.

    schema: the table's, that of changes if it isn't given. Two changes of one key, or a null key, are an error, before anything is
    written. A key that moves leaves its old partition, so partitions are touched in which changed keys stand or will stand; a
    partition may be null, and an empty string counts as null, as it does to Spark. Keys and partitions meet by joins; of the table, untouched partitions are read for their keys alone.

    The touched partitions are written to the shared folder first. Then each takes the place of the old one; Spark does that
    one by one, so a run that breaks off there has replaced some of them: the same call again puts that right, as it sets the same
    rows. A run that breaks off before has changed nothing.
    """
    schema = schema or changes.schema
    columns = schema.fieldNames()
    place = F.when(F.col(partition).cast("string") != "", F.col(partition))
    new = staged(changes.select(*columns).withColumn(partition, place), "upsert-changes")
    wrong = new.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col(key).isNull() | (F.col("n") > 1)).limit(5).collect()
    if wrong:
        raise ValueError(f"upsert: null or repeated keys, such as {[r[0] for r in wrong]}")
    old = read_table(spark, path, schema)
    keys = new.select(F.col(key).alias("_key"))
    places = old.select(key, F.col(partition).alias("_place")).join(keys, F.col(key) == F.col("_key"), "left_semi").select("_place")
    touched = staged(places.union(new.select(partition)).distinct(), "upsert-partitions")
    here = old.join(touched, F.col(partition).eqNullSafe(F.col("_place")), "left_semi")
    kept = here.join(keys, F.col(key) == F.col("_key"), "left_anti")
    whole = staged(kept.select(*columns).unionByName(new), "upsert")
    emptied = touched.join(whole.select(F.col(partition).alias("_left")).distinct(), F.col("_place").eqNullSafe(F.col("_left")), "left_anti")
    gone = [r[0] for r in emptied.collect()]  # one for each folder that has lost all its rows
    salted = whole.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(8)))  # a partition may hold a third of all rows
    out = salted.repartition(partition, "_salt").drop("_salt").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy(partition).parquet(path)
    for value in gone:
        _drop_partition(spark, path, partition, value, schema)


def _drop_partition(spark: SparkSession, path: str, partition: str, value: object, schema: StructType) -> None:
    """Deletes a partition's folder. Spark names it: the value is written as one row to learn how."""
    jvm, probe = spark.sparkContext._jvm, fresh_path(spark, f"upsert-name-{uuid.uuid4().hex}")
    spark.createDataFrame([(value, 1)], StructType([schema[partition], StructField("one", IntegerType())])).write.partitionBy(partition).parquet(probe)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(probe)
    folders = [s.getPath().getName() for s in where.getFileSystem(conf).listStatus(where) if s.isDirectory()]
    for name in folders:
        target = jvm.org.apache.hadoop.fs.Path(path, name)
        target.getFileSystem(conf).delete(target, True)


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 AND c_mktsegment IN ('BUILDING', 'FURNITURE') THEN -1.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer UNION ALL SELECT 10000000, 5.0, 'FURNITURE'")
def sink_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "upsert-table")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    c.write.partitionBy("c_mktsegment").parquet(path)
    changed = c.where("c_custkey % 10 = 3 AND c_mktsegment IN ('BUILDING', 'FURNITURE')").withColumn("c_acctbal", F.lit(-1.0))
    new = spark.createDataFrame([(10_000_000, 5.0, "FURNITURE")], c.schema)
    upsert(spark, path, changed.unionByName(new), "c_custkey", "c_mktsegment")
    return read_table(spark, path, c.schema).select("c_custkey", "c_acctbal", "c_mktsegment")


@query(
    "SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 7 = 2 OR c_mktsegment = 'MACHINERY' THEN NULL WHEN c_mktsegment = 'BUILDING' AND c_custkey % 3 = 0 THEN '01' ELSE c_mktsegment END AS place FROM customer"
)
def sink_upsert_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys move between partitions, into the null one and into '01'; one partition loses all its rows."""
    path = fresh_path(spark, "upsert-moves")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_mktsegment").alias("place"))
    c.withColumn("place", F.when(F.col("c_custkey") % 7 != 2, F.col("place"))).write.partitionBy("place").parquet(path)
    machines = c.where("place = 'MACHINERY'").withColumn("place", F.lit(None).cast("string"))
    upsert(spark, path, machines, "c_custkey", "place")
    moved = c.where("place = 'BUILDING' AND c_custkey % 3 = 0 AND c_custkey % 7 != 2").withColumn("place", F.lit("01"))
    upsert(spark, path, moved, "c_custkey", "place")
    return read_table(spark, path, c.schema).select("c_custkey", "c_acctbal", "place")
