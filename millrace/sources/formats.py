"""File formats, each written to the shared folder and read back with a given schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..storage import fresh_path
from ..tables import table


def round_trip(df: DataFrame, kind: str, read: dict[str, str] | None = None, write: dict[str, str] | None = None, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df, written and read in a format; the schema is given, as JSON and XML have neither order nor widths of their own."""
    spark = df.sparkSession
    path = fresh_path(spark, kind)
    df.write.format(kind).options(**(write or {})).partitionBy(*partition_by).save(path)
    return spark.read.format(kind).schema(df.schema).options(**(read or {})).load(path)


def _add(name: str, kind: str, **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_trip(table(spark, sf_dir, "supplier"), kind, **options)

    run.__name__ = name
    query("SELECT * FROM supplier")(run)


_add("rt_parquet", "parquet", write={"compression": "zstd"})
_add("rt_orc", "orc")
_add("rt_csv", "csv", read={"header": "true"}, write={"header": "true"})
_add("rt_json", "json")
_add("rt_xml", "xml", read={"rowTag": "row"}, write={"rowTag": "row"})


@query("SELECT n_name || '|' || n_regionkey AS value FROM nation")
def rt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return round_trip(n.select(F.concat_ws("|", "n_name", F.col("n_regionkey").cast("string")).alias("value")), "text")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def rt_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by segment; the filter reads one folder."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return round_trip(c, "parquet", partition_by=("c_mktsegment",)).where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_mktsegment")
