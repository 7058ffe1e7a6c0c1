"""User-defined functions: by column, group, partition, and table functions. Arrow carries the batches.

Functions over groups (udaf_pandas, udf_grouped_map, udf_cogroup, udf_grouped_arrow) get a whole group in one worker: that is how
they are called. For groups of any size see heavy_hitters, selection and prefix_sums among the operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..tables import table


@query("SELECT p_partkey, p_size * 2 + 1 AS odd FROM part")
def udf_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("int")
    def odd(x: pd.Series) -> pd.Series:
        return x * 2 + 1

    return table(spark, sf_dir, "part").select("p_partkey", odd("p_size").alias("odd"))


@query("SELECT p_partkey, p_size + 1 AS more FROM part")
def udf_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.arrow_udf("int")
    def more(x: pa.Array) -> pa.Array:
        return pc.add(x, pa.scalar(1, pa.int32()))

    return table(spark, sf_dir, "part").select("p_partkey", more("p_size").alias("more"))


@query("SELECT p_brand, max(p_size) - min(p_size) AS spread FROM part GROUP BY p_brand")
def udaf_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("int")
    def spread(x: pd.Series) -> int:
        return int(x.max() - x.min())

    return table(spark, sf_dir, "part").groupBy("p_brand").agg(spread("p_size").alias("spread"))


@query("SELECT p_brand, p_partkey, p_size - min(p_size) OVER (PARTITION BY p_brand) AS above FROM part")
def udf_grouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    def above(group: pd.DataFrame) -> pd.DataFrame:
        return group.assign(above=group["p_size"] - group["p_size"].min())[["p_brand", "p_partkey", "above"]]

    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size")
    return p.groupBy("p_brand").applyInPandas(above, "p_brand string, p_partkey long, above int")


@query("SELECT p_partkey FROM part WHERE p_size > 40")
def udf_map_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    def large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pc.greater(b.column("p_size"), 40)).select(["p_partkey"])

    return table(spark, sf_dir, "part").select("p_partkey", "p_size").mapInArrow(large, "p_partkey long")


@query("SELECT coalesce(c, s) AS nation, coalesce(nc, 0) AS customers, coalesce(ns, 0) AS suppliers FROM (SELECT c_nationkey AS c, count(*) AS nc FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey AS s, count(*) AS ns FROM supplier GROUP BY 1) ON c = s")
def udf_cogroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def counts(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"nation": [key[0]], "customers": [len(a)], "suppliers": [len(b)]})

    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.groupBy("k").cogroup(s.groupBy("k")).applyInPandas(counts, "nation int, customers long, suppliers long")


@query("SELECT n_nationkey, unnest(string_split(n_name, '_')) AS part FROM nation")
def udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.udtf(returnType="part string")
    class Parts:
        def eval(self, text: str):
            for part in text.split("_"):
                yield (part,)

    nation = table(spark, sf_dir, "nation")
    return nation.lateralJoin(Parts(F.col("n_name").outer())).select("n_nationkey", "part")


@query("SELECT n_nationkey, length(n_name)::BIGINT AS n FROM nation")
def udf_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of one row, with Arrow batches between the processes."""
    n = F.udf(lambda text: len(text), "long", useArrow=True)
    return table(spark, sf_dir, "nation").select("n_nationkey", n("n_name").alias("n"))


@query("SELECT s_suppkey, k, k * k AS square FROM supplier, LATERAL (SELECT unnest(range(0, s_nationkey)) AS k)")
def udtf_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The squares of the numbers below each supplier's nation, by a table function that gets the table in batches."""

    @F.arrow_udtf(returnType="s_suppkey long, k long, square long")
    class Squares:
        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            n = rows.column("s_nationkey").to_numpy()
            k = pa.array(np.concatenate([np.arange(x, dtype=np.int64) for x in n]))
            yield pa.table({"s_suppkey": pa.array(np.repeat(rows.column("s_suppkey").to_numpy(), n)), "k": k, "square": pc.multiply(k, k)})

    return Squares(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").asTable())


@query("SELECT p_brand, sum(p_size)::BIGINT AS sizes FROM part GROUP BY p_brand")
def udf_grouped_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    def total(key: tuple, group: pa.Table) -> pa.Table:
        return pa.table({"p_brand": [key[0].as_py()], "sizes": [pc.sum(group.column("p_size")).as_py()]})

    return table(spark, sf_dir, "part").select("p_brand", "p_size").groupBy("p_brand").applyInArrow(total, "p_brand string, sizes long")
