"""Similarity of vectors by a join. The nearest rows are found in vector_index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..tables import table

_DOT = "list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"


@query(f"SELECT q.vec_id AS query_id, v.vec_id AS id, round({_DOT}, 6) AS similarity FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id != v.vec_id WHERE q.vec_id % 100 = 0")
def vec_pair_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of every row whose id is divisible by 100 with the rows of its label; the queries are the small side."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"), F.col("label").alias("q_label"))
    met = e.join(asked, (F.col("label") == F.col("q_label")) & (F.col("vec_id") != F.col("query_id")))
    dot = F.aggregate(F.zip_with("asked", "embedding", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda acc, x: acc + x)
    return met.select("query_id", F.col("vec_id").alias("id"), F.round(dot, 6).alias("similarity"))
