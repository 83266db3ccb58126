"""The catalogue that ranking queries run on, from the bundled tables: parts as records, line items as their usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.ranking import Criterion, Signals


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model_id, author, task, features, tags, likes, downloads, last_modified. Usage is summed before it is joined."""
    use = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("likes"), F.sum("l_quantity").cast("long").alias("downloads"), F.max("l_shipdate").alias("last_modified"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("model_id"), F.col("p_brand").alias("author"), F.col("p_type").alias("task"), F.split("p_name", " ").alias("features"), F.array("p_type", "p_brand").alias("tags"), "p_size", "p_retailprice")
    return part.join(use, F.col("model_id") == F.col("l_partkey"), "left").drop("l_partkey").fillna(0, ["likes", "downloads"])


#: The same in SQL.
CATALOGUE = """catalogue AS (
    SELECT p_partkey AS model_id, p_brand AS author, p_type AS task, string_split(p_name, ' ') AS features, [p_type, p_brand] AS tags,
           p_size, p_retailprice, coalesce(likes, 0) AS likes, coalesce(downloads, 0) AS downloads, last_modified
    FROM part LEFT JOIN (SELECT l_partkey, count(*) AS likes, CAST(sum(l_quantity) AS BIGINT) AS downloads, max(l_shipdate) AS last_modified
                         FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey)"""

CRITERIA = [
    Criterion("economy", ("task",), (("ECONOMY", 1.0), ("PROMO", 0.85)), 2.0, "must"),
    Criterion("small", ("features",), (("small", 1.0), ("tiny", 0.8)), 1.0, "strong_prefer"),
    Criterion("ring", ("features",), (("ring", 1.0), ("widget", 0.64)), 1.5, "prefer"),
    Criterion("brand", ("author", "tags"), (("Brand#2", 1.0), ("Brand#4", 0.9)), 1.0, "prefer"),
]
SIGNALS = Signals({"likes": 0.5, "downloads": 0.25}, 1.5)
