"""Rasters defined over ordinary tables, in Spark and as the same SQL, so that another engine can check every operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reflectance bands of lineitem rows; point-wise and global operators only, as rows have no pixel key."""
    blue = F.col("l_quantity") / 50
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", blue.alias("blue"), (F.col("l_extendedprice") / 105000).alias("green"), (F.col("l_tax") / 0.08).alias("red"),
        (F.col("l_discount") / 0.1).alias("nir"), (blue * (1 - F.col("l_discount"))).alias("swir"),
    )


LI = """(SELECT l_orderkey, l_linenumber, l_quantity / 50 AS blue, l_extendedprice / 105000 AS green, l_tax / 0.08::DOUBLE AS red,
 l_discount / 0.1::DOUBLE AS nir, (l_quantity / 50) * (1 - l_discount) AS swir FROM lineitem)"""


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense raster: row = vec_id, col = place in the vector."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "v")).withColumn("v", F.col("v").cast("double"))


EMB = """(SELECT vec_id::INT AS "row", unnest(range(0, len(embedding)))::INT AS "col", unnest(embedding)::DOUBLE AS v FROM embeddings)"""

TYPES = ("t0", "t1")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse raster: row = day, col = hour, v = mean value; hours without events are missing."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("row"), F.hour("ts").alias("col"))
        .agg(F.avg("value").alias("v"))
    )


EV = """(SELECT date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS "row", hour(ts)::INT AS "col", avg(value) AS v FROM events GROUP BY 1, 2)"""


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two bands of two images."""
    price, qty, keep = F.col("l_extendedprice"), F.col("l_quantity"), 1 - F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select(F.array(price, qty).alias("ref"), F.array(price * keep * (1 + F.col("l_tax")), qty * keep).alias("mov"))


PAIR = """(SELECT l_extendedprice AS r1, l_quantity AS r2, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS m1, l_quantity * (1 - l_discount) AS m2 FROM lineitem)"""
