"""The stand-ins that the test tables offer: points, features, lines, rasters, tile trees, archive members."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The only key of lineitem that tells all its rows apart.
LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points from the first three coordinates of the embeddings."""
    e = table(spark, sf_dir, "embeddings")
    axes = [F.get("embedding", F.lit(k)).cast("double").alias(a) for k, a in enumerate("xyz")]
    return e.select(F.col("vec_id").alias("ordinal"), *axes, F.col("label").cast("long").alias("label"))


CLOUD = "pts AS (SELECT vec_id AS ordinal, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label::BIGINT AS label FROM embeddings)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points from quantity, price and discount of the line items."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(*LINE_KEY, F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("z"))


LINES = "pts AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity AS x, l_extendedprice AS y, l_discount AS z FROM lineitem)"


def coincident(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(*LINE_KEY, F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"), "l_orderkey")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers as point features of two layers."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    c = c.select(F.lit("customer").alias("layer"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"), (F.col("c_custkey") % 97).cast("double").alias("z"), F.col("c_mktsegment").alias("segment"))
    s = s.select(F.lit("supplier").alias("layer"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"), (F.col("s_suppkey") % 97).cast("double").alias("z"))
    return c.unionByName(s, allowMissingColumns=True)


FEATURES = """feats AS (SELECT 'customer' AS layer, c_custkey AS id, c_acctbal AS x, c_nationkey::DOUBLE AS y, (c_custkey % 97)::DOUBLE AS z, c_mktsegment AS segment FROM customer
 UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, s_nationkey::DOUBLE, (s_suppkey % 97)::DOUBLE, NULL FROM supplier)"""


def raster(spark: SparkSession, sf_dir: str, width: int = 50) -> DataFrame:
    """Parts as samples of a lattice; size 1 stands for no data."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return p.select(F.floor(key / width).cast("long").alias("row"), (key % width).cast("long").alias("col"), F.col("p_retailprice").cast("double").alias("value"), (F.col("p_size") != 1).alias("valid"))


RASTER = "cells AS (SELECT p_partkey // 50 AS row, p_partkey % 50 AS col, p_retailprice::DOUBLE AS value, p_size <> 1 AS valid FROM part)"
