"""Readers of the shared tables and views that several queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) for every line item: the supplier's and the customer's nation."""
    lines, orders, customers, suppliers = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "supplier"))
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst"))
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digraph of nations: from each supplier nation to the two customer nations with the most line items."""
    n = trade(spark, sf_dir).groupBy("src", "dst").agg(F.count("*").alias("n"))
    return n.withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))).where("k <= 2").select("src", "dst")


EDGES_SQL = """
f AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
r AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS k FROM f),
edges AS (SELECT src, dst FROM r WHERE k <= 2)"""
