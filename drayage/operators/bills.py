"""Freight bills as the tables at hand give them, wide and long."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ["carrier", "consignor", "consignee", "driver_name", "origin", "destination"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def bills(spark: SparkSession, d: str) -> DataFrame:
    """One row per order that has lines: parties, route, amounts, review state."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("suppkey"), F.sum("l_quantity").alias("weight"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("line_sum"), F.count("*").alias("n_lines"))
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    supplier = table(spark, d, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("s_name").alias("consignor"), F.col("n_name").alias("origin"))
    customer = table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("c_name").alias("consignee"), F.col("c_mktsegment").alias("carrier"), F.col("n_name").alias("destination"))
    orders = table(spark, d, "orders")
    b = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(supplier, F.col("suppkey") == F.col("s_suppkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return b.select(
        F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("FB-"), F.col("o_orderkey").cast("string")).alias("bill_number"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("bill_date"),
        "consignor", "consignee", "origin", "destination", "carrier", F.col("o_orderpriority").alias("driver_name"), F.col("o_totalprice").alias("total"), "weight", "line_sum", "n_lines", (F.col("o_orderstatus") == "F").alias("reviewed"),
    )


#: The same in SQL.
BILLS_SQL = """
l AS (SELECT l_orderkey, min(l_suppkey) AS suppkey, sum(l_quantity) AS weight, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS line_sum, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey),
bills AS (
  SELECT o_orderkey AS doc_id, 'FB-' || o_orderkey AS bill_number, strftime(o_orderdate, '%Y-%m-%d') AS bill_date,
    s_name AS consignor, c_name AS consignee, sn.n_name AS origin, cn.n_name AS destination, c_mktsegment AS carrier,
    o_orderpriority AS driver_name, o_totalprice AS total, weight, line_sum, n_lines, o_orderstatus = 'F' AS reviewed
  FROM orders JOIN l ON o_orderkey = l_orderkey JOIN supplier ON suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey
  JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey)"""


def long(b: DataFrame) -> DataFrame:
    """(doc_id, field, value) of the party and route fields."""
    return b.unpivot("doc_id", FIELDS, "field", "value")
