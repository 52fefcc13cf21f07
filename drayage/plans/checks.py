"""Queries that check line items, and order what is to be asked again."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from drayage.operators.bills import BILLS_SQL, bills, table

TOLERANCE = 0.05


def line_item_arithmetic(spark, d):
    """Items whose quantity times rate is off their amount, by bill."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    off = F.abs(F.col("l_quantity") * F.col("p_retailprice") - F.col("l_extendedprice")) > TOLERANCE
    return li.groupBy("l_orderkey").agg(F.count("*").alias("items"), F.count_if(off).alias("off"))


def duplicate_tags(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_orderkey", F.col("l_partkey").alias("tag")).agg(F.count("*").alias("times")).where("times > 1")


def rescue_priority(spark, d):
    """Up to eight fields of a bill that are to be asked for again: missing first, then what fails checks."""
    b = bills(spark, d)
    w = Window.partitionBy("doc_id").orderBy(F.desc("priority"), "ord")
    ask = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(f).alias("field"), p.cast("int").alias("priority")) for i, (f, p) in enumerate([
        ("total", F.when(F.col("line_sum") > F.col("total"), 4).otherwise(0)), ("weight", F.when(F.col("weight") > 150, 4).otherwise(0)),
        ("destination", F.when(F.col("origin") == F.col("destination"), 8).otherwise(0)), ("carrier", F.when(F.length("carrier") > 9, 2).otherwise(0)),
    ])])
    x = b.select("doc_id", F.explode(F.filter(ask, lambda s: s["priority"] > 0)).alias("s")).select("doc_id", "s.*")
    return x.withColumn("rank", F.row_number().over(w)).where("rank <= 8").select("doc_id", "field", "priority", "rank")


def layout_histogram(spark, d):
    """Strong cells of an eight by sixteen grid, from line places."""
    li = table(spark, d, "lineitem").select("l_orderkey", F.floor((F.col("l_quantity") - 1) / 50 * 8).cast("int").alias("col"), F.floor(F.col("l_discount") * 100 + 0.5).cast("int").alias("row"))
    return li.groupBy("col", "row").agg(F.count("*").alias("items")).where("items >= 3")


QUERIES = {f.__name__: f for f in (line_item_arithmetic, duplicate_tags, rescue_priority, layout_histogram)}
ORACLES = {
    "line_item_arithmetic": "SELECT l_orderkey, count(*) AS items, count(*) FILTER (abs(l_quantity * p_retailprice - l_extendedprice) > 0.05) AS off FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey",
    "duplicate_tags": "SELECT l_orderkey, l_partkey AS tag, count(*) AS times FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "rescue_priority": f"""WITH {BILLS_SQL}, s AS (
  SELECT doc_id, 0 AS ord, 'total' AS field, CASE WHEN line_sum > total THEN 4 ELSE 0 END AS priority FROM bills UNION ALL
  SELECT doc_id, 1, 'weight', CASE WHEN weight > 150 THEN 4 ELSE 0 END FROM bills UNION ALL
  SELECT doc_id, 2, 'destination', CASE WHEN origin = destination THEN 8 ELSE 0 END FROM bills UNION ALL
  SELECT doc_id, 3, 'carrier', CASE WHEN length(carrier) > 9 THEN 2 ELSE 0 END FROM bills)
SELECT doc_id, field, CAST(priority AS INTEGER) AS priority, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY priority DESC, ord) AS INTEGER) AS rank FROM s WHERE priority > 0 QUALIFY rank <= 8""",
    "layout_histogram": "SELECT CAST(floor((l_quantity - 1) / 50 * 8) AS INTEGER) AS col, CAST(floor(l_discount * 100 + 0.5) AS INTEGER) AS row, count(*) AS items FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 3",
}
