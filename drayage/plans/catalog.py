"""Queries on the catalog: statistics, search, intake, promotion, events."""

from __future__ import annotations

from pyspark.sql import functions as F

from drayage.operators.bills import BILLS_SQL, bills, table
from drayage.sources.inbox import first_arrivals


def document_stats(spark, d):
    o = table(spark, d, "orders")
    is_ = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return o.agg(F.count("*").alias("total"), is_("F").alias("completed"), is_("O").alias("review"), is_("P").alias("pending"))


def list_search_page(spark, d):
    """Search in name, carrier and number; newest first; the second page of 100."""
    b = bills(spark, d)
    hit = F.col("consignee").ilike("%00%") | F.col("carrier").ilike("%build%") | F.col("bill_number").ilike("%77%")
    return b.where(hit).select("doc_id", "bill_number", "bill_date", "consignee").orderBy(F.desc("bill_date"), F.desc("doc_id")).offset(100).limit(100)


def ingest_dedupe(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"))
    return first_arrivals(rows, order="doc_id").select("doc_id", "file_hash", "duplicate")


def status_promote(spark, d):
    b = bills(spark, d)
    was = F.when(F.col("total") > 100_000, "REVIEW").otherwise("COMPLETED")
    return b.select("doc_id", was.alias("was"), F.when((was == "REVIEW") & F.col("reviewed"), "COMPLETED").otherwise(was).alias("status"))


def event_props(spark, d):
    """Free-form JSON by path, counted by type."""
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.try_parse_json("props").isNotNull()).alias("parsed"), F.countDistinct("user_id").alias("users"))


def ingest_summary(spark, d):
    r = ingest_dedupe(spark, d)
    return r.agg(F.count("*").alias("seen"), F.count_if(~F.col("duplicate")).alias("ingested"), F.count_if("duplicate").alias("duplicates"))


def neighbours(spark, d):
    """The bill before and after each in the list, by date and id."""
    from pyspark.sql import Window

    # neighbours within a carrier: one list each
    w = Window.partitionBy("carrier").orderBy(F.desc("bill_date"), F.desc("doc_id"))
    return bills(spark, d).select("doc_id", F.lag("doc_id").over(w).alias("previous"), F.lead("doc_id").over(w).alias("following"))


QUERIES = {f.__name__: f for f in (document_stats, list_search_page, ingest_dedupe, ingest_summary, status_promote, event_props, neighbours)}
_FIRST = "SELECT doc_id, sha256(text) AS file_hash, row_number() OVER (PARTITION BY sha256(text) ORDER BY lower(CAST(doc_id AS VARCHAR)), doc_id) > 1 AS duplicate FROM documents"
ORACLES = {
    "document_stats": "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'O') AS review, count(*) FILTER (o_orderstatus = 'P') AS pending FROM orders",
    "list_search_page": f"WITH {BILLS_SQL} SELECT doc_id, bill_number, bill_date, consignee FROM bills WHERE consignee ILIKE '%00%' OR carrier ILIKE '%build%' OR bill_number ILIKE '%77%' ORDER BY bill_date DESC, doc_id DESC LIMIT 100 OFFSET 100",
    "ingest_dedupe": _FIRST,
    "ingest_summary": f"SELECT count(*) AS seen, count(*) FILTER (NOT duplicate) AS ingested, count(*) FILTER (duplicate) AS duplicates FROM ({_FIRST})",
    "status_promote": f"WITH {BILLS_SQL} SELECT doc_id, CASE WHEN total > 100000 THEN 'REVIEW' ELSE 'COMPLETED' END AS was, CASE WHEN total > 100000 AND NOT reviewed THEN 'REVIEW' ELSE 'COMPLETED' END AS status FROM bills",
    "event_props": "SELECT event_type, count(*) AS n, count(*) FILTER (json_valid(props)) AS parsed, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "neighbours": f"WITH {BILLS_SQL} SELECT doc_id, lag(doc_id) OVER w AS previous, lead(doc_id) OVER w AS following FROM bills WINDOW w AS (PARTITION BY carrier ORDER BY bill_date DESC, doc_id DESC)",
}
