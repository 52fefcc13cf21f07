"""Queries that render bills as text, read them back and put values in form."""

from __future__ import annotations

from pyspark.sql import functions as F

from drayage.functions import exprs as X
from drayage.functions import shapes as S
from drayage.operators.bills import BILLS_SQL, bills, long, table


def _text(b):
    line = lambda label, c: F.concat(F.lit(f"{label}: "), c.cast("string"))
    return F.concat_ws("\n", line("Bill No", F.col("bill_number")), line("Date", F.date_format(F.to_date("bill_date"), "MM/dd/yyyy")), line("Consignor", F.col("consignor")), line("Consignee", F.col("consignee")), line("Total", F.format_number("total", 2)), line("Weight", F.col("weight").cast("long")))


def extract_labels(spark, d):
    """Labelled lines read back from the text of a bill."""
    b = bills(spark, d).withColumn("raw_text", _text(None))
    get = lambda label: F.nullif(F.regexp_extract("raw_text", rf"(?im)^{label}\s*:\s*(.+)$", 1), F.lit(""))
    return b.select("doc_id", get("Bill No").alias("bill_number"), S.clean_date(get("Date")).alias("bill_date"), get("Consignor").alias("consignor"), get("Consignee").alias("consignee"), S.clean_money(get("Total")).alias("total"), S.clean_weight(get("Weight")).alias("weight"))


def normalize_money(spark, d):
    return bills(spark, d).select("doc_id", S.clean_money(F.format_number("total", 2)).alias("total_text"), S.signed(F.concat(F.lit("("), F.format_number("total", 2), F.lit(")"))).alias("negative"))


def collapse_key(spark, d):
    return bills(spark, d).select(X.collapse(F.col("consignee")).alias("entity_key"), X.party_key(F.concat("consignor", F.lit(" & Co"))).alias("party_key")).groupBy("entity_key", "party_key").agg(F.count("*").alias("n"))


def normalize_clock(spark, d):
    e = table(spark, d, "events").select("event_id", F.date_format("ts", "Hmm").alias("compact"))
    return e.select("event_id", S.clean_clock(F.col("compact")).alias("clock"))


def location_spacing(spark, d):
    return bills(spark, d).select("doc_id", S.clean_place(F.concat("carrier", F.lit(","), F.substring("destination", 1, 2))).alias("place"))


def identifiers(spark, d):
    return bills(spark, d).select("doc_id", S.clean_identifier(F.concat(F.lit("Bill No: "), F.translate("bill_number", "0123456789", X.INDIC_DIGITS))).alias("bill_number"))


def field_confidence(spark, d):
    """Heuristic confidence by field, and a bill's mean of what is positive."""
    f = long(bills(spark, d))
    conf = F.when(X.is_missing(F.col("value")) | X.letters_only_stub(F.col("value")), 0.0).otherwise(0.85)
    return f.withColumn("conf", conf).groupBy("doc_id").agg(F.round(F.avg(F.when(F.col("conf") > 0, F.col("conf"))), 2).alias("overall"), F.count_if(F.col("conf") > 0).alias("present"))


QUERIES = {f.__name__: f for f in (extract_labels, normalize_money, collapse_key, normalize_clock, location_spacing, identifiers, field_confidence)}
ORACLES = {
    "extract_labels": f"WITH {BILLS_SQL} SELECT doc_id, bill_number, bill_date, consignor, consignee, format('${{:,.2f}}', total) AS total, CAST(CAST(weight AS BIGINT) AS VARCHAR) AS weight FROM bills",
    "normalize_money": f"WITH {BILLS_SQL} SELECT doc_id, format('${{:,.2f}}', total) AS total_text, -CAST(replace(format('{{:,.2f}}', total), ',', '') AS DOUBLE) AS negative FROM bills",
    "collapse_key": f"WITH {BILLS_SQL} SELECT regexp_replace(lower(consignee), '[^a-z0-9&]+', '', 'g') AS entity_key, regexp_replace(lower(consignor || ' & Co'), '[^a-z0-9]+', '', 'g') AS party_key, count(*) AS n FROM bills GROUP BY 1, 2",
    "normalize_clock": "SELECT event_id, CASE WHEN hour(ts) + minute(ts) > 0 AND (hour(ts) > 0 OR TRUE) THEN hour(ts) || ':' || lpad(CAST(minute(ts) AS VARCHAR), 2, '0') END AS clock FROM events",
    "location_spacing": f"WITH {BILLS_SQL} SELECT doc_id, carrier || ', ' || substr(destination, 1, 2) AS place FROM bills",
    "identifiers": f"WITH {BILLS_SQL} SELECT doc_id, bill_number FROM bills",
    "field_confidence": f"""WITH {BILLS_SQL}, f AS (SELECT doc_id, unnest([carrier, consignor, consignee, driver_name, origin, destination]) AS value FROM bills),
c AS (SELECT doc_id, CASE WHEN value IS NULL OR lower(trim(value)) IN ('', 'none', 'null', 'n/a', 'unknown') OR length(regexp_replace(value, '[^A-Za-z]', '', 'g')) <= 3 THEN 0.0 ELSE 0.85 END AS conf FROM f)
SELECT doc_id, round(avg(CAST(conf AS DOUBLE)) FILTER (conf > 0), 2) AS overall, count(*) FILTER (conf > 0) AS present FROM c GROUP BY doc_id""",
}
