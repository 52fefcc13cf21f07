"""Queries on the texts of tickets, and on what speaks against a bill."""

from __future__ import annotations

from pyspark.sql import functions as F

from drayage.functions import seeds
from drayage.functions import shapes as S
from drayage.operators import checks as C
from drayage.operators import extract as X
from drayage.operators import matching as M
from drayage.operators.bills import BILLS_SQL, bills, table
from drayage.plans import sqltext as Q
from drayage.plans.values import _CITIES, _PLACES, _copied

#: A ticket's text, in the same words for both engines.
_TEXT = """concat_ws(chr(10), CASE doc_id % 4 WHEN 0 THEN 'CALIFORNIA MATERIALS, INC.' WHEN 1 THEN concat(carrier, ' Haulers LLC') WHEN 2 THEN 'INC' ELSE 'NO ADDRESS' END,
  'TRUCK NO.', CASE doc_id % 5 WHEN 0 THEN 'MILES' WHEN 1 THEN '8212345' WHEN 2 THEN 'CMAT' ELSE 'unit 12 west' END, '197A', 'POINT OF ORIGIN POINT OF DESTINATION', 'YR. 26', origin, destination, CASE WHEN doc_id % 3 = 0 THEN 'Tract 5' END, 'COMMODITY',
  CASE doc_id % 6 WHEN 0 THEN '1 x 4 rock' WHEN 1 THEN 'ImPor+Fill' WHEN 2 THEN 'Dirt' WHEN 3 THEN 'x 4rck684755' WHEN 4 THEN 'Load: gravel' ELSE 'import' END,
  concat(CAST(684000 + doc_id % 1000 AS STRING), ' 12.85 930 1020 1025 1030'), CASE WHEN doc_id % 2 = 0 THEN '5512 24.10 7:15 8:05 905 1010' END, CASE WHEN doc_id % 7 = 0 THEN '8:00 9:00 0:10' END,
  CASE WHEN doc_id % 8 <> 0 THEN 'SIGNATURE' END, CASE doc_id % 3 WHEN 0 THEN 'Mike Gordon' WHEN 1 THEN concat('Samuel ', substr(carrier, 1, 1)) ELSE 'CONSIGNEE 4455' END)"""


def _texts(spark, d):
    return bills(spark, d).select("doc_id", F.expr(_TEXT).alias("text"))


def ticket_text(spark, d):
    """Carrier, route, commodity, truck and driver that the lines of a ticket give."""
    t = F.col("text")
    made = _texts(spark, d).select("doc_id", X.letterhead_carrier(t).alias("carrier"), X.route(t).alias("route"), X.aggregate_commodity(t).alias("load"), X.table_commodity(t).alias("product"), X.truck_number(t).alias("truck"), X.signature_driver(t).alias("driver"))
    return made.select("doc_id", "carrier", "route.origin", "route.destination", "load.quantity", "load.commodity", "product", "truck", "driver")


def load_rows(spark, d):
    """Every load that a ticket lists."""
    return _texts(spark, d).select("doc_id", F.explode(X.load_rows(F.col("text"))).alias("r")).select("doc_id", "r.*")


def load_summary(spark, d):
    """What a ticket's loads say together."""
    return _texts(spark, d).select("doc_id", X.load_summary(X.load_rows(F.col("text"))).alias("s")).select("doc_id", "s.*")


_RAW = """SELECT doc_id, concat('Bill No: ', bill_number) AS bill_number, CASE WHEN doc_id % 3 = 0 THEN concat(substr(bill_date, 6, 2), '/', substr(bill_date, 9, 2), '/', substr(bill_date, 1, 4)) ELSE bill_date END AS bill_date,
  CASE WHEN doc_id % 11 = 0 THEN 'SUB-HAUL#' ELSE consignor END AS consignor, CASE WHEN doc_id % 13 = 0 THEN consignor ELSE consignee END AS consignee, CASE WHEN doc_id % 7 = 0 THEN concat('ADDRESS: ', origin) ELSE origin END AS origin, destination, carrier, driver_name, 'x' AS invoice_number,
  CASE WHEN doc_id % 5 = 0 THEN 'n/a' WHEN doc_id % 9 = 0 THEN concat('$', CAST(CAST(floor(total * 1.1) AS BIGINT) AS STRING)) ELSE concat('USD ', CAST(CAST(floor(total * 0.9) AS BIGINT) AS STRING)) END AS freight_amount, CAST(CAST(floor(total) AS BIGINT) AS STRING) AS total_amount,
  concat(CAST(CAST(weight AS BIGINT) AS STRING), ' Ibs') AS weight, concat('Vehicle #: UP-', CAST(doc_id % 100 AS STRING)) AS vehicle_number, CASE WHEN doc_id % 4 = 0 THEN floor(total) ELSE line_sum END AS line_sum, reviewed FROM bills"""
_SHOWN = ["bill_number", "bill_date", "consignor", "consignee", "origin", "destination", "carrier", "driver_name", "invoice_number", "freight_amount", "total_amount", "weight", "vehicle_number"]


def _normalized(spark, d):
    bills(spark, d).createOrReplaceTempView("__bills")
    raw = spark.sql(_RAW.replace("FROM bills", "FROM __bills"))
    return C.validate(C.confidences(C.normalize(raw), _SHOWN))


def normalize_bills(spark, d):
    """Bills with damage at known places, their fields in form."""
    return _normalized(spark, d).select("doc_id", *_SHOWN)


def validate_bills(spark, d):
    """Overall confidence, warnings and status of those bills."""
    return _normalized(spark, d).select("doc_id", "overall", F.array_join("warnings", "; ").alias("warnings"), "status")


_AT = " ".join(f"WHEN {i} THEN {Q.lit(p)}" for i, p in enumerate(_PLACES))
_GIVEN = f"""SELECT doc_id, bill_number, consignor, CASE WHEN doc_id % 17 = 0 THEN upper(consignor) ELSE concat('Receiver ', CAST(doc_id % 5 AS STRING)) END AS consignee, substr(bill_date, 1, 7) AS bill_date,
  CASE doc_id % 11 {_AT} END AS origin, CASE CAST(floor(doc_id / 11) AS BIGINT) % 11 {_AT} END AS destination, concat('$', CAST(CAST(floor(total * CASE WHEN doc_id % 9 = 0 THEN 1.25 ELSE 0.5 END) AS BIGINT) AS STRING)) AS freight_amount,
  CASE WHEN doc_id % 4 = 0 THEN CAST(CAST(floor(total) AS BIGINT) AS STRING) ELSE CAST(line_sum AS STRING) END AS total_amount, CASE WHEN doc_id % 13 = 0 THEN '-12.5' ELSE CAST(weight AS STRING) END AS weight, reviewed FROM bills"""
_ITEMS = """SELECT l_orderkey AS doc_id, concat(CASE WHEN l_orderkey % 19 = 0 THEN '-' ELSE '' END, CAST(l_quantity AS STRING)) AS quantity, CAST(floor(l_extendedprice * 100 / l_quantity + 0.5) / 100 AS STRING) AS rate, CAST(l_extendedprice AS STRING) AS amount,
  concat(CASE WHEN l_linenumber % 2 = 0 THEN 'a' ELSE 'A' END, CAST(l_partkey % 400 AS STRING)) AS tag FROM lineitem"""


def _checked(spark, d):
    bills(spark, d).createOrReplaceTempView("__bills")
    table(spark, d, "lineitem").createOrReplaceTempView("__lines")
    given = spark.sql(_GIVEN.replace("FROM bills", "FROM __bills"))
    items = spark.sql(_ITEMS.replace("FROM lineitem", "FROM __lines"))
    zips = spark.createDataFrame(seeds.ZIPS, "zip string, city string, state string")
    b = given.join(items.groupBy("doc_id").agg(F.collect_list(F.struct("quantity", "rate", "amount", "tag")).alias("line_items")), "doc_id", "left")
    for f in ("origin", "destination"):
        # a place's state is asked once for each place, not for each bill
        kinds = given.select(F.col(f).alias("id"), F.lit(f).alias("field"), F.col(f).alias("value")).distinct()
        b = b.join(M.state_of(kinds, zips).select(F.col("value").alias(f), F.col("state").alias(f"{f}_state")), f, "left")
    peers = C.peers(given.join(items, "doc_id").select("doc_id", "consignee", "bill_date", "tag"))
    return C.findings(b.join(peers, "doc_id", "left"))


def consistency(spark, d):
    """What speaks against each bill, by code."""
    f = _checked(spark, d).select("doc_id", F.explode("findings").alias("f"))
    return f.groupBy("doc_id", "f.code", "f.severity").agg(F.count("*").alias("n"), F.min(F.array_join("f.fields", "+")).alias("fields"))


def finding_counts(spark, d):
    """Bills and findings by code."""
    return consistency(spark, d).groupBy("code", "severity").agg(F.count("*").alias("bills"), F.sum("n").alias("findings"))


def peer_duplicate_tags(spark, d):
    """Another bill of the same receiver and month with one of a bill's tags; the least such bill."""
    return _checked(spark, d).where("peer IS NOT NULL").select("doc_id", "peer")


def review_routing(spark, d):
    """Bills by status and reason: validation first, then the findings that send a completed bill to review."""
    b = _checked(spark, d).withColumns({"overall": F.lit(0.9), "line_sum": F.aggregate(F.array_compact(F.transform("line_items", lambda i: S.amount(i["amount"]))), F.lit(0.0), lambda a, x: a + x)})
    b = C.validate(b)
    codes = F.array_distinct(F.transform(F.filter("findings", lambda f: f["code"].isin(C.REVIEW_CODES)), lambda f: f["code"]))
    b = b.withColumn("codes", codes).withColumn("status", F.when(F.size("codes") > 0, "REVIEW").otherwise(F.col("status")))
    return b.select("status", F.array_join("codes", ",").alias("reasons"), F.size("warnings").alias("warnings")).groupBy("status", "reasons", "warnings").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (ticket_text, load_rows, load_summary, normalize_bills, validate_bills, consistency, finding_counts, peer_duplicate_tags, review_routing)}

_LINES = f"""tx AS (SELECT doc_id, {_TEXT} AS text FROM bills), ln AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: {Q.strip('x')}), lambda x: x <> '') AS ls FROM tx)"""
_UP = "regexp_replace(upper(x), '[^A-Z]', '', 'g')"
_FILL = f"(regexp_matches(text, '{X.IMPORT_FILL}') OR (regexp_matches(text, '(?i)\\bt?mport\\b|\\bimport\\b') AND regexp_matches(text, '(?i)(^|\\n)\\s*fill\\s*(\\n|$)')))"
_LOADS = """sp AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS nr FROM ln), tk AS (SELECT doc_id, nr, string_split(x, ' ') AS ts FROM sp),
cl AS (SELECT *, list_filter(ts, lambda t: regexp_full_match(t, '\\d{1,2}:\\d{2}')) AS colon, list_filter(list_transform(list_filter(ts, lambda t: regexp_full_match(t, '\\d{3,4}')), lambda t: CASE WHEN CAST(left(t, length(t) - 2) AS INTEGER) <= 23 AND CAST(right(t, 2) AS INTEGER) <= 59 AND CAST(t AS INTEGER) > 0 THEN CAST(CAST(left(t, length(t) - 2) AS INTEGER) AS VARCHAR) || ':' || right(t, 2) END), lambda t: t IS NOT NULL) AS compact,
  list_filter(ts, lambda t: regexp_full_match(t, '\\d{1,3}\\.\\d{2}'))[1] AS weight, list_filter(ts, lambda t: regexp_full_match(t, '\\d{4,8}'))[1] AS tag FROM tk),
ck AS (SELECT *, CASE WHEN len(compact) >= 3 OR (len(colon) < 2 AND len(compact) >= 2) THEN list_concat(colon, compact) ELSE colon END AS c FROM cl),
lr AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY nr) AS VARCHAR) AS item_no, CASE WHEN length(tag) > 4 OR CAST(left(tag, length(tag) - 2) AS INTEGER) > 23 OR CAST(right(tag, 2) AS INTEGER) > 59 THEN tag END AS tag, weight, c[1] AS load_arrive, c[2] AS load_depart, c[3] AS unload_arrive, c[4] AS unload_depart
  FROM ck WHERE (weight IS NOT NULL AND len(c) >= 2) OR len(c) >= 3)"""
_EXPECTED = f"""rw AS ({_RAW}), nz AS (SELECT rw.doc_id, b.bill_number, b.bill_date, CASE WHEN rw.doc_id % 11 = 0 THEN NULL ELSE b.consignor END AS consignor, CASE WHEN rw.doc_id % 13 = 0 AND rw.doc_id % 11 <> 0 THEN NULL ELSE rw.consignee END AS consignee, b.origin, b.destination, b.carrier,
  CASE WHEN b.driver_name <> '5-LOW' THEN b.driver_name END AS driver_name, CAST(NULL AS VARCHAR) AS invoice_number, CASE WHEN rw.doc_id % 5 <> 0 THEN format('${{:,.2f}}', TRY_CAST(regexp_replace(rw.freight_amount, '[^0-9]', '', 'g') AS DOUBLE)) END AS freight_amount,
  format('${{:,.2f}}', CAST(rw.total_amount AS DOUBLE)) AS total_amount, CASE WHEN length(CAST(CAST(b.weight AS BIGINT) AS VARCHAR)) > 3 THEN substr(CAST(CAST(b.weight AS BIGINT) AS VARCHAR), 1, 3) ELSE CAST(CAST(b.weight AS BIGINT) AS VARCHAR) END || ' lbs' AS weight, 'UP-' || (rw.doc_id % 100) AS vehicle_number, rw.line_sum, rw.reviewed, TRY_CAST(regexp_replace(rw.freight_amount, '[^0-9]', '', 'g') AS DOUBLE) AS fr, CAST(rw.total_amount AS DOUBLE) AS tt
  FROM rw JOIN bills b ON rw.doc_id = b.doc_id),
cf AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {f} IS NULL THEN 0 WHEN reviewed THEN 100 ELSE {n} END" for f, n in (('bill_number', 95), ('bill_date', 96), ('consignor', 85), ('consignee', 85), ('origin', 85), ('destination', 85), ('carrier', 85), ('driver_name', 85), ('freight_amount', 94), ('total_amount', 94), ('weight', 88), ('vehicle_number', 95)))}], lambda x: x > 0) AS cs,
  list_filter([{', '.join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in S.CRITICAL)}], lambda x: x IS NOT NULL) AS missing FROM nz)"""
_STATE = f"""pl AS (SELECT DISTINCT unnest([{', '.join(map(Q.lit, _PLACES))}]) AS place), zs AS (SELECT * FROM {Q.values(seeds.ZIPS, 'zip, city, state')}), cs AS (SELECT * FROM {Q.values(_CITIES, 'k, czip, cstate')}),
st AS (SELECT place, coalesce(zs.state, CASE WHEN upper(regexp_extract(place, ',\\s*([A-Za-z]{{2}})\\b', 1)) IN ({', '.join(map(Q.lit, seeds.STATES))}) THEN upper(regexp_extract(place, ',\\s*([A-Za-z]{{2}})\\b', 1)) END, (SELECT min(cstate) FROM cs WHERE contains({Q.key('place')}, k))) AS state FROM pl LEFT JOIN zs ON zs.zip = regexp_extract(place, '\\b(\\d{{5}})(-\\d{{4}})?\\b', 1))"""
_FOUND = f"""gv AS ({_GIVEN}), it AS ({_ITEMS}), {_STATE}, nm AS (SELECT *, CAST(replace(freight_amount, '$', '') AS DOUBLE) AS fr, CAST(total_amount AS DOUBLE) AS tt FROM gv),
im AS (SELECT doc_id, sum(abs(CAST(amount AS DOUBLE))) AS total, count(*) FILTER (abs(CAST(quantity AS DOUBLE) * CAST(rate AS DOUBLE) - CAST(amount AS DOUBLE)) > 0.05) AS off, count(*) FILTER (CAST(quantity AS DOUBLE) < 0) AS below, count(*) - count(DISTINCT lower(tag)) AS twice FROM it GROUP BY doc_id),
pk AS (SELECT DISTINCT nm.doc_id, {Q.key('consignee')} AS k, bill_date, lower(tag) AS t FROM nm JOIN it ON nm.doc_id = it.doc_id), pr AS (SELECT a.doc_id, min(b.doc_id) AS peer FROM pk a JOIN pk b ON a.k = b.k AND a.bill_date = b.bill_date AND a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id),
fd AS (SELECT doc_id, 'CONSIGNOR_EQUALS_CONSIGNEE' AS code, 'error' AS severity, 1 AS n, 'consignor+consignee' AS fields FROM nm WHERE {Q.key('consignor')} = {Q.key('consignee')}
  UNION ALL SELECT doc_id, 'FREIGHT_EXCEEDS_TOTAL', 'error', 1, 'freight_amount+total_amount' FROM nm WHERE fr > tt
  UNION ALL SELECT doc_id, 'LINE_ITEM_QTY_RATE_AMOUNT_MISMATCH', 'warning', off, 'line_items' FROM im WHERE off > 0
  UNION ALL SELECT doc_id, 'LINE_ITEM_SUM_MISMATCH', 'error', 1, 'line_items+total_amount' FROM nm JOIN im USING (doc_id) WHERE abs(total - tt) > 0.05
  UNION ALL SELECT doc_id, 'NEGATIVE_VALUE', 'error', CAST(w + coalesce(below, 0) AS BIGINT), CASE WHEN below > 0 THEN 'line_items' ELSE 'weight' END FROM (SELECT doc_id, CASE WHEN weight = '-12.5' THEN 1 ELSE 0 END AS w FROM nm) JOIN im USING (doc_id) WHERE w + below > 0
  UNION ALL SELECT doc_id, 'ORIGIN_DESTINATION_STATE_MISMATCH', 'warning', 1, 'origin+destination' FROM nm JOIN st a ON a.place = origin JOIN st b ON b.place = destination WHERE a.state <> b.state
  UNION ALL SELECT doc_id, 'DESTINATION_COPIED_FROM_ORIGIN', 'error', 1, 'origin+destination' FROM nm WHERE {_copied('origin', 'destination')}
  UNION ALL SELECT doc_id, 'DUPLICATE_TAG', 'warning', 1, 'line_items' FROM im WHERE twice > 0
  UNION ALL SELECT doc_id, 'DUPLICATE_TAG_DATE', 'warning', 1, 'line_items+bill_date+consignee' FROM pr)"""
ORACLES = {
    "ticket_text": f"""WITH {BILLS_SQL}, {_LINES}, r1 AS (SELECT *, nullif(list_position(list_transform(ls, lambda x: regexp_matches({_UP}, 'POINTOFORIGIN|POINTOFDESTINATION')), true), 0) AS start FROM ln),
r2 AS (SELECT *, list_filter(ls[start + 1 : start + 13], lambda x: NOT {Q.is_header('x')} AND NOT regexp_matches(x, '(?i)^(YR|MO|DAY|DATE)[\\s.]*\\d*$') AND NOT regexp_matches(x, '(?i)^YR\\.?\\s*\\d+')) AS win FROM r1),
r3 AS (SELECT *, win[1 : least(coalesce(nullif(list_position(list_transform(win, lambda x: regexp_matches(x, '(?i)load|commodity|tag\\s*number|weight|unload') AND length(x) < 24), true), 0) - 1, 6), 6)] AS geo FROM r2),
r4 AS (SELECT *, geo[2:6] AS rest FROM r3), r5 AS (SELECT *, rest[1 : least(coalesce(nullif(list_position(list_transform(rest, lambda x: regexp_matches(x, '(?i)load|commodity|tag|weight|unload')), true), 0) - 1, 4), 4)] AS parts FROM r4)
SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {Q.strip('x')})[1:25], lambda x: length(x) >= 8 AND NOT {Q.is_header('x')} AND regexp_matches(x, '{X.COMPANY}') AND length({Q.letters('x')}) >= 8)[1] AS carrier, geo[1] AS origin, nullif(array_to_string(parts, ' '), '') AS destination,
  CASE doc_id % 6 WHEN 0 THEN '1' WHEN 3 THEN '1' END AS quantity, CASE doc_id % 6 WHEN 0 THEN '1 x 4 Rock' WHEN 3 THEN '1 x 4 ' || CASE WHEN regexp_matches('rck', '(?i)^[br]o?c?k') THEN 'Rock' ELSE 'Rck' END ELSE CASE WHEN {_FILL} THEN 'Import Fill' END END AS commodity,
  CASE WHEN {_FILL} THEN 'Import Fill' ELSE CASE doc_id % 6 WHEN 2 THEN 'Dirt' WHEN 4 THEN 'Gravel' END END AS product, CASE WHEN doc_id % 5 >= 3 THEN '12' ELSE '197A' END AS truck,
  (SELECT x FROM (SELECT unnest(ls) AS x, generate_subscripts(ls, 1) AS i) WHERE i >= CASE WHEN doc_id % 8 <> 0 THEN list_position(ls, 'SIGNATURE') ELSE greatest(len(ls) - 15, 1) END AND NOT {Q.is_header('x')} AND NOT regexp_matches(x, '\\d{{3,}}') AND NOT regexp_matches(x, '(?i)\\b(INC|LLC|CORP|LTD|MATERIALS|CONCRETE)\\b')
    AND regexp_matches(x, '^[A-Za-z][A-Za-z''`.-]{{1,24}}(\\s+[A-Za-z][A-Za-z''.]{{0,20}}){{1,2}}$') ORDER BY i LIMIT 1) AS driver FROM r5""",
    "load_rows": f"WITH {BILLS_SQL}, {_LINES}, {_LOADS} SELECT doc_id, item_no, tag, weight, load_arrive, load_depart, unload_arrive, unload_depart FROM lr",
    "load_summary": f"""WITH {BILLS_SQL}, {_LINES}, {_LOADS} SELECT doc_id, arg_min(load_arrive, item_no) AS pickup_time, arg_max(coalesce(unload_depart, load_depart, unload_arrive), item_no) AS delivery_time,
  CASE WHEN count(*) > 1 THEN CAST(count(*) AS VARCHAR) END AS quantity, CASE WHEN count(*) > 1 AND count(weight) > 0 THEN CAST(sum(CAST(weight AS DECIMAL(18,2))) AS VARCHAR) END AS weight FROM lr GROUP BY doc_id""",
    "normalize_bills": f"WITH {BILLS_SQL}, {_EXPECTED} SELECT doc_id, {', '.join(_SHOWN)} FROM nz",
    "validate_bills": f"""WITH {BILLS_SQL}, {_EXPECTED}, wn AS (SELECT *, floor((2 * list_sum(cs) + len(cs)) / (2 * len(cs))) / 100 AS mean, list_filter([CASE WHEN len(missing) > 0 THEN 'Missing critical field(s): ' || array_to_string(missing, ', ') END,
  CASE WHEN freight_amount IS NOT NULL AND fr > tt THEN format('Freight amount (${{:,.2f}}) exceeds Total amount (${{:,.2f}})', fr, tt) END, CASE WHEN abs(line_sum - tt) > 0.05 THEN format('Line item sum (${{:,.2f}}) mismatches total amount (${{:,.2f}})', line_sum, tt) END], lambda x: x IS NOT NULL) AS ws,
  reviewed AND len(list_filter(missing, lambda x: x NOT IN ('freight_amount', 'total_amount'))) = 0 AS done FROM cf)
SELECT doc_id, CASE WHEN done THEN greatest(mean, 0.95) ELSE mean END AS overall, array_to_string(ws, '; ') AS warnings, CASE WHEN done OR len(ws) = 0 THEN 'COMPLETED' ELSE 'REVIEW' END AS status FROM wn""",
    "consistency": f"WITH {BILLS_SQL}, {_FOUND} SELECT doc_id, code, severity, CAST(n AS BIGINT) AS n, fields FROM fd",
    "finding_counts": f"WITH {BILLS_SQL}, {_FOUND} SELECT code, severity, count(*) AS bills, CAST(sum(n) AS BIGINT) AS findings FROM fd GROUP BY 1, 2",
    "peer_duplicate_tags": f"WITH {BILLS_SQL}, {_FOUND} SELECT doc_id, peer FROM pr",
    "review_routing": f"""WITH {BILLS_SQL}, {_FOUND}, byd AS (SELECT doc_id, coalesce(string_agg(code, ',' ORDER BY CASE code WHEN 'CONSIGNOR_EQUALS_CONSIGNEE' THEN 1 WHEN 'NEGATIVE_VALUE' THEN 2 ELSE 3 END) FILTER (code IN ('CONSIGNOR_EQUALS_CONSIGNEE', 'NEGATIVE_VALUE', 'DESTINATION_COPIED_FROM_ORIGIN')), '') AS reasons,
  count(*) FILTER (code IN ('FREIGHT_EXCEEDS_TOTAL', 'LINE_ITEM_SUM_MISMATCH')) AS warnings FROM fd GROUP BY doc_id), al AS (SELECT reviewed, coalesce(reasons, '') AS reasons, CAST(coalesce(warnings, 0) AS INTEGER) AS warnings FROM gv LEFT JOIN byd ON gv.doc_id = byd.doc_id)
SELECT CASE WHEN reasons <> '' OR (warnings > 0 AND NOT reviewed) THEN 'REVIEW' ELSE 'COMPLETED' END AS status, reasons, warnings, count(*) AS n FROM al GROUP BY 1, 2, 3""",
}
