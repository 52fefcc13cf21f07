"""Queries that decide by history, labels and layout, and that learn from reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from drayage.functions import seeds
from drayage.operators import decisions as D
from drayage.operators import layout as L
from drayage.operators import priors, rescue
from drayage.operators.bills import BILLS_SQL, FIELDS, bills, long, table
from drayage.plans import sqltext as Q

_ALL = [*priors.PAIRS, *priors.TRIPLES, *priors.FULL]


def _edges(spark, d):
    return priors.edges(bills(spark, d).where("reviewed"), _ALL)


def historical_conflict(spark, d):
    """Values that strong history speaks against, of bills with another carrier, or another destination, at known places."""
    b = bills(spark, d).withColumns({"carrier": F.expr("CASE WHEN doc_id % 6 = 0 THEN 'Zed Lines' ELSE carrier END"), "consignee": F.expr("CASE WHEN doc_id % 10 = 0 THEN '' ELSE consignee END")})
    return D.historical_conflicts(b, _edges(spark, d)).select("doc_id", "field", "relation", "value", "usual", "usual_count", "usual_prob")


_LOST = "CASE WHEN doc_id % 4 = {} THEN NULL ELSE {} END"


def peaked_fill(spark, d):
    """The one party that a bill lacks, where history is sure of it."""
    b = bills(spark, d).withColumns({"carrier": F.expr(_LOST.format(0, "carrier")), "driver_name": F.expr(_LOST.format(1, "driver_name")), "consignee": F.expr(_LOST.format(2, "consignee"))})
    return D.peaked_fill(b, _edges(spark, d))


def likely_entities(spark, d):
    """What history finds likely for a bill of which some parties are known: how many of each, and the first."""
    b = bills(spark, d).withColumns({"consignee": F.expr(_LOST.format(2, "consignee")), "consignor": F.expr(_LOST.format(3, "consignor"))})
    e = D.likely_entities(b, _edges(spark, d))
    return e.select("doc_id", *[c for k in ("carriers", "consignees", "drivers", "destinations") for c in (F.coalesce(F.col(k)["n"], F.lit(0)).alias(f"n_{k}"), F.col(k)["value"].alias(f"first_{k}"))])


def label_outcomes(spark, d):
    """What reviews say of predictions, by field."""
    f = long(bills(spark, d)).withColumn("pred", F.expr("CASE WHEN doc_id % 7 = 0 THEN 'n/a' WHEN doc_id % 5 = 0 THEN concat(value, 'x') WHEN doc_id % 3 = 0 THEN upper(value) ELSE value END")).withColumn("gold", F.expr("CASE WHEN doc_id % 11 = 0 THEN '' ELSE value END"))
    return f.groupBy("field", D.label_outcome(F.col("pred"), F.col("gold")).alias("label")).agg(F.count("*").alias("n"))


def _examples(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").select(F.col("doc_id").alias("document_id"), F.col("lang").alias("field"), F.col("quality").cast("int").alias("label")).where("field IS NOT NULL")


def calibration_gate(spark, d):
    """What remains to learn from for each document, without its own labels, and whether that is enough."""
    return D.balance(_examples(spark, d))


def review_labels(spark, d):
    """Labels after a second review of some documents, counted."""
    store = _examples(spark, d).withColumn("raw_confidence", F.lit(0.5)).select("document_id", "field", "raw_confidence", "label")
    again = store.where("document_id % 3 = 0").select("document_id", "field", F.lit("A & B").alias("predicted"), F.expr("CASE WHEN document_id % 2 = 0 THEN 'a&b' ELSE 'c' END").alias("gold"), F.expr("CASE WHEN document_id % 9 = 0 THEN NULL ELSE 1.25D END").alias("confidence"))
    return D.record_labels(store, again).groupBy("field", "raw_confidence", "label").agg(F.count("*").alias("n"))


_POINTS = [("carrier", 0.2, 0.1), ("carrier", 0.5, 0.4), ("carrier", 0.9, 0.95), ("origin", 0.3, 0.25), ("origin", 0.8, 0.75)]


def calibration_status(spark, d):
    """Calibrated confidence, threshold and warning of each field of each bill."""
    f = long(bills(spark, d)).where("field IN ('carrier', 'origin', 'driver_name')").withColumn("raw", F.expr("(doc_id % 101) / 100.0D")).withColumn("value", F.expr("CASE WHEN doc_id % 12 = 0 THEN 'unknown' ELSE value END"))
    f = D.interpolate(f, spark.createDataFrame(_POINTS, "field string, anchor double, value double")).withColumn("reviewed", F.col("doc_id") % 7 == 0)
    f = f.withColumn("calibrated", F.floor(F.col("calibrated") * 1_000_000 + 0.5) / 1_000_000)
    return D.calibration_status(f).withColumn("confidence", F.floor(F.col("confidence") * 10_000 + 0.5) / 10_000)


_PAGE = """concat_ws(' ', CASE doc_id % 5 WHEN 0 THEN 'FREIGHT BILL shipper carrier' WHEN 1 THEN 'Invoice Number 7 subtotal amount due' WHEN 2 THEN 'qty description rate' ELSE '' END, CASE WHEN doc_id % 2 = 0 THEN 'Consignor and Consignee' END, CASE WHEN doc_id % 3 = 0 THEN 'Origin  Destination' END,
  CASE WHEN doc_id % 7 < 4 THEN repeat('printed words of a form ', 12) END, CASE WHEN doc_id % 11 = 0 THEN 'Ticket No 5' END)"""


def layout_class(spark, d):
    """Layout classes of pages with generated texts and boxes."""
    b = bills(spark, d)
    pages = b.select(F.col("doc_id").alias("id"), F.expr(_PAGE).alias("text"), F.expr("CASE WHEN doc_id % 13 = 0 THEN 2 ELSE 1 END").alias("pages"), F.expr("CASE WHEN doc_id % 3 = 1 THEN 'preprocessed_image' ELSE 'native' END").alias("source"))
    items = table(spark, d, "lineitem").where("l_orderkey % 4 <> 3").selectExpr("l_orderkey AS id", "CASE WHEN l_linenumber = 1 AND l_orderkey % 8 = 0 THEN 'Straight Bill of Lading' ELSE 'item' END AS text", "(l_partkey % 8) * 100.0D + 20 AS cx", "(l_suppkey % 4) * 90.0D + 10 AS cy", "(l_partkey % 8) * 100.0D + 40 AS x1", "(l_suppkey % 4) * 90.0D + 20 AS y1")
    items = items.join(pages.select("id"), "id", "left_semi")
    return L.classify(pages, items.unionByName(items)).withColumn("evidence", F.array_join("evidence", "+"))


def reading_order(spark, d):
    """Blocks of pages in the order in which they are read, at most five of a document."""
    li = table(spark, d, "lineitem").selectExpr("l_orderkey AS id", "l_linenumber % 2 AS page", "concat(' ', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(CAST(l_extendedprice * 100 AS BIGINT) AS STRING)) AS text", "l_quantity AS x0", "CAST(l_tax * 100 + 0.5 AS INT) AS y0")
    return L.reading_order(li.distinct(), 5, 4)


def rescue_plan(spark, d):
    """Fields of a bill that are to be asked for again, by what speaks against them."""
    f = long(bills(spark, d)).withColumn("ord", F.expr(f"array_position(array({', '.join(map(Q.lit, FIELDS))}), field)").cast("int"))
    r = [("doc_id % 7 = ord", rescue.MISSING), ("doc_id % 5 = ord", rescue.LOW), ("(doc_id + ord) % 9 = 0", rescue.STUB), ("(doc_id + ord) % 4 = 0", rescue.AMBIGUOUS), ("doc_id % 11 = 0", rescue.CONFLICT), ("(doc_id + ord) % 6 = 0", rescue.JOINT)]
    plan = f.withColumn("reasons", F.array_compact(F.array(*[F.when(F.expr(c), k) for c, k in r])))
    return rescue.select(plan, 4).withColumn("reasons", F.array_join("reasons", "+"))


_READ = """SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN 'SUB-HAUL#' WHEN 2 THEN 'Qee' WHEN 3 THEN carrier ELSE 'New Shipper' END AS consignor, CASE doc_id % 4 WHEN 0 THEN consignor WHEN 1 THEN '' WHEN 2 THEN 'Fresh Receiver' ELSE carrier END AS consignee, carrier,
  CASE WHEN doc_id % 3 = 0 THEN 'no disponible' ELSE concat(origin, ' East') END AS origin, 'INV-1' AS invoice_number FROM bills"""
_BASE = "SELECT doc_id AS id, consignor, consignee, CASE WHEN doc_id % 6 = 0 THEN 'ADDRESS' ELSE carrier END AS carrier, CASE WHEN doc_id % 9 = 0 THEN 'Supplier' ELSE origin END AS origin, 'CA0385520' AS invoice_number FROM bills"
_FIELDS = ["consignor", "consignee", "carrier", "origin", "invoice_number"]


def _readings(spark, d, merge):
    bills(spark, d).createOrReplaceTempView("__bills")
    base, read = (spark.sql(q.replace("FROM bills", "FROM __bills")) for q in (_BASE, _READ.replace("consignee, carrier,", "consignee, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE carrier END AS carrier,")))
    return merge(base, read, _FIELDS).select("id", *_FIELDS)


def merge_reading(spark, d):
    """Fields after a model's reading of the text."""
    return _readings(spark, d, D.merge_reading)


def merge_vision(spark, d):
    """Fields after a model's reading of the picture."""
    return _readings(spark, d, D.merge_vision)


def learned_names(spark, d):
    """Names after reviews: seeds and what reviewers wrote, no shipper or receiver that is a carrier."""
    names = spark.createDataFrame(seeds.NAME_ROWS, "field string, ord int, name string")
    r = long(bills(spark, d).where("reviewed")).where("field IN ('consignor', 'consignee', 'carrier')").select("field", F.expr("CASE WHEN doc_id % 9 = 0 THEN ' CLEAN PLANET ' WHEN doc_id % 10 = 0 THEN 'SUB-HAUL#' WHEN doc_id % 7 = 0 THEN 'Building' ELSE value END").alias("value"))
    return D.party_names(D.learn_names(names, r)).select("field", "name")


def ticket_upsert(spark, d):
    """One ticket for a customer: its latest that says anything, at the place of its first."""
    r = bills(spark, d).select((F.col("doc_id") % 97).alias("doc_id"), F.col("doc_id").alias("seq"), F.expr("CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE consignor END").alias("consignor"), F.expr("CASE WHEN doc_id % 10 < 6 THEN NULL ELSE carrier END").alias("carrier"))
    return D.latest_tickets(r, ["consignor", "carrier"])


QUERIES = {f.__name__: f for f in (historical_conflict, peaked_fill, likely_entities, label_outcomes, calibration_gate, review_labels, calibration_status, layout_class, reading_order, rescue_plan, merge_reading, merge_vision, learned_names, ticket_upsert)}

_K = Q.key
_EDGES = priors.edges_sql(_ALL)
_ASKS = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS ord, '{r[-1]}' AS field, '{'>'.join(r)}' AS relation, concat_ws('|', {', '.join(_K(c) for c in r[:-1])}) AS given_key, {r[-1]} AS value FROM given WHERE " + " AND ".join(f"trim({c}) <> ''" for c in r)
    for i, r in enumerate(D.CONFLICTS)
)


def _hit(relation: str, given: list[str], what: str) -> str:
    """One figure of history for a row of ``given``."""
    ok = " AND ".join(f"coalesce(trim(g.{c}), '') <> ''" for c in given)
    return f"(SELECT {what} FROM edges e WHERE {ok} AND e.relation = '{relation}' AND e.given_key = concat_ws('|', {', '.join(_K(f'g.{c}') for c in given)}))"


def _carriers(what: str) -> str:
    ship, recv = (_hit(f"{c}>carrier", [c], what) for c in ("consignor", "consignee"))
    n = [_hit(f"{c}>carrier", [c], "count(*)") for c in ("consignor", "consignee")]
    both = _hit("consignor>consignee>carrier", ["consignor", "consignee"], "count(*)")
    return f"CASE WHEN {both} > 0 THEN {_hit('consignor>consignee>carrier', ['consignor', 'consignee'], what)} WHEN {n[1]} = 0 THEN {ship} WHEN {n[0]} = 0 THEN {recv} END"


def _drivers(what: str, fall: bool) -> str:
    both = _hit("consignor>carrier>driver_name", ["consignor", "carrier"], "count(*)")
    one = _hit("carrier>driver_name", ["carrier"], what)
    return f"CASE WHEN coalesce(g.carrier, '') = '' THEN NULL WHEN {both} > 0 THEN {_hit('consignor>carrier>driver_name', ['consignor', 'carrier'], what)} {'ELSE ' + one if fall else 'WHEN g.consignor IS NULL THEN ' + one} END"


_TOP = "max(struct_pack(v := target, c := cnt, p := prob)) FILTER (rank = 1)"
_FIRST = "max(target) FILTER (rank = 1)"


def _likely() -> str:
    def pick(what: str) -> dict[str, str]:
        full = ["consignor", "consignee", "origin", "destination"]
        of_full = _hit(">".join([*full, "carrier"]), full, "count(*)")
        return {
            "carriers": f"CASE WHEN {of_full} > 0 THEN {_hit('>'.join([*full, 'carrier']), full, what)} WHEN consignor IS NOT NULL AND consignee IS NOT NULL THEN {_carriers(what)} WHEN consignor IS NOT NULL THEN {_hit('consignor>carrier', ['consignor'], what)} END",
            "consignees": f"CASE WHEN consignor IS NOT NULL AND consignee IS NULL THEN {_hit('consignor>consignee', ['consignor'], what)} END", "drivers": _drivers(what, False), "destinations": _hit("origin>destination", ["origin"], what),
        }

    n, first = pick("count(*)"), pick(_FIRST)
    return ", ".join(f"CAST(coalesce({n[k]}, 0) AS INTEGER) AS n_{k}, {first[k]} AS first_{k}" for k in n)


_CAL = {f: [(a, v) for g, a, v in _POINTS if g == f] for f in ("carrier", "origin")}


def _line(f: str) -> str:
    p = _CAL[f]
    return f"CASE WHEN raw < {p[0][0]} THEN {p[0][1]} " + " ".join(f"WHEN raw < {b} THEN {v} + ({w}::DOUBLE - {v}::DOUBLE) * (raw - {a}::DOUBLE) / ({b}::DOUBLE - {a}::DOUBLE)" for (a, v), (b, w) in zip(p, p[1:])) + f" ELSE {p[-1][1]} END"


def _words(words: list[str], where: str = "blob") -> str:
    return "(" + " + ".join(f"CASE WHEN contains({where}, '{w}') THEN 1 ELSE 0 END" for w in words) + ")"


_WEIGH = [
    ("handwritten_heavy", "sparse", 45, "low_ocr_density"), ("handwritten_heavy", "source = 'preprocessed_image' AND sparse", 20, "handwriting_indicators"), ("handwritten_heavy", "alnum < 40", 15, "sparse_ocr_text"), ("handwritten_heavy", "printed", -35, None),
    ("standard_freight_bill", "freight >= 3", 42, "freight_bill_keywords"), ("standard_freight_bill", "freight = 2", 22, "freight_bill_keywords"), ("standard_freight_bill", "parties >= 2", 18, "party_labels"), ("standard_freight_bill", "route >= 2", 12, "route_labels"),
    ("standard_freight_bill", "h_freight", 16, "freight_header_region"), ("standard_freight_bill", "h_bill", 8, "bill_number_region"), ("standard_freight_bill", "printed AND freight >= 2", 10, "printed_form_density"), ("invoice_style", "invoice >= 3", 48, "invoice_keywords"),
    ("invoice_style", "invoice = 2", 32, "invoice_keywords"), ("invoice_style", "h_invoice", 22, "invoice_header_region"), ("invoice_style", "contains(blob, 'amount due') OR contains(blob, 'subtotal')", 12, "invoice_totals"), ("standard_freight_bill", "invoice >= 2 AND freight < 2", -12, None),
    ("table_heavy", "tables >= 3", 40, "table_headers"), ("table_heavy", "cols >= 3 AND nrows >= 3", 32, "table_structure"), ("table_heavy", "cols >= 3 AND nrows < 3", 18, "aligned_columns"), ("table_heavy", "tables >= 3 AND (cols >= 3 OR nrows >= 3)", 12, None),
]
_LAYOUT = f"""pg AS (SELECT doc_id AS id, {_PAGE} AS text, CASE WHEN doc_id % 13 = 0 THEN 2 ELSE 1 END AS pages, CASE WHEN doc_id % 3 = 1 THEN 'preprocessed_image' ELSE 'native' END AS source FROM bills),
i1 AS (SELECT l_orderkey AS id, CASE WHEN l_linenumber = 1 AND l_orderkey % 8 = 0 THEN 'straight bill of lading' ELSE 'item' END AS t, (l_partkey % 8) * 100.0 + 20 AS cx, (l_suppkey % 4) * 90.0 + 10 AS cy FROM lineitem JOIN bills ON doc_id = l_orderkey WHERE l_orderkey % 4 <> 3), it AS (SELECT * FROM i1 UNION ALL SELECT * FROM i1),
ex AS (SELECT *, max(cx + 20) OVER (PARTITION BY id) AS width, max(cy + 10) OVER (PARTITION BY id) AS height, count(*) OVER (PARTITION BY id) AS n FROM it),
gc AS (SELECT id, CAST(count(*) FILTER (k >= 4) AS INTEGER) AS cols FROM (SELECT id, floor(least(0.99, cx / width) * 8) AS b, count(*) AS k FROM ex WHERE n >= 8 GROUP BY 1, 2) GROUP BY id),
gr AS (SELECT id, CAST(count(*) FILTER (k >= 3) AS INTEGER) AS nrows FROM (SELECT id, floor(least(0.99, cy / height) * 16) AS b, count(*) AS k FROM ex WHERE n >= 8 GROUP BY 1, 2) GROUP BY id),
hd AS (SELECT id, bool_or(t <> 'item' AND (cy <= 150 OR (height > 200 AND cy <= 0.28 * height))) AS hf FROM ex GROUP BY id),
b1 AS (SELECT pg.id, source, pages, text, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS blob, hf, coalesce(cols, 0) AS cols, coalesce(nrows, 0) AS nrows, length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS alnum FROM pg LEFT JOIN hd USING (id) LEFT JOIN gc USING (id) LEFT JOIN gr USING (id)),
b2 AS (SELECT *, alnum / pages < 80 OR length(text) / pages < 160 AS sparse, alnum / pages >= 120 AND length(text) / pages >= 220 AS printed, {_words(L.FREIGHT)} AS freight, {_words(L.INVOICE)} AS invoice, {_words(L.TABLE)} AS tables, {_words(['consignor', 'consignee'])} AS parties, {_words(['origin', 'destination'])} AS route,
  coalesce(hf, {_words(L.FREIGHT_HEADER)} > 0) AS h_freight, CASE WHEN hf IS NOT NULL THEN false ELSE {_words(L.INVOICE_HEADER, 'substr(blob, 1, 400)')} > 0 END AS h_invoice, CASE WHEN hf IS NOT NULL THEN false ELSE {_words(L.BILL_LABELS, 'substr(blob, 1, 400)')} > 0 END AS h_bill FROM b1),
b3 AS (SELECT id, [{', '.join('least(100, greatest(0, ' + ' + '.join(f'CASE WHEN {ok} THEN {w} ELSE 0 END' for k, ok, w, _ in _WEIGH if k == c) + '))' for c in L.CLASSES)}] AS sc, list_distinct([]::VARCHAR[]) AS none, list_filter([{', '.join(f"CASE WHEN {ok} THEN '{e}' END" for _, ok, _, e in _WEIGH if e)}], lambda x: x IS NOT NULL) AS ev FROM b2),
b4 AS (SELECT *, list_max(sc) AS best, list_sort(sc, 'DESC')[2] AS second, list_position(sc, list_max(sc)) AS kind FROM b3)
SELECT id, CASE WHEN best < 40 OR (best - second < 12 AND second >= 30) THEN 'unknown' ELSE [{', '.join(map(Q.lit, L.CLASSES))}][kind] END AS layout_class,
  CASE WHEN best < 40 THEN CASE WHEN best = 0 THEN 0.2::DOUBLE ELSE best / 100 END WHEN best - second < 12 AND second >= 30 THEN ((2000 + 25 * best + 50) // 100) / 100 ELSE greatest(0.55::DOUBLE, least(0.95::DOUBLE, ((5200 + 35 * best + 40 * least(best - second, 40) + 50) // 100) / 100)) END AS confidence,
  array_to_string(CASE WHEN best < 40 AND len(ev) = 0 THEN ['weak_or_ambiguous'] WHEN best >= 40 AND best - second < 12 AND second >= 30 THEN list_append(ev, 'ambiguous_layout_scores') ELSE ev END, '+') AS evidence FROM b4"""
_NOT_READ = ", ".join(map(Q.lit, D.NOTHING_READ))
_PARTY = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"


def _merged(vision: bool) -> str:
    take = lambda f, junk: f"CASE WHEN r.{f} IS NOT NULL AND lower(trim(r.{f})) NOT IN ({_NOT_READ}) AND NOT {Q.is_header(f'r.{f}')} {f'AND NOT {Q.is_junk(f"r.{f}")}' if junk else ''} THEN r.{f} ELSE b.{f} END AS {f}, r.{f} IS NULL OR lower(trim(r.{f})) IN ({_NOT_READ}) AS no_{f}"
    read = _READ.replace("consignee, carrier,", "consignee, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE carrier END AS carrier,")
    steps = f"""ba AS ({_BASE}), rd AS ({read}), m1 AS (SELECT b.id, {take('consignor', True)}, {take('consignee', True)}, {take('carrier', False)}, {take('origin', True)} FROM ba b JOIN rd r USING (id)),
m2 AS (SELECT * REPLACE (CASE WHEN coalesce({_PARTY.format('consignee')}, '') <> '' AND {_PARTY.format('consignee')} IN (coalesce({_PARTY.format('consignor')}, ''), coalesce({_PARTY.format('carrier')}, '')) THEN NULL ELSE consignee END AS consignee,
  CASE WHEN coalesce({_PARTY.format('consignor')}, '') <> '' AND {_PARTY.format('consignor')} = coalesce({_PARTY.format('carrier')}, '') THEN NULL ELSE consignor END AS consignor) FROM m1)"""
    if vision:
        steps += f""", m3 AS (SELECT * REPLACE ({', '.join(f"CASE WHEN no_{f} AND {f} IS NOT NULL AND ({Q.is_header(f)} OR {Q.is_junk(f)}) THEN NULL ELSE {f} END AS {f}" for f in ('consignor', 'consignee', 'origin', 'carrier'))}) FROM m2),
m4 AS (SELECT * REPLACE (CASE WHEN coalesce({_PARTY.format('origin')} <> '' AND {_PARTY.format('origin')} <> {_PARTY.format('consignor')} AND contains({_PARTY.format('consignor')}, {_PARTY.format('origin')}) AND length({_PARTY.format('origin')}) <= 8 AND no_origin, false) THEN NULL ELSE origin END AS origin) FROM m3)"""
    return f"WITH {BILLS_SQL}, {steps} SELECT id, consignor, consignee, carrier, origin, CAST(NULL AS VARCHAR) AS invoice_number FROM {'m4' if vision else 'm2'}"


_LONG = "UNPIVOT (SELECT doc_id, carrier, consignor, consignee, driver_name, origin, destination FROM bills{}) ON carrier, consignor, consignee, driver_name, origin, destination INTO NAME field VALUE value"
_EX = "ex AS (SELECT doc_id AS document_id, lang AS field, CAST(quality AS INTEGER) AS label FROM labels JOIN documents USING (doc_id) WHERE lang IS NOT NULL)"
_REASONS = [("doc_id % 7 = ord", rescue.MISSING), ("doc_id % 5 = ord", rescue.LOW), ("(doc_id + ord) % 9 = 0", rescue.STUB), ("(doc_id + ord) % 4 = 0", rescue.AMBIGUOUS), ("doc_id % 11 = 0", rescue.CONFLICT), ("(doc_id + ord) % 6 = 0", rescue.JOINT)]
ORACLES = {
    "historical_conflict": f"""WITH {BILLS_SQL}, {_EDGES}, given AS (SELECT doc_id, consignor, CASE WHEN doc_id % 10 = 0 THEN '' ELSE consignee END AS consignee, origin, destination, CASE WHEN doc_id % 6 = 0 THEN 'Zed Lines' ELSE carrier END AS carrier, driver_name FROM bills), a AS ({_ASKS}),
h AS (SELECT a.*, t.target AS usual, t.cnt AS usual_count, t.prob AS usual_prob FROM a JOIN edges t ON t.relation = a.relation AND t.given_key = a.given_key AND t.rank = 1 AND t.cnt >= 3 AND t.prob >= 0.7 WHERE {_K('t.target')} <> {_K('a.value')}
  AND NOT EXISTS (SELECT 1 FROM edges o WHERE o.relation = a.relation AND o.given_key = a.given_key AND {_K('o.target')} = {_K('a.value')} AND (o.cnt >= 3 OR o.prob >= 0.2)))
SELECT doc_id, field, relation, value, usual, usual_count, usual_prob FROM h QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY ord) = 1""",
    "peaked_fill": f"""WITH {BILLS_SQL}, {_EDGES}, g AS (SELECT doc_id, consignor, {_LOST.format(2, 'consignee')} AS consignee, {_LOST.format(0, 'carrier')} AS carrier, CASE WHEN doc_id % 4 = 1 OR driver_name = '5-LOW' THEN NULL ELSE driver_name END AS driver_ok, {_LOST.format(1, 'driver_name')} AS driver_name FROM bills),
x AS (SELECT doc_id, CASE WHEN consignee IS NULL THEN 'consignee' WHEN carrier IS NULL THEN 'carrier' ELSE 'driver_name' END AS field, CASE WHEN consignee IS NULL THEN {_hit('consignor>consignee', ['consignor'], _TOP)} WHEN carrier IS NULL THEN {_carriers(_TOP)} ELSE {_drivers(_TOP, True)} END AS t
  FROM g WHERE CAST(consignee IS NULL AS INTEGER) + CAST(carrier IS NULL AS INTEGER) + CAST(driver_ok IS NULL AS INTEGER) = 1)
SELECT doc_id, field, t.v AS value, t.c AS cnt, t.p AS prob FROM x WHERE t.c >= 3 AND t.p >= 0.8 AND t.v <> '5-LOW'""",
    "likely_entities": f"WITH {BILLS_SQL}, {_EDGES}, g AS (SELECT doc_id, {_LOST.format(3, 'consignor')} AS consignor, {_LOST.format(2, 'consignee')} AS consignee, carrier, origin, destination FROM bills) SELECT doc_id, {_likely()} FROM g",
    "label_outcomes": f"""WITH {BILLS_SQL}, f AS ({_LONG.format('')}), p AS (SELECT field, CASE WHEN doc_id % 7 = 0 THEN 'n/a' WHEN doc_id % 5 = 0 THEN value || 'x' WHEN doc_id % 3 = 0 THEN upper(value) ELSE value END AS pred, CASE WHEN doc_id % 11 = 0 THEN '' ELSE value END AS gold FROM f)
SELECT field, CASE WHEN pred = 'n/a' THEN NULL WHEN gold = '' THEN 0 WHEN {_K('pred')} = {_K('gold')} THEN 1 ELSE 0 END AS label, count(*) AS n FROM p GROUP BY 1, 2""",
    "calibration_gate": f"""WITH {_EX}, o AS (SELECT field, document_id, count(*) AS n, sum(label) AS p FROM ex GROUP BY 1, 2), w AS (SELECT field, count(*) AS n, sum(label) AS p FROM ex GROUP BY 1)
SELECT field, document_id, w.n - o.n AS samples, CAST(w.p - o.p AS BIGINT) AS positives, CAST((w.n - o.n) - (w.p - o.p) AS BIGINT) AS negatives, w.n - o.n >= 20 AND w.p - o.p >= 3 AND (w.n - o.n) - (w.p - o.p) >= 3 AS can_fit FROM o JOIN w USING (field)""",
    "review_labels": f"""WITH {_EX}, a AS (SELECT field, 0.5::DOUBLE AS raw_confidence, label FROM ex WHERE document_id % 3 <> 0 UNION ALL SELECT field, CASE WHEN document_id % 9 = 0 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END, CASE WHEN document_id % 2 = 0 THEN 1 ELSE 0 END FROM ex WHERE document_id % 3 = 0)
SELECT field, raw_confidence, label, count(*) AS n FROM a GROUP BY 1, 2, 3""",
    "calibration_status": f"""WITH {BILLS_SQL}, f AS ({_LONG.format('')}), r AS (SELECT doc_id, field, doc_id % 12 = 0 OR doc_id % 101 = 0 AS empty, doc_id % 7 = 0 AS reviewed, (doc_id % 101) / 100 AS raw FROM f WHERE field IN ('carrier', 'origin', 'driver_name')),
c AS (SELECT *, CASE field WHEN 'carrier' THEN floor(({_line('carrier')}) * 1000000 + 0.5) / 1000000 WHEN 'origin' THEN floor(({_line('origin')}) * 1000000 + 0.5) / 1000000 END AS calibrated FROM r),
s AS (SELECT *, CASE WHEN empty THEN 'empty_field' WHEN reviewed THEN 'reviewed_gold' WHEN calibrated IS NOT NULL THEN 'calibrated' ELSE 'fallback_insufficient_data' END AS status, floor(CASE WHEN empty THEN 0.0::DOUBLE WHEN reviewed THEN 1.0::DOUBLE ELSE coalesce(calibrated, raw) END * 10000 + 0.5) / 10000 AS confidence, 0.7::DOUBLE AS threshold FROM c)
SELECT doc_id, field, status, confidence, threshold, NOT empty AND confidence >= 0.7 AS auto_post, CASE WHEN status = 'calibrated' AND confidence < 0.7 THEN 'Low calibrated confidence for ' || field || ' (' || printf('%.2f', confidence) || ' < 0.70)' END AS warning FROM s""",
    "layout_class": f"WITH {BILLS_SQL}, {_LAYOUT}",
    "reading_order": """WITH b AS (SELECT DISTINCT l_orderkey AS id, l_linenumber % 2 AS page, concat(' ', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(CAST(floor(l_extendedprice * 100) AS BIGINT) AS STRING)) AS text, l_quantity AS x0, CAST(floor(l_tax * 100 + 0.5) AS INTEGER) AS y0 FROM lineitem),
c AS (SELECT id, page, substr(trim(text), 1, 4) AS text, x0, y0, CAST(row_number() OVER (PARTITION BY id, page ORDER BY y0, x0, substr(trim(text), 1, 4)) AS INTEGER) AS reading_order FROM b) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY page, reading_order) <= 5""",
    "rescue_plan": f"""WITH {BILLS_SQL}, f AS ({_LONG.format('')}), o AS (SELECT doc_id, field, CAST(list_position([{', '.join(map(Q.lit, FIELDS))}], field) AS INTEGER) AS ord FROM f), r AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {c} THEN '{k}' END" for c, k in _REASONS)}], lambda x: x IS NOT NULL) AS rs FROM o),
p AS (SELECT *, CASE WHEN list_contains(rs, 'missing_field') THEN 8 ELSE 0 END + CASE WHEN list_has_any(rs, ['low_confidence', 'weak_ocr_stub']) THEN 4 ELSE 0 END + CASE WHEN list_contains(rs, 'candidate_ambiguity') THEN 2 ELSE 0 END + CASE WHEN list_contains(rs, 'consistency_conflict') THEN 2 ELSE 0 END + CASE WHEN list_contains(rs, 'joint_decode_uncertain') THEN 1 ELSE 0 END AS priority FROM r WHERE len(rs) > 0)
SELECT doc_id, field, array_to_string(rs, '+') AS reasons, priority, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY priority DESC, ord) AS INTEGER) AS rank FROM p QUALIFY rank <= 4""",
    "merge_reading": _merged(False),
    "merge_vision": _merged(True),
    "learned_names": f"""WITH {BILLS_SQL}, f AS ({_LONG.format(' WHERE reviewed')}), r AS (SELECT field, CASE WHEN doc_id % 9 = 0 THEN 'CLEAN PLANET' WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'Building' ELSE value END AS name FROM f WHERE field IN ('consignor', 'consignee', 'carrier')),
a AS (SELECT field, ord, name FROM {Q.values(seeds.NAME_ROWS, 'field, ord, name')} UNION ALL SELECT field, 1 << 30, name FROM r WHERE name IS NOT NULL), k AS (SELECT field, {_K('name')} AS k, arg_min(name, struct_pack(o := ord, n := name)) AS name FROM a GROUP BY 1, 2)
SELECT field, name FROM k WHERE field NOT IN ('consignor', 'consignee') OR k NOT IN (SELECT k FROM k WHERE field = 'carrier')""",
    "ticket_upsert": f"""WITH {BILLS_SQL}, r AS (SELECT doc_id % 97 AS doc_id, doc_id AS seq, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE consignor END AS consignor, CASE WHEN doc_id % 10 < 6 THEN NULL ELSE carrier END AS carrier FROM bills)
SELECT doc_id, min(seq) AS place, arg_max(consignor, seq) AS consignor, first(carrier ORDER BY seq DESC) AS carrier FROM r WHERE trim(consignor) <> '' OR carrier IS NOT NULL GROUP BY doc_id""",
}
