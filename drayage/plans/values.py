"""Queries that test and clean single values: every sample, and names of the tables with known damage."""

from __future__ import annotations

from pyspark.sql import functions as F

from drayage.functions import seeds
from drayage.functions import shapes as S
from drayage.operators import matching as M
from drayage.operators.bills import BILLS_SQL, bills
from drayage.plans import sqltext as Q

SAMPLES = [
    "Handwritten", "NO", "ADDRESS", "SUB-HAUL#", "MHOURS", "Bill No: HB-78421", "Vehicle #: UP-32-T-5821", "एफबी-१०२३६", "आईएनवी-६२१", "$3450", "3450.00", "INVALID", "26/08/2026", "08/26/2026",
    "MO. 2 DAY 2 YR. 26", "4", "DBTRSETWSBLBMD", "930", "1020", "27.0215:20 5:27", "32,450los", "14.920lbs", "18,760 Ibs", "Columbus,OH", "Dallas,Tx", "Qee", "RN Alo YRZ", "BElIm Ae ME", "YRZ5 Stockton Discavery Bay CA",
    "A&A Concrete", "Discovery Bay CA", "CALIFORNIAMATERIALS,INC.", "GraniteVernalis", "POINT OF DESTINATION", "Point of  Origin x", "sub haul Logistics LLC", "Tag Number: 684755", "Street and City Tracy", "  Mike Gordon ", "Samuel M",
    "4455", "CA0385520", "ca 0385520", "1234.567", "€ 1,200.5", "(12.50)", "-12.5", "Approx, 500", "9:05 pm", "25:10", "17:45 A.M.", "5:20 foo P. M.", "000", "2460", "2026-02-30", "30/02/2026", "31.12.25", "2025/7/4 and 1/2/2024", "F3-1024", "H3-77",
    "ab", "a1", "--", "N. Hooper St 95213", "1200  North Hooper St., Stockton CA 95213-1234", "W. Linne Bd", "STOCKTONca", "Miles 42", "Total Hours", "x/y", "Tracy/Manteca", "one two three 4 five", "Ab Cd Ef", "  ", "", "C0L0NEL 9 CO", "O'Brien, J. #2", "naïve Café", "bill.of-lading_no", "FB 10247", "invoice number # INV-7",
]


def _samples(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate([*SAMPLES, None])], "id int, s string")


_V = Q.values([(i, s) for i, s in enumerate([*SAMPLES, None])], "id, s")


def value_tests(spark, d):
    """What the tests say of every sample."""
    c = F.col("s")
    tests = {
        "is_label": S.is_label(S.strip(c)), "is_header": S.is_header(c), "is_junk": S.is_junk(c), "learned": S.harvestable("consignor", c), "learned_driver": S.harvestable("driver_name", c), "trusted_carrier": S.trusted("carrier", c),
        "trusted_place": S.trusted("origin", c), "person": S.person_name(c), "permit": S.permit_number(c), "indic": S.indic_script(c), "sparse": S.sparse(c), "party_shape": S.shape_ok("consignor", c), "money_shape": S.shape_ok("total_amount", c),
        "date_shape": S.shape_ok("bill_date", c), "weight_shape": S.shape_ok("weight", c), "clock_shape": S.shape_ok("pickup_time", c), "vehicle_shape": S.shape_ok("vehicle_number", c),
    }
    return _samples(spark).select("id", *[F.coalesce(t, F.lit(False)).alias(k) for k, t in tests.items()])


def value_cleaners(spark, d):
    """What the cleaners make of every sample."""
    c = F.col("s")
    made = {
        "text": S.clean_text(c), "unglued": S.unglue(c), "identifier": S.clean_identifier(c), "place": S.clean_place(c), "money": S.clean_money(c), "weight": S.clean_weight(c), "date": S.clean_date(c), "clock": S.clean_clock(c), "signed": S.signed(c),
        "variants": F.array_join(S.name_variants(c), "|"), "zip": S.zip_code(c), "street": S.street(c), "label": S.label_key(c), "file": S.download_name(c), "core": S.place_core(c),
    }
    return _samples(spark).select("id", *[v.alias(k) for k, v in made.items()])


#: How names of the tables are damaged, by doc_id.
_DAMAGE = "CASE doc_id % 9 WHEN 0 THEN 'CleanPlanet' WHEN 1 THEN 'Crim  Planet' WHEN 2 THEN 'Bell Narine' WHEN 3 THEN 'Big Planet Hooper' WHEN 4 THEN 'Ocean Blue Planet' WHEN 5 THEN 'C0L0NEL 9 CO' WHEN 6 THEN 'Concord' ELSE {} END"


def alias_resolve(spark, d):
    """Names of parties and places by alias, counted."""
    b = bills(spark, d)
    long = b.select(F.col("doc_id").alias("id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.expr(_DAMAGE.format(f)).alias("value")) for f in ("consignor", "consignee", "destination")])).alias("x")).select("id", "x.*")
    out = M.resolve_aliases(long, spark.createDataFrame(seeds.ALIAS_ROWS, "field string, alias_key string, canonical string"))
    return out.groupBy("field", "alias").agg(F.count("*").alias("n"), F.min("id").alias("least"))


_PLACES = ["N. Hooper St 95213", "Tracy, CA 95304", "95336", "Dallas, TX 75201", "Stockton", "Discovery Bay, CA", "near 94505-0001", "12 Main St", "Modesto 95350", "Lodi", "Reno,NV"]
_PLACE = "CASE doc_id % {n} " + " ".join(f"WHEN {i} THEN {Q.lit(p)}" for i, p in enumerate(_PLACES)) + " ELSE origin END"


def _zips(spark):
    return spark.createDataFrame(seeds.ZIPS, "zip string, city string, state string")


def _places(spark, d):
    return bills(spark, d).select(F.col("doc_id").alias("id"), F.lit("origin").alias("field"), F.expr(_PLACE.format(n=13)).alias("value"))


def zip_hint(spark, d):
    """Places as their ZIP has them."""
    return M.zip_hint(_places(spark, d), _zips(spark)).select("id", "hinted")


def place_states(spark, d):
    """States of places, counted."""
    return M.state_of(_places(spark, d), _zips(spark)).groupBy("value", "state").agg(F.count("*").alias("n"))


_TO = ["Stockton", "Tracy, CA", "North Hooper", "Discovery Bay", "Hooper"]
_GIVEN = f"""SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'North Hooper Stockton' WHEN 1 THEN 'Tracy, CA' ELSE origin END AS origin,
  CASE doc_id % 5 {' '.join(f"WHEN {i} THEN {Q.lit(p)}" for i, p in enumerate(_TO))} END AS destination, CASE doc_id % 7 WHEN 0 THEN carrier WHEN 1 THEN 'California Materials, Inc.' ELSE consignor END AS consignor,
  CASE doc_id % 4 WHEN 0 THEN 'Palm Orwood Tract Farms' WHEN 1 THEN 'at Palm Wood' ELSE consignee END AS consignee, carrier, CASE WHEN doc_id % 8 = 0 THEN 'to Cannon Landfill' END AS special_instructions, CASE WHEN doc_id % 6 = 0 THEN '' END AS commodity_description FROM bills"""


def destination_repair(spark, d):
    """Destinations copied from their origin become what else the bill names; parties that are a carrier go."""
    bills(spark, d).createOrReplaceTempView("__bills")
    given = spark.sql(_GIVEN.replace("FROM bills", "FROM __bills"))
    names = spark.createDataFrame(seeds.NAME_ROWS, "field string, ord int, name string")
    out = M.clear_letterhead(M.repair_destination(given, names), names)
    return out.groupBy("destination", F.col("consignor").isNull().alias("no_shipper")).agg(F.count("*").alias("n"), F.min("id").alias("least"))


QUERIES = {f.__name__: f for f in (value_tests, value_cleaners, alias_resolve, zip_hint, place_states, destination_repair)}

_T = f"v AS (SELECT id, s, {Q.strip('s')} AS t FROM {_V}), h AS (SELECT *, {Q.is_header('t')} AS header, {Q.is_junk('t')} AS junk FROM v)"
_LEARNED = "(coalesce(t, '') <> '' AND NOT header AND NOT junk AND length(regexp_replace(t, '[^\\p{L}]', '', 'g')) >= 3 AND NOT regexp_matches(t, '[^\\p{L}\\p{N}_\\s.&,''/#-]'))"
_SHAPE = "(coalesce(t, '') <> '' AND NOT header AND {})"
_ISO = "strftime(try_strptime(printf('%04d-%02d-%02d', CASE WHEN {y} < 100 THEN {y} + 2000 ELSE {y} END, {m}, {d}), '%Y-%m-%d'), '%Y-%m-%d')"


def _cast(x: str) -> str:
    return f"TRY_CAST({x} AS INTEGER)"


_CLEAN = f"""{_T}, a AS (SELECT *, {Q.strip(f"regexp_replace(t, '{S.LABEL_PREFIX}', '')")} AS rest FROM h),
b AS (SELECT *, CASE WHEN NOT header AND NOT {Q.is_header('rest')} THEN rest END AS clean FROM a),
c AS (SELECT *, {Q.strip(f"regexp_replace(clean, '{S.ID_PREFIX}', '')")} AS bare FROM b),
e AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(bare, '०१२३४५६७८९', '0123456789'), '^एफबी', 'FB'), '^एचबी', 'HB'), '^आईएनवी', 'INV'), '^इन्व', 'INV') AS latin FROM c),
u AS (SELECT *, {', '.join(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?i)([A-Za-z])(MATERIALS|TRUCKING|CONCRETE|LOGISTICS|TRANSPORT|HAULING|EXPRESS|CARRIERS)\\b', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]{{2,}})([A-Z][a-z])', '\\1 \\2', 'g'), '(?i)\\s*,\\s*(INC|LLC|CORP|LTD)\\.?', ', \\1.', 'g'), ',\\s*,', ',', 'g'), '\\s+', ' ', 'g') AS {y}" for x, y in (('t', 'glued'), ('clean', 'spaced')))} FROM e),
w AS (SELECT *, regexp_replace(regexp_replace(regexp_replace({Q.strip("regexp_replace(regexp_replace(clean, '\\d{1,2}:\\d{2}(\\s*[AaPp]\\.?\\s*[Mm]\\.?)?', ' ', 'g'), '\\s+', ' ', 'g')")}, '(\\d+)\\.(\\d{{3}})([a-zA-Z\\s]|$)', '\\1,\\2\\3', 'g'), '(?i)(\\d+(,\\d{{3}})*(\\.\\d+)?)\\s*(lbs|los|1os|Ibs|Ib)\\b', '\\1 lbs', 'g'), 'x^', '') AS heavy,
  regexp_replace(t, '(\\d)\\.(\\d{{3}})\\b', '\\1\\2', 'g') AS cash, {_cast("regexp_extract(t, '\\b(\\d{1,2})[/.-](\\d{1,2})[/.-](\\d{2,4})\\b', 1)")} AS p1, {_cast("regexp_extract(t, '\\b(\\d{1,2})[/.-](\\d{1,2})[/.-](\\d{2,4})\\b', 2)")} AS p2, {_cast("regexp_extract(t, '\\b(\\d{1,2})[/.-](\\d{1,2})[/.-](\\d{2,4})\\b', 3)")} AS p3,
  {_cast("regexp_extract(t, '\\b(\\d{4})[/.-](\\d{1,2})[/.-](\\d{1,2})\\b', 1)")} AS q1, {_cast("regexp_extract(t, '\\b(\\d{4})[/.-](\\d{1,2})[/.-](\\d{1,2})\\b', 2)")} AS q2, {_cast("regexp_extract(t, '\\b(\\d{4})[/.-](\\d{1,2})[/.-](\\d{1,2})\\b', 3)")} AS q3,
  {_cast("regexp_extract(t, '(?i)\\bMO\\.?\\s*(\\d{1,2})\\b', 1)")} AS mo, {_cast("regexp_extract(t, '(?i)\\bDAY\\.?\\s*(\\d{1,2})\\b', 1)")} AS dy, {_cast("regexp_extract(t, '(?i)\\bYR\\.?\\s*(\\d{2,4})\\b', 1)")} AS yr,
  {_cast("regexp_extract(t, '\\b(\\d{1,2}):(\\d{2})\\b', 1)")} AS hh, {_cast("regexp_extract(t, '\\b(\\d{1,2}):(\\d{2})\\b', 2)")} AS mm, upper(regexp_replace(regexp_extract(regexp_extract(t, '(?s)\\b\\d{{1,2}}:\\d{{2}}\\b(.*)$', 1), '([AaPp]\\.?\\s*[Mm]\\.?)', 1), '[\\s.]', '', 'g')) AS half,
  regexp_replace(t, '\\D', '', 'g') AS digits, regexp_extract(t, '(?i)(-)?\\s*(US\\$|\\$|₹|€|£)?\\s*([\\d,]+(\\.\\d+)?)', 1) AS minus, TRY_CAST(replace(regexp_extract(t, '(?i)(-)?\\s*(US\\$|\\$|₹|€|£)?\\s*([\\d,]+(\\.\\d+)?)', 3), ',', '') AS DOUBLE) AS number FROM u),
z AS (SELECT *, nullif(regexp_extract(heavy, '(\\d{{1,3}}(,\\d{{3}})*(\\.\\d+)?|\\d+\\.\\d+)', 1), '') AS kilos, TRY_CAST(replace(regexp_extract(cash, '[$₹€£]?\\s*([\\d,]+\\.?\\d*)', 1), ',', '') AS DOUBLE) AS dollars,
  {_cast("regexp_extract(digits, '^(\\d{1,2})(\\d{2})$', 1)")} AS ch, {_cast("regexp_extract(digits, '^(\\d{1,2})(\\d{2})$', 2)")} AS cm FROM w)
SELECT id, clean AS text, {Q.strip('glued')} AS unglued,
  CASE WHEN NOT {Q.is_header('bare')} AND (length(latin) >= 3 OR regexp_matches(latin, '[0-9०-९]')) AND regexp_matches(latin, '[\\p{{L}}\\p{{N}}]') THEN regexp_replace(regexp_replace(latin, '^F3-', 'FB-'), '^H3-', 'HB-') END AS identifier,
  regexp_replace(regexp_replace(regexp_replace({Q.strip('spaced')}, '\\b([A-Z])([A-Z][a-z]{{2,}})\\b', '\\1 \\2', 'g'), '\\bBd\\b', 'Rd', 'g'), '([A-Za-z]+),([A-Za-z]{{2}})\\b', '\\1, \\2', 'g') AS place,
  CASE WHEN NOT ({Q.is_label('t')}) THEN format('${{:,.2f}}', dollars) END AS money, kilos || CASE WHEN regexp_matches(heavy, '(?i)\\blbs\\b') THEN ' lbs' ELSE '' END AS weight,
  CASE WHEN NOT header AND NOT regexp_matches(t, '^\\d{{1,2}}$') THEN coalesce(CASE WHEN p1 > 12 THEN {_ISO.format(y='p3', m='p2', d='p1')} WHEN p2 > 12 THEN {_ISO.format(y='p3', m='p1', d='p2')} ELSE {_ISO.format(y='p3', m='p1', d='p2')} END, {_ISO.format(y='q1', m='q2', d='q3')}, {_ISO.format(y='yr', m='mo', d='dy')}) END AS date,
  CASE WHEN NOT header THEN coalesce(CASE WHEN hh <= 23 AND mm <= 59 THEN hh || ':' || lpad(CAST(mm AS VARCHAR), 2, '0') || CASE WHEN half <> '' THEN ' ' || half ELSE '' END END, CASE WHEN ch <= 23 AND cm <= 59 AND ch + cm > 0 THEN ch || ':' || lpad(CAST(cm AS VARCHAR), 2, '0') END) END AS clock,
  CASE WHEN (starts_with(t, '(') AND ends_with(t, ')')) OR minus = '-' THEN -abs(number) ELSE number END AS signed,
  array_to_string(list_filter([x[1] FOR x IN list_zip([{Q.strip("regexp_replace(t, '\\s+', ' ', 'g')")}, {Q.strip("regexp_replace(translate(t, '015', 'OIS'), '\\s+', ' ', 'g')")}, {Q.strip("regexp_replace(replace(t, '9', '&'), '\\s+', ' ', 'g')")}, {Q.strip("regexp_replace(replace(t, ' 9 ', ' & '), '\\s+', ' ', 'g')")}], [1, 2, 3, 4])
    IF x[1] <> '' AND list_position([{Q.strip("regexp_replace(t, '\\s+', ' ', 'g')")}, {Q.strip("regexp_replace(translate(t, '015', 'OIS'), '\\s+', ' ', 'g')")}, {Q.strip("regexp_replace(replace(t, '9', '&'), '\\s+', ' ', 'g')")}, {Q.strip("regexp_replace(replace(t, ' 9 ', ' & '), '\\s+', ' ', 'g')")}], x[1]) = x[2]], lambda y: true), '|') AS variants,
  nullif(regexp_extract(s, '\\b(\\d{{5}})(-\\d{{4}})?\\b', 1), '') AS zip, nullif(regexp_replace(regexp_replace(regexp_extract(t, '{S.STREET}', 1), '\\s+', ' ', 'g'), '^[ ,]+|[ ,]+$', '', 'g'), '') AS street,
  regexp_replace(regexp_replace(lower(t), '[^\\p{{L}}\\p{{N}}_]+', '_', 'g'), '^_+|_+$', '', 'g') AS label,
  coalesce(nullif(substr(regexp_replace(regexp_replace(regexp_replace(coalesce(nullif(s, ''), 'freight_bill'), '^.*/', ''), '(.)\\.[^.]*$', '\\1'), '[^\\p{{L}}\\p{{N}}_.-]+', '_', 'g'), 1, 80), ''), 'freight_bill') || '_extraction_report.pdf' AS file,
  {Q.key("regexp_replace(coalesce(s, ''), '(?i)\\b(ca|california)\\b', '', 'g')")} AS core FROM z"""

_VARIANTS = ["t", "translate(t, '015', 'OIS')", "replace(t, '9', '&')", "replace(t, ' 9 ', ' & ')"]
_CITIES = [(k, z, s) for z, c, s in seeds.ZIPS for k in ["".join(ch for ch in c.lower() if ch.isalnum())] if len(k) >= 5]
_CORE = Q.key("regexp_replace(coalesce({}, ''), '(?i)\\b(ca|california)\\b', '', 'g')")


def _copied(o: str, d: str) -> str:
    o, d = _CORE.format(Q.strip(o)), _CORE.format(Q.strip(d))
    return f"(CASE WHEN {d} = '' THEN false WHEN {o} = {d} THEN true WHEN {o} <> '' AND contains({o}, {d}) AND length({d}) >= 6 THEN true WHEN {d} NOT IN ('stockton', 'stocktonca') THEN false WHEN {o} = '' OR contains({o}, {d}) THEN true ELSE NOT contains({d}, {o}) END)"


_DEST = [(i, n) for f, i, n in seeds.NAME_ROWS if f == "destination"]
ORACLES = {
    "value_tests": f"""WITH {_T}, x AS (SELECT id, {Q.is_label('t')} AS is_label, header AS is_header, junk AS is_junk, {_LEARNED} AS learned, {_LEARNED} AND NOT regexp_matches(t, '^\\d{{3,}}$') AS learned_driver,
  {_LEARNED} AND regexp_matches(s, '(?i)\\b(inc|llc|corp|co)\\.?\\b') AS trusted_carrier, {_LEARNED} AND (regexp_matches(s, '\\b\\d{{5}}\\b') OR regexp_matches(s, '(?i)\\b(CA|Stockton|Tracy|Discovery Bay|Vernalis|Manteca|Lathrop)\\b')) AS trusted_place,
  NOT header AND NOT regexp_matches(t, '\\d{{3,}}') AND NOT regexp_matches(t, '(?i)\\b(INC|LLC|CORP|LTD|MATERIALS|CONCRETE)\\b') AND regexp_matches(t, '^[A-Za-z][A-Za-z''`.-]{{1,24}}(\\s+[A-Za-z][A-Za-z''.]{{0,20}}){{1,2}}$') AS person,
  regexp_matches(regexp_replace(s, '[\\s-]+', '', 'g'), '(?i)^CA\\d{{5,}}$') AS permit, regexp_matches(s, '[\\x{{0900}}-\\x{{097F}}]') AS indic, length(regexp_replace(coalesce(s, ''), '[^A-Za-z0-9]', '', 'g')) < 40 AS sparse,
  {_SHAPE.format("NOT regexp_matches(t, '(?i)hours|miles') AND NOT junk")} AS party_shape, {_SHAPE.format("regexp_matches(t, '^\\$\\d')")} AS money_shape, {_SHAPE.format("regexp_matches(t, '^\\d{4}-\\d{2}-\\d{2}$')")} AS date_shape,
  {_SHAPE.format("regexp_matches(t, '\\d') AND NOT regexp_matches(t, '\\d{1,2}:\\d{2}')")} AS weight_shape, {_SHAPE.format("regexp_matches(t, '\\d{1,2}:\\d{2}')")} AS clock_shape, {_SHAPE.format("regexp_matches(t, '\\d') AND NOT regexp_matches(t, '(?i)miles|hours')")} AS vehicle_shape FROM h)
SELECT id, COLUMNS(* EXCLUDE (id)) IS TRUE FROM x""",
    "value_cleaners": f"WITH {_CLEAN}",
    "alias_resolve": f"""WITH {BILLS_SQL}, lg AS ({' UNION ALL '.join(f"SELECT doc_id AS id, '{f}' AS field, {_DAMAGE.format(f)} AS value FROM bills" for f in ('consignor', 'consignee', 'destination'))}),
t AS (SELECT id, field, value, {Q.strip('value')} AS t FROM lg), a AS (SELECT * FROM {Q.values(seeds.ALIAS_ROWS, 'field, alias_key, canonical')}),
k AS ({' UNION ALL '.join(f"SELECT id, field, {i} AS ord, {Q.key(v)} AS alias_key FROM t" for i, v in enumerate(_VARIANTS))}),
f AS (SELECT id, field, arg_min(canonical, ord) AS found FROM k JOIN a USING (field, alias_key) GROUP BY 1, 2),
r AS (SELECT t.id, t.field, coalesce(found, CASE WHEN t.field = 'consignor' AND ((contains({Q.key('value')}, 'planethooper') AND {Q.key('value')} <> 'cleanplanethooper') OR (ends_with({Q.key('value')}, 'planet') AND length({Q.key('value')}) >= 8)) THEN 'Clean Planet Hooper' END) AS alias FROM t LEFT JOIN f ON t.id = f.id AND t.field = f.field)
SELECT field, alias, count(*) AS n, min(id) AS least FROM r GROUP BY 1, 2""",
    "zip_hint": f"""WITH {BILLS_SQL}, z AS (SELECT * FROM {Q.values(seeds.ZIPS, 'zip, city, state')}), p AS (SELECT doc_id AS id, {_PLACE.format(n=13)} AS value FROM bills),
q AS (SELECT p.*, z.*, nullif(regexp_replace(regexp_replace(regexp_extract(value, '{S.STREET}', 1), '\\s+', ' ', 'g'), '^[ ,]+|[ ,]+$', '', 'g'), '') AS street, city || ', ' || state || ' ' || zip AS whole FROM p LEFT JOIN z ON z.zip = regexp_extract(value, '\\b(\\d{{5}})(-\\d{{4}})?\\b', 1))
SELECT id, CASE WHEN city IS NULL THEN value WHEN street IS NOT NULL THEN street || ', ' || whole WHEN contains({Q.key('value')}, {Q.key('city')}) AND contains(lower(value), lower(state)) THEN value ELSE whole END AS hinted FROM q""",
    "place_states": f"""WITH {BILLS_SQL}, z AS (SELECT * FROM {Q.values(seeds.ZIPS, 'zip, city, state')}), c AS (SELECT * FROM {Q.values(_CITIES, 'k, czip, cstate')}), p AS (SELECT {_PLACE.format(n=13)} AS value FROM bills), g AS (SELECT value, count(*) AS n FROM p GROUP BY 1),
q AS (SELECT value, n, z.state AS a, upper(regexp_extract(value, ',\\s*([A-Za-z]{{2}})\\b', 1)) AS b, (SELECT min(cstate) FROM c WHERE contains({Q.key('value')}, k)) AS e FROM g LEFT JOIN z ON z.zip = regexp_extract(value, '\\b(\\d{{5}})(-\\d{{4}})?\\b', 1))
SELECT value, coalesce(a, CASE WHEN b IN ({', '.join(map(Q.lit, seeds.STATES))}) THEN b END, e) AS state, n FROM q""",
    "destination_repair": f"""WITH {BILLS_SQL}, g AS ({_GIVEN}), k AS (SELECT * FROM {Q.values([(i, n, ''.join(c for c in n.lower() if c.isalnum())) for i, n in _DEST], 'ord, name, k')}),
h AS (SELECT g.*, (SELECT arg_max(name, length(k) * 1000 - ord) FROM k WHERE length(k) >= 6 AND contains({Q.key("concat_ws(' ', consignee, special_instructions, commodity_description)")}, k) AND NOT {_copied('g.origin', 'k.name')}) AS better FROM g),
r AS (SELECT id, CASE WHEN {_copied('origin', 'destination')} THEN better ELSE destination END AS destination, {Q.key('consignor')} IN ('californiamaterialsinc', {Q.key('carrier')}) AS no_shipper FROM h)
SELECT destination, no_shipper, count(*) AS n, min(id) AS least FROM r GROUP BY 1, 2""",
}
