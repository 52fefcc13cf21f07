"""Queries on evidence: labels, answers of models, joint choices written back, what reviewers are shown."""

from __future__ import annotations

from pyspark.sql import functions as F

from drayage.functions import aliases, answers
from drayage.functions import shapes as S
from drayage.operators import evidence as E
from drayage.operators.bills import BILLS_SQL, FIELDS, bills, long, table
from drayage.operators.resolve import ORDER
from drayage.plans import sqltext as Q

_N = len(aliases.ALIAS_ROWS)
_LABEL = "CASE doc_id % 4 WHEN 0 THEN upper(replace(alias, '_', ' ')) WHEN 1 THEN concat(' Our ', alias, ' #') WHEN 2 THEN substr(alias, 1, 5) ELSE concat('--', doc_id % 10) END"


def label_field(spark, d):
    """Fields that labels stand for, counted."""
    a = spark.createDataFrame(aliases.ALIAS_ROWS, "alias string, field string, ord int").select("alias", "ord")
    labels = bills(spark, d).select("doc_id").join(F.broadcast(a), F.col("doc_id") % _N == F.col("ord")).select(F.expr(_LABEL).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return labels.select("label", "n", aliases.field_of_label(F.col("label")).alias("field"))


def fold_text(spark, d):
    """Names without accents."""
    return bills(spark, d).select("doc_id", answers.fold(F.concat(F.translate("consignor", "aeiou", "áèîõü"), F.lit("\ufffd"))).alias("folded"))


_SAID = """CASE doc_id % 4 WHEN 0 THEN concat('{"carrier": "', carrier, '", "n": 1}') WHEN 1 THEN concat('<think>{"carrier": 0} so</think> Here: ```json ', '{"carrier": "', carrier, '", "n": 1} ``` done')
  WHEN 2 THEN concat('Sure {here it is: {"carrier":"', carrier, '","n":1}} and {"carrier":2}') ELSE concat('no object for ', carrier) END"""


def answer_object(spark, d):
    """The message and the object of models' answers."""
    b = bills(spark, d).select("doc_id", F.expr(_SAID).alias("said"), F.expr("CASE WHEN doc_id % 5 = 0 THEN 'as I see it' END").alias("reasoning"))
    parts = "array(named_struct('type', 'text', 'text', said), named_struct('type', 'image', 'text', 'none'))"
    wrap = "to_json(named_struct('choices', array(named_struct('message', named_struct('content', {}, 'reasoning', reasoning)))))"
    b = b.withColumn("body", F.expr(f"CASE WHEN doc_id % 3 = 0 THEN {wrap.format(parts)} ELSE {wrap.format('said')} END"))
    text = b.select("doc_id", answers.message_text(F.col("body")).alias("message"))
    return text.select("doc_id", "message", answers.json_object(F.col("message")).alias("object"))


_ORD = f"array_position(array({', '.join(map(Q.lit, ORDER))}), field)"
_CHOICE = "CASE (doc_id + ord) % 5 WHEN 0 THEN value WHEN 1 THEN 'Fresh Name Co' WHEN 2 THEN '' WHEN 3 THEN carrier ELSE lower(value) END"
_STRONG = "CASE WHEN field IN ('origin', 'destination') THEN 'Tracy Strong Rd' ELSE 'Strong Reader Inc' END"


def joint_writeback(spark, d):
    """Bills after a joint choice, and what became of each field."""
    b = bills(spark, d).select("doc_id", *ORDER)
    f = long(b).join(b.select("doc_id", "carrier"), "doc_id").withColumn("ord", F.expr(_ORD))
    chosen = f.where("doc_id % 8 <> 0").select("doc_id", "field", F.expr(_CHOICE).alias("selected"))
    read = chosen.where("doc_id % 3 = 0")
    cands = read.selectExpr("doc_id", "field", "1 AS rank", f"{_STRONG} AS value", "0.97D AS fuzzy").unionByName(read.selectExpr("doc_id", "field", "2 AS rank", "selected AS value", "CASE WHEN doc_id % 2 = 0 THEN 0.5D ELSE 0.9D END AS fuzzy"))
    given = b.withColumns({c: F.when(F.col("doc_id") % 7 == ORDER.index(c), "ADDRESS").otherwise(F.col(c)) for c in ("consignor", "origin", "driver_name")})
    return E.apply_joint(given, chosen, cands)


_VALUE = "CASE WHEN doc_id % 9 = 0 THEN 'n/a' WHEN doc_id % 9 = 1 THEN 'ADDRESS' WHEN doc_id % 9 = 2 THEN 'Abc' WHEN doc_id % 5 = 0 THEN carrier WHEN field = 'destination' AND doc_id % 4 = 0 THEN origin ELSE value END"
_SIGNAL = """doc_id, field, {} AS value, carrier, origin, CASE WHEN doc_id % 10 <> 0 THEN doc_id % 101 / 100.0D END AS conf, doc_id % 5 / 4.0D AS raw, doc_id % 7 / 8.0D AS calibrated, doc_id % 3 = 0 AS fitted,
  CASE WHEN doc_id % 6 = 0 THEN 0.5D END AS least, doc_id % 2 = 0 AS known, doc_id % 13 = 0 AS near_miss""".format(_VALUE)


def confidence_signal(spark, d):
    """The confidence of each field that a second reading goes by, and whether its value is strong."""
    b = bills(spark, d)
    f = long(b).join(b.select("doc_id", "carrier", "origin"), "doc_id")
    return E.confidence_signal(f.selectExpr(*_split(_SIGNAL)))


def _split(select: str) -> list[str]:
    """The items of a select list whose commas are all on the top level but for calls and lists."""
    out, depth, at = [], 0, 0
    for i, ch in enumerate(select):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(select[at:i])
            at = i + 1
    return [*out, select[at:]]


def kept_predictions(spark, d):
    """Predictions as they are kept from before reviews."""
    b = bills(spark, d)
    stored = long(b.where("doc_id % 3 = 0")).selectExpr("doc_id", "field", "'old' AS value", "0.5D AS confidence")
    return E.predictions(stored, long(b).join(b.select("doc_id", "reviewed"), "doc_id").withColumn("confidence", F.expr("doc_id % 1000 / 1000.0D")))


_STATUS = "CASE doc_id % 7 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'review' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'PENDING' WHEN 4 THEN 'Processing' WHEN 5 THEN 'ARCHIVED' END"


def status_tiles(spark, d):
    """Documents by the tile that shows them."""
    return bills(spark, d).groupBy(E.tile(F.expr(_STATUS)).alias("tile")).agg(F.count("*").alias("n"))


_W = ["Missing critical field: origin", "Low overall confidence 0.61", "Freight amount exceeds total", "Line item sum 9 off", "Check the date"]
_FOUND = [("FREIGHT_EXCEEDS_TOTAL", "error"), ("LINE_ITEM_SUM_MISMATCH", "error"), ("NEGATIVE_VALUE", "error"), ("DUPLICATE_TAG", "warning"), ("INVALID_DATE", "warning")]
_WHEN_W, _WHEN_F = [2, 3, 4, 5, 7], [3, 2, 5, 4, 7]


def review_reasons(spark, d):
    """Why bills in review are there."""
    b = bills(spark, d).select("doc_id", F.expr("CASE WHEN doc_id % 11 = 0 THEN 'COMPLETED' ELSE 'review' END").alias("status"))
    w = F.array_compact(F.array(*[F.when(F.col("doc_id") % k == 0, t) for k, t in zip(_WHEN_W, _W)]))
    found = F.array_compact(F.array(*[F.when(F.col("doc_id") % k == 1, F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"))) for k, (c, s) in zip(_WHEN_F, _FOUND)]))
    b = b.select("doc_id", E.review_reasons(F.col("status"), w, F.col("doc_id") % 3, found).alias("r"))
    return b.select("doc_id", F.array_join(F.transform("r", lambda x: F.concat_ws("=", x["key"], x["text"])), "|").alias("reasons"))


_SOURCES = [["ocr", "ocr_text"], ["prior"], ["gazetteer", "prior"], [], ["alias", "OCR_TEXT", "llm"], ["llm"]]


def evidence_labels(spark, d):
    """How fields, sources and relations are shown, and which candidates may be chosen."""
    f = long(bills(spark, d))
    k = F.array(*[F.array(*map(F.lit, s)).cast("array<string>") for s in _SOURCES])
    sources = F.get(k, (F.col("doc_id") % len(_SOURCES)).cast("int"))
    f = f.select(E.field_label(F.col("field")).alias("label"), E.source_label(sources).alias("sources"), E.relation_label(F.concat(F.lit("consignor+"), F.col("field"), F.lit("→carrier"))).alias("relation"), E.selectable(F.expr("CASE WHEN doc_id % 4 = 0 THEN ' — ' ELSE value END"), sources).alias("selectable"))
    return f.groupBy("label", "sources", "relation", "selectable").agg(F.count("*").alias("n"))


def history_support(spark, d):
    """What history says of the carriers of bills."""
    b = bills(spark, d).selectExpr(
        "doc_id", "carrier", "array(named_struct('value', upper(carrier), 'prior_count', doc_id % 3, 'prior_probability', 0.25D), named_struct('value', 'Other', 'prior_count', 9L, 'prior_probability', 0.5D), named_struct('value', carrier, 'prior_count', doc_id % 2, 'prior_probability', 0.75D)) AS c",
        "array(named_struct('relation', 'consignor+consignee→carrier', 'given', array(consignor, ''), 'target', CASE WHEN doc_id % 4 <> 0 THEN carrier END, 'count', doc_id % 5, 'probability', 0.5D)) AS r",
        "array(named_struct('relation', 'consignor→carrier', 'usual', CASE WHEN doc_id % 6 = 0 THEN 'Zed Lines' ELSE '' END, 'usual_count', 7L, 'usual_prob', 0.875D)) AS f",
    )
    return b.select("doc_id", F.inline(E.history_support(F.col("carrier"), F.col("c"), F.col("r"), F.col("f"))))


_RELATIONS = ["consignor→carrier", "consignor+consignee→carrier", "carrier→driver", "carrier+driver→destination", "route→plant"]


def field_relations(spark, d):
    """Relations of a joint choice by the field they name, and those shown as evidence for a driver."""
    r = bills(spark, d).withColumn("relation", F.get(F.array(*map(F.lit, _RELATIONS)), (F.col("doc_id") % 5).cast("int"))).withColumn("target", F.expr("CASE WHEN doc_id % 3 = 0 THEN lower(driver_name) ELSE 'x' END"))
    told = F.size(E.joint_evidence(F.lit("driver_name"), F.col("driver_name"), F.array(F.struct("relation", "target")))).alias("told")
    return E.relations_of_fields(r.select("doc_id", "relation", told), FIELDS).groupBy("field", "relation", "told").agg(F.count("*").alias("n"))


_FINDING = """CASE doc_id % 4 WHEN 0 THEN 'CONSIGNOR_EQUALS_CONSIGNEE' WHEN 1 THEN 'DUPLICATE_TAG' WHEN 2 THEN 'HISTORICAL_RELATIONSHIP_CONFLICT' ELSE 'DESTINATION_COPIED_FROM_ORIGIN' END"""
_INVOLVED = "CASE doc_id % 4 WHEN 0 THEN {0}'consignor', 'consignee', 'consignor'{1} WHEN 1 THEN {0}'line_items'{1} WHEN 2 THEN {0}'carrier'{1} ELSE {0}'origin', 'destination'{1} END"


def field_findings(spark, d):
    """Findings that ask for a second reading, by field."""
    f = bills(spark, d).select("doc_id", F.expr(_FINDING).alias("code"), F.expr(_INVOLVED.format("array(", ")")).alias("fields"))
    return E.findings_of_fields(f, E.TRIGGERS).groupBy("field", "code").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


_TEXTS = ["SHIPPER:", "Bill No. 7", "número de vehículo", "Point of Origin / Destination", "plain", "GROSS WT", "Hauler"]
_NAMED = ["consignor", "bill_number", "vehicle_number", "origin", None, "weight", "carrier"]
_ITEM = "l_orderkey AS doc_id, l_linenumber AS pos, l_quantity * 10 AS x0, l_tax * 100 AS y0, l_quantity * 10 + l_discount * 1000 AS x1, l_tax * 100 + 12 + l_linenumber * 10 AS y1"
_PAGE = "doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 400 END AS width, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 200 END AS height"


def label_regions(spark, d):
    """Where the values of labels are looked for."""
    li = table(spark, d, "lineitem").withColumn("text", F.get(F.array(*map(F.lit, _TEXTS)), (F.col("l_partkey") % 7).cast("int")))
    items = li.selectExpr("text", *_split(_ITEM)).groupBy("doc_id", "pos").agg(F.min(F.struct("text", "x0", "y0", "x1", "y1")).alias("i")).select("doc_id", "pos", "i.*")
    return E.label_regions(items, bills(spark, d).selectExpr(*_split(_PAGE)))


_FILE = "CASE WHEN doc_id % 5 = 0 THEN concat('in/scan_hard_02_', doc_id, '.png') ELSE concat('in/doc_', doc_id % 100, '.pdf') END"


def truth_by_name(spark, d):
    """Truths of files by stem, else by a mark in the name."""
    b = bills(spark, d)
    truths = b.where("doc_id < 100").selectExpr("concat('doc_', doc_id) AS stem", "carrier AS truth")
    marks = spark.createDataFrame([(0, "hard_02", "second"), (1, "hard", "any"), (2, "doc_7", "seven")], "ord int, mark string, truth string")
    return E.truth_by_name(b.select("doc_id", F.expr(_FILE).alias("name")), truths, marks)


def usable_line_items(spark, d):
    """How many line items of a bill say anything, and whether they are usable."""
    li = table(spark, d, "lineitem").selectExpr("l_orderkey AS doc_id", "named_struct('item_no', CAST(l_linenumber AS STRING), 'description', CASE l_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'N/A' ELSE 'rock' END, 'weight', CASE WHEN l_suppkey % 2 = 0 THEN ' ' ELSE CAST(l_suppkey AS STRING) END) AS i")
    n = E.line_item_count(F.collect_list("i"), ["item_no", "description", "weight"])
    return li.groupBy("doc_id").agg(n.alias("n")).withColumn("usable", F.col("n") >= 2)


def rescue_prompt(spark, d):
    """What a second reading is asked of each bill."""
    b = bills(spark, d)
    plan = b.selectExpr("doc_id", "stack(2, 'carrier', 1, carrier, array('low_confidence', 'candidate_ambiguity'), 'origin', 2, CASE WHEN doc_id % 2 = 0 THEN 'N/A' ELSE origin END, array('missing_field')) AS (field, rank, value, reasons)")
    cands = b.where("doc_id % 3 <> 0").selectExpr("doc_id", "'carrier' AS field", "stack(3, 1, upper(carrier), 0.95D, 3L, array('ocr', 'prior'), 2, 'Zed Lines', CAST(NULL AS DOUBLE), 0L, array('alias'), 3, 'unknown', 0.5D, 1L, array('ocr')) AS (rank, value, fuzzy, prior_count, sources)")
    conflicts = b.where("doc_id % 5 = 0").selectExpr("doc_id", "'carrier' AS field", "'Zed Lines' AS usual", "4L AS usual_count")
    rel = b.where("doc_id % 4 = 0").selectExpr("doc_id", "'origin' AS field", "stack(2, 2, 'b→origin', 'no', 1, 'consignor→origin', destination) AS (rank, relation, target)")
    return E.rescue_prompt(plan, cands, conflicts, rel)


QUERIES = {f.__name__: f for f in (label_field, fold_text, answer_object, joint_writeback, confidence_signal, kept_predictions, status_tiles, review_reasons, evidence_labels, history_support, field_relations, field_findings, label_regions, truth_by_name, usable_line_items, rescue_prompt)}

_L = f"f AS (SELECT b.*, u.field, u.ord, CASE u.field {' '.join(f'WHEN {Q.lit(c)} THEN b.{c}' for c in FIELDS)} END AS value FROM bills b, {Q.values([(c, ORDER.index(c) + 1) for c in FIELDS], 'field, ord').replace(' AS v(', ' AS u(')})"
_KEY = Q.key
_CORE = lambda x: _KEY(f"regexp_replace(coalesce({x}, ''), '(?i)\\b(ca|california)\\b', '', 'g')")
_KNOWN = ", ".join(map(Q.lit, E._CARRIERS))


def _head(v: str, carrier: str = "carrier") -> str:
    return f"({_KEY(v)} <> '' AND ({_KEY(v)} IN ({_KNOWN}) OR {_KEY(v)} = {_KEY(carrier)}))"


def _learnable(v: str) -> str:
    return f"(NOT {Q.is_junk(v)} AND length({Q.letters(v)}) >= 3 AND NOT regexp_matches({v}, '[^\\w\\s.&,''/#-]'))"


def _writeback() -> str:
    """Each field by itself: no case of the query hangs on an origin written before."""
    steps = []
    for i, f in enumerate(ORDER):
        old = f"CASE WHEN doc_id % 7 = {i} THEN 'ADDRESS' ELSE {f} END" if f in ("consignor", "origin", "driver_name") else f
        steps.append(f"SELECT doc_id, {i} AS i, {old} AS old, {_CHOICE.replace('ord', str(i + 1)).replace('value', f)} AS new, carrier FROM bills")
    head = lambda v: f"(i < 2 AND {_head(v)})"
    status = f"""CASE WHEN doc_id % 8 = 0 THEN NULL WHEN {head('new')} THEN 'rejected_letterhead' WHEN new = '' OR NOT {_learnable('new')} THEN CASE WHEN NOT {_learnable('old')} THEN 'rejected_junk' END
      WHEN i <> 4 AND doc_id % 6 = 0 THEN 'ocr_guard' WHEN i = 4 AND doc_id % 6 = 0 THEN 'ocr_guard' WHEN {_KEY('old')} = {_KEY('new')} THEN 'unchanged' ELSE 'applied' END"""
    parts = ", ".join(f"max(val) FILTER (i = {i}) AS {f}, max(status) FILTER (i = {i}) AS {f}_status" for i, f in enumerate(ORDER))
    return f"""WITH {BILLS_SQL}, s AS ({' UNION ALL '.join(steps)}), t AS (SELECT *, {status} AS status FROM s),
      w AS (SELECT *, CASE WHEN status = 'applied' THEN new WHEN status = 'rejected_junk' OR (status = 'rejected_letterhead' AND {head('old')}) THEN NULL ELSE old END AS val FROM t),
      p AS (SELECT doc_id, {parts} FROM w GROUP BY doc_id)
      SELECT * REPLACE ({', '.join(f"CASE WHEN doc_id % 8 <> 0 AND {_head(f)} THEN NULL ELSE {f} END AS {f}" for f in E.LETTERHEAD)}) FROM p"""


def _strong() -> str:
    o, v = _CORE("origin"), _CORE("value")
    copied = f"(field = 'destination' AND {v} <> '' AND ({o} = {v} OR (contains({o}, {v}) AND length({v}) >= 6)))"
    poor = f"CASE WHEN field IN ('consignor', 'consignee', 'driver_name') THEN length({Q.letters('value')}) < 6 ELSE length({Q.letters('value')}) < 5 OR NOT (known OR regexp_matches(value, '\\b\\d{{5}}\\b') OR regexp_matches(value, '{E.PLACE_WORDS}')) END"
    weak = f"(field <> 'carrier' AND (NOT {_learnable('value')} OR {poor}))"
    head = f"(field IN ('consignor', 'consignee') AND {_head('value')})"
    return f"lower(trim(value)) NOT IN ('', 'none', 'null', 'n/a', 'unknown', '—') AND used >= greatest(threshold, 0.8) AND NOT ({weak} OR {head} OR {Q.is_junk('value')} OR near_miss OR {copied})"


_SQL_DOUBLE = _SIGNAL.replace("0.0D", "0.0::DOUBLE").replace("4.0D", "4.0::DOUBLE").replace("8.0D", "8.0::DOUBLE").replace("0.5D", "0.5::DOUBLE")
_NL = "chr(10)"
_LINES = lambda *xs: f" || {_NL} || ".join(xs)
_TELLS = [["consignor", "carrier"], ["consignor", "consignee", "carrier"], ["carrier", "driver_name"], ["carrier", "driver_name", "destination"], []]
_LABELLED = {"carrier": "Carrier", "consignor": "Consignor", "consignee": "Consignee", "driver_name": "Driver Name", "origin": "Origin", "destination": "Destination"}

ORACLES = {
    "label_field": f"""WITH {BILLS_SQL}, a AS (SELECT * FROM {Q.values(aliases.ALIAS_ROWS, 'alias, field, ord')}), said AS (SELECT {_LABEL} AS label, count(*) AS n FROM bills JOIN a ON doc_id % {_N} = ord GROUP BY ALL),
      k AS (SELECT *, trim(regexp_replace(lower(trim(label)), '[^a-z0-9_]+', '_', 'g'), '_') AS key FROM said)
      SELECT label, n, CASE WHEN key = '' THEN NULL WHEN key IN ({', '.join(map(Q.lit, S.SCHEMA_FIELDS))}) THEN key ELSE coalesce(arg_min(field, ord) FILTER (alias = key), arg_min(field, ord) FILTER (contains(key, alias) OR contains(alias, key))) END AS field
      FROM k, a GROUP BY label, n, key""",
    "fold_text": f"WITH {BILLS_SQL} SELECT doc_id, strip_accents(translate(consignor, 'aeiou', 'áèîõü')) AS folded FROM bills",
    "answer_object": f"""WITH {BILLS_SQL} SELECT doc_id, {_SAID} || CASE WHEN doc_id % 5 = 0 THEN {_NL} || 'as I see it' ELSE '' END AS message, CASE WHEN doc_id % 4 < 3 THEN '{{"carrier":"' || carrier || '","n":1}}' END AS object FROM bills""",
    "joint_writeback": _writeback(),
    "confidence_signal": f"""WITH {BILLS_SQL}, {_L}, s AS (SELECT {_SQL_DOUBLE} FROM f), h AS (SELECT *, coalesce(conf, raw) AS heuristic FROM s), c AS (SELECT * REPLACE (CASE WHEN calibrated = 0 THEN heuristic ELSE calibrated END AS calibrated) FROM h),
      u AS (SELECT *, CASE WHEN fitted THEN calibrated ELSE heuristic END AS used, coalesce(least, 0.7)::DOUBLE AS threshold FROM c) SELECT doc_id, field, heuristic, calibrated, used, threshold, {_strong()} AS strong FROM u""",
    "kept_predictions": f"WITH {BILLS_SQL}, {_L} SELECT doc_id, field, CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE value END AS value, CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE doc_id % 1000 / 1000.0 END::DOUBLE AS confidence FROM f WHERE doc_id % 3 = 0 OR NOT reviewed",
    "status_tiles": f"WITH {BILLS_SQL} SELECT CASE doc_id % 7 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'REVIEW' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'PENDING' WHEN 4 THEN 'PENDING' END AS tile, count(*) AS n FROM bills GROUP BY ALL",
    "review_reasons": f"""WITH {BILLS_SQL}, e AS (SELECT doc_id, (CASE WHEN doc_id % 3 = 1 AND doc_id % 4 <> 0 THEN 1 ELSE 0 END) + (CASE WHEN doc_id % 2 = 1 AND doc_id % 5 <> 0 THEN 1 ELSE 0 END) + (CASE WHEN doc_id % 5 = 1 THEN 1 ELSE 0 END) AS errors,
        (CASE WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END) + (CASE WHEN doc_id % 7 = 1 THEN 1 ELSE 0 END) AS warned,
        list_filter([CASE WHEN doc_id % 4 = 0 THEN {Q.lit(_W[2])} END, CASE WHEN doc_id % 5 = 0 THEN {Q.lit(_W[3])} END, CASE WHEN doc_id % 7 = 0 THEN {Q.lit(_W[4])} END], lambda w: w IS NOT NULL) AS rest FROM bills),
      r AS (SELECT *, list_concat([CASE WHEN doc_id % 2 = 0 THEN 'missing=' || {Q.lit(_W[0])} END, CASE WHEN doc_id % 3 = 0 THEN 'overall=' || {Q.lit(_W[1])} END,
        CASE doc_id % 3 WHEN 1 THEN 'autopost=1 field below auto-post threshold' WHEN 2 THEN 'autopost=2 fields below auto-post threshold' END,
        CASE WHEN errors = 1 THEN 'consistency-error=1 consistency error' WHEN errors > 1 THEN 'consistency-error=' || errors || ' consistency errors' END,
        CASE WHEN warned = 1 THEN 'consistency-warning=1 consistency warning' WHEN warned > 1 THEN 'consistency-warning=' || warned || ' consistency warnings' END],
        list_transform(rest, lambda w, i: 'validate-' || (i - 1) || '=' || w)) AS all_ FROM e)
      SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE coalesce(array_to_string(list_filter(all_, lambda x: x IS NOT NULL), '|'), '') END AS reasons FROM r""",
    "evidence_labels": f"""WITH {BILLS_SQL}, {_L} SELECT label, CASE doc_id % 6 WHEN 0 THEN 'OCR' WHEN 1 THEN 'Prior' WHEN 2 THEN 'Gazetteer' WHEN 3 THEN 'Evidence' WHEN 4 THEN 'Alias · OCR · llm' ELSE 'llm' END AS sources, 'consignor + ' || f.field || ' → carrier' AS relation,
      doc_id % 4 <> 0 AND doc_id % 6 NOT IN (3, 5) AS selectable, count(*) AS n FROM f JOIN {Q.values(list(_LABELLED.items()), 'field, label')} ON f.field = v.field GROUP BY ALL""",
    "history_support": f"""WITH {BILLS_SQL},
      c AS (SELECT doc_id, 'candidate' AS kind, n || CASE WHEN n = 1 THEN ' historical ticket used “' ELSE ' historical tickets used “' END || v || '”' AS text, NULL::BIGINT AS count, p::DOUBLE AS probability
        FROM (SELECT doc_id, doc_id % 3 AS n, upper(carrier) AS v, 0.25 AS p FROM bills UNION ALL SELECT doc_id, doc_id % 2, carrier, 0.75 FROM bills) WHERE n > 0)
      SELECT * FROM c UNION ALL SELECT doc_id, 'relation', CASE WHEN doc_id % 4 = 0 THEN 'consignor + consignee → carrier' ELSE consignor || ' → ' || carrier END, doc_id % 5, 0.5 FROM bills WHERE doc_id % 5 <> 0
      UNION ALL SELECT doc_id, 'conflict', 'Historical consignor → carrier usually uses “Zed Lines”', 7, 0.875 FROM bills WHERE doc_id % 6 = 0""",
    "field_relations": f"""WITH {BILLS_SQL}, r AS (SELECT r.relation, r.field, CASE WHEN doc_id % 5 IN (2, 4) OR doc_id % 3 = 0 THEN 1 ELSE 0 END::INTEGER AS told FROM bills JOIN {Q.values([(i, _RELATIONS[i], f) for i, fs in enumerate(_TELLS) for f in fs], 'k, relation, field').replace(' AS v(', ' AS r(')} ON doc_id % 5 = r.k)
      SELECT field, relation, told, count(*) AS n FROM r GROUP BY ALL""",
    "field_findings": f"""WITH {BILLS_SQL}, r AS (SELECT doc_id, {_FINDING} AS code, unnest(list_distinct({_INVOLVED.format('[', ']')})) AS field FROM bills) SELECT field, code, count(*) AS n, min(doc_id) AS first FROM r WHERE code <> 'DUPLICATE_TAG' GROUP BY ALL""",
    "label_regions": f"""WITH {BILLS_SQL}, raw AS (SELECT [{', '.join(map(Q.lit, _TEXTS))}][l_partkey % 7 + 1] AS text, {_ITEM} FROM lineitem), i AS (SELECT doc_id, pos, unnest(min(struct_pack(text, x0, y0, x1, y1))) FROM raw GROUP BY doc_id, pos),
      n AS (SELECT i.*, m.field FROM i JOIN {Q.values([(t, f) for t, f in zip(_TEXTS, _NAMED) if f], 'text, field').replace(' AS v(', ' AS m(')} ON i.text = m.text),
      g AS (SELECT *, {_PAGE} FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY pos) = 1)),
      z AS (SELECT *, round((x1 + greatest(x1 - x0, 80))::DOUBLE, 1) AS r, round((y1 + greatest((y1 - y0) * 4, 180))::DOUBLE, 1) AS b FROM g)
      SELECT doc_id, field, text AS label, round(x0::DOUBLE, 1) AS x0, round(y0::DOUBLE, 1) AS y0, CASE WHEN width > 0 THEN least(r, width) ELSE r END AS x1, CASE WHEN height > 0 THEN least(b, height) ELSE b END AS y1 FROM z""",
    "truth_by_name": f"""WITH {BILLS_SQL} SELECT b.doc_id, {_FILE.replace('doc_id', 'b.doc_id')} AS name, CASE WHEN b.doc_id % 5 = 0 THEN 'second' ELSE coalesce(t.carrier, CASE WHEN 'doc_' || (b.doc_id % 100) LIKE 'doc_7%' THEN 'seven' END) END AS truth FROM bills b LEFT JOIN (SELECT * FROM bills WHERE doc_id < 100) t ON b.doc_id % 100 = t.doc_id""",
    "usable_line_items": "SELECT l_orderkey AS doc_id, CAST(count(*) FILTER (l_partkey % 3 = 2 OR l_suppkey % 2 = 1) AS INTEGER) AS n, count(*) FILTER (l_partkey % 3 = 2 OR l_suppkey % 2 = 1) >= 2 AS usable FROM lineitem GROUP BY l_orderkey",
    "rescue_prompt": f"""WITH {BILLS_SQL} SELECT doc_id, {_LINES("'Extract freight-bill fields from this scanned page.'", "'Focus especially on these uncertain fields: carrier, origin'", *map(Q.lit, E.ASK), "'Field: carrier'", "'Current deterministic prediction: ' || carrier", "'Why uncertain: low_confidence, candidate_ambiguity'")}
      || CASE WHEN doc_id % 3 <> 0 THEN {_NL} || {_LINES("'Top candidates:'", "'  1. ' || upper(carrier) || ' [ocr,prior] (fuzzy 0.95; prior 3)'", "'  2. Zed Lines [alias]'")} ELSE '' END
      || CASE WHEN doc_id % 5 = 0 THEN {_NL} || 'Historical evidence: usual value Zed Lines (4 tickets).' ELSE '' END
      || {_NL} || {_NL} || {_LINES("'Field: origin'", "'Current deterministic prediction: ' || CASE WHEN doc_id % 2 = 0 THEN '(empty)' ELSE origin END", "'Why uncertain: missing_field'")}
      || CASE WHEN doc_id % 4 = 0 THEN {_NL} || 'Joint-decode relation: consignor→origin → ' || destination ELSE '' END AS prompt FROM bills""",
}
