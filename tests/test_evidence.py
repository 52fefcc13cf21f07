"""Vectors for evidence: labels, answers, joint choices, review reasons."""

import json

from pyspark.sql import functions as F

from drayage.functions import aliases, answers
from drayage.operators import evidence as E
from drayage.operators.resolve import ORDER


def _each(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_labels(spark):
    given = ["Shipper Name:", "BILL NO", "Gross Weight (lbs)", "total_amount", "", None, "zzz", "Invoice Number #", "no", "Remitente"]
    assert _each(spark, aliases.field_of_label, given) == ["consignor", "bill_number", "weight", "total_amount", None, None, None, "invoice_number", "bill_number", "consignor"]


def test_objects(spark):
    given = ['{"a": 1}', '```json\n{"a": {"b": "}"}}\n```', '<think>{"x":1}</think> {"a": "\\"{"}', "[1, 2]", '[{"a": 2}]', "{broken {\"a\": 3} tail", "", None, "{{{", '{"a": "é"}']
    got = _each(spark, answers.json_object, given)
    assert [x and json.loads(x) for x in got] == [{"a": 1}, {"a": {"b": "}"}}, {"a": '"{'}, None, {"a": 2}, {"a": 3}, None, None, None, {"a": "é"}]


def test_messages(spark):
    body = lambda **m: json.dumps({"choices": [{"message": m}]})
    given = [body(content="x", reasoning="y", reasoning_content="z"), body(content=[{"type": "text", "text": "p"}, "q", {"type": "image"}, {"type": "output_text"}]), body(content=None, reasoning="r"), "{}", '{"choices": []}', "no json", None, body(content="[1]")]
    assert _each(spark, answers.message_text, given) == ["x\ny\nz", "p\nq\n", "r", "", "", "", "", "[1]"]


def test_fold(spark):
    assert _each(spark, answers.fold, ["Número�", "ﬁn", "एफबी", None, "plain"]) == ["Numero", "fin", "एफबी", "", "plain"]


def test_joint_writeback(spark):
    old = {"consignor": "Summit Line", "consignee": "ADDRESS", "origin": "Tracy, CA", "destination": "Reno", "carrier": "Summit Line", "driver_name": "Mike Donovan"}
    bills = spark.createDataFrame([(i, *[old[f] for f in ORDER]) for i in (1, 2)], "doc_id int, " + ", ".join(f"{f} string" for f in ORDER))
    pick = {"consignor": "SUMMIT LINE", "consignee": "", "origin": "Stockton, CA", "destination": "Discovery Bay", "carrier": "Summit-Line", "driver_name": "Sam Malone"}
    chosen = spark.createDataFrame([(1, f, v) for f, v in pick.items()], "doc_id int, field string, selected string")
    cands = spark.createDataFrame([(1, "driver_name", 1, "Mike Donovan", 0.95), (1, "driver_name", 2, "Sam Malone", 0.8), (1, "destination", 1, "Discovery Bay", 0.95)], "doc_id int, field string, rank int, value string, fuzzy double")
    r = {x.doc_id: x for x in E.apply_joint(bills, chosen, cands).collect()}
    assert [r[1][f"{f}_status"] for f in ORDER] == ["rejected_letterhead", "rejected_junk", "applied", "applied", "unchanged", "ocr_guard"]
    assert [r[1][f] for f in ORDER] == [None, None, "Stockton, CA", "Discovery Bay", "Summit Line", "Mike Donovan"]
    assert [r[2][f] for f in ORDER] == [old[f] for f in ORDER] and all(r[2][f"{f}_status"] is None for f in ORDER)


def test_reasons_hide_what_validation_says(spark):
    df = spark.createDataFrame([("REVIEW", ["Freight charge exceeds total"], 2, [("FREIGHT_EXCEEDS_TOTAL", "error"), ("NEGATIVE_VALUE", "error")]), ("COMPLETED", ["x"], 1, []), ("review", None, 0, [])], "status string, w array<string>, n int, f array<struct<code:string,severity:string>>")
    got = [[tuple(x) for x in r.r] for r in df.select(E.review_reasons(F.col("status"), F.col("w"), F.col("n"), F.col("f")).alias("r")).collect()]
    assert got == [[("autopost", "2 fields below auto-post threshold"), ("consistency-error", "1 consistency error"), ("validate-0", "Freight charge exceeds total")], [], []]


def test_predictions_are_never_reviews(spark):
    cols = "doc_id int, field string, value string, confidence double"
    stored = spark.createDataFrame([(1, "carrier", "first", 0.5)], cols)
    new = spark.createDataFrame([(1, "carrier", "later", 0.9, False), (2, "carrier", "gold", 1.0, True), (3, "carrier", "seen", 0.123456, False), (3, "notes", "x", 0.1, False)], cols + ", reviewed boolean")
    assert sorted(map(tuple, E.predictions(stored, new).collect())) == [(1, "carrier", "first", 0.5), (3, "carrier", "seen", 0.1235)]
