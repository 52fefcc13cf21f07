"""Vectors that say what single values, tickets and pages become."""

from pyspark.sql import functions as F

from drayage.functions import seeds
from drayage.functions import shapes as S
from drayage.operators import checks as C
from drayage.operators import decisions as D
from drayage.operators import extract as X
from drayage.operators import layout as L
from drayage.operators import matching as M

VALUES = [
    *[(S.clean_text, v, None) for v in ("Handwritten", "NO", "ADDRESS", "SUB-HAUL#", "MHOURS")],
    (S.clean_identifier, "Vehicle #: UP-32-T-5821", "UP-32-T-5821"), (S.clean_identifier, "एफबी-१०२३६", "FB-10236"), (S.clean_identifier, "आईएनवी-६२१", "INV-621"),
    (S.clean_date, "MO. 2 DAY 2 YR. 26", "2026-02-02"), (S.clean_date, "DBTRSETWSBLBMD", None), (S.boxed_date, "JOB DAY 1347-3 NO. CA0385520", None), (S.boxed_date, "DATE\nMO. 4\nDAY 30\n25", "2025-04-30"),
    (S.boxed_date, "JOB DAY 11 MO. 2 DAY 2 YR. 26", "2026-02-02"), (S.clean_money, "1234.567", "$1,234,567.00"), (S.clean_place, "Dallas,Tx", "Dallas, Tx"), (S.unglue, "CALIFORNIAMATERIALS,INC.", "CALIFORNIA MATERIALS, INC."),
    *[(S.is_junk, v, True) for v in ("Qee", "RN Alo YRZ", "BElIm Ae ME", "YRZ5 Stockton Discavery Bay CA")], *[(S.is_junk, v, False) for v in ("A&A Concrete", "Discovery Bay CA")],
    (M.id_glyphs, "HB-O78421", "HB-078421"), (M.id_glyphs, "1674O-1", "16740-1"), (M.id_glyphs, "ISAAC", "ISAAC"), (S.threshold, "weight", 0.9), (S.threshold, "consignee", 0.7), (S.threshold, "bill_number", 0.8),
    (X.letterhead_carrier, "x\nCALIFORNIA MATERIALS, INC.\n", "CALIFORNIA MATERIALS, INC."), (X.truck_number, "TRUCK NO.\nMILES\n8212345\n197\n", "197"), (X.table_commodity, "a\n Dirt \n", "Dirt"), (X.import_fill, "1.TMPORT + FILL", "Import Fill"),
    (X.signature_driver, "DRIVER\nCONSIGNEE 12345\nMike Donovan", "Mike Donovan"), (S.indic_script, "३६", True), (S.sparse, "x" * 39, True), (S.person_name, "Samuel M", True),
]


def test_values(spark):
    rows = spark.createDataFrame([tuple(given for _, given, _ in VALUES)], ", ".join(f"c{n} string" for n in range(len(VALUES))))
    got = rows.select(*[fn(F.col(f"c{n}")) for n, (fn, *_) in enumerate(VALUES)]).first()
    assert [(VALUES[n][0].__name__, VALUES[n][1], v) for n, v in enumerate(got)] == [(fn.__name__, given, want) for fn, given, want in VALUES]


def test_tickets(spark):
    text = "684755 12.85 930 1020 1025 1030"
    df = spark.createDataFrame([(text,)], "t string").select(X.load_rows(F.col("t")).alias("r"), X.cargo_line(F.lit("1 x 4 Rock\n684755 27.0215:20 5:27")).alias("c"), X.route(F.lit("POINT OF ORIGIN POINT OF DESTINATION\nYR. 26\nBell Marine\nTracy\nTract 5\nCOMMODITY")).alias("p"))
    r = df.select("*", X.load_summary(F.col("r")).alias("s")).first()
    assert (r.r[0].tag, r.r[0].weight, r.s.pickup_time, r.s.delivery_time) == ("684755", "12.85", "9:30", "10:30")
    assert (r.c.weight, r.c.quantity, r.c.commodity, r.c.delivery_time) == ("27.02", "1", "1 x 4 Rock", "5:27") and (r.p.origin, r.p.destination) == ("Bell Marine", "Tracy Tract 5")


def _tables(spark):
    return (
        spark.createDataFrame(seeds.NAME_ROWS, "field string, ord int, name string"), spark.createDataFrame(seeds.ALIAS_ROWS, "field string, alias_key string, canonical string"), spark.createDataFrame(seeds.ZIPS, "zip string, city string, state string"),
        spark.createDataFrame(seeds.ZIP_STREETS, "zip string, street string, ord int"), spark.createDataFrame(seeds.CITY_STREETS, "city string, street string, ord int"),
    )


def test_gazetteer(spark):
    names = spark.createDataFrame([("a", 0, "Clean Planet"), ("b", 0, "A&A Concrete"), ("b", 1, "AA Concrete"), ("c", 0, "Clean Planet"), ("d", 0, "Discovery Bay"), ("d", 1, "Tracy, CA"), ("e", 0, "Stockton, CA"), ("e", 1, "Stockton N. Hopper St")], "field string, ord int, name string")
    given = [("1", "a", "CleanPlanet"), ("2", "b", "A9A Concrete"), ("3", "c", "Clean Planet Hooper"), ("4", "d", "Discavery Bay"), ("5", "e", "STOCKTON"), ("6", "a", "12345"), ("7", "d", "")]
    got = {r.id: r.match for r in M.gazetteer_match(spark.createDataFrame(given, "id string, field string, value string"), names).collect()}
    assert got == {"1": "Clean Planet", "2": "A&A Concrete", "3": None, "4": "Discovery Bay", "5": "Stockton, CA", "6": None, "7": None}


def test_entity_matching(spark):
    rows = [(1, "1674O-1", "CleanPlanet", "Aquamarine", "StocktonCA", "Tracy, CA", "Zed"), (2, "HB-1", "Zed", "CORONE & CO", "95213", "95336", "Zed"), (3, "HB-2", "Bell Marine", "A&A Concrete", "N Hooper St 95213", "Tracy, CA", "Zed")]
    b = spark.createDataFrame(rows, "id long, bill_number string, consignor string, consignee string, origin string, destination string, carrier string")
    got = {r.id: r for r in M.apply_entity_matching(b, *_tables(spark)).collect()}
    assert (got[1].bill_number, got[1].consignor, got[1].origin) == ("16740-1", "Clean Planet Hooper", "Stockton, CA")
    assert (got[2].origin, got[2].destination, got[2].consignor) == ("Stockton, CA 95213", "Manteca, CA 95336", None)
    assert got[3].origin.endswith("Hooper St, Stockton, CA 95213") or got[3].origin.endswith("Hooper St., Stockton, CA 95213")


def test_findings(spark):
    item = "struct<quantity:string,rate:string,amount:string,tag:string>"
    schema = f"id int, consignor string, consignee string, origin string, destination string, freight_amount string, total_amount string, weight string, line_items array<{item}>, origin_state string, destination_state string, peer long"
    rows = [
        (1, "A", "a", None, None, "1,200", "950", "-12.5", [], None, None, None), (2, "A", "B", "Stockton, CA 95213", "Dallas, TX", None, "3,450", "1", [("2", "10", "50", "684755"), (None, None, "6,000", "684755")], "CA", "TX", 9),
        (3, "A", "B", "North Hooper", "Stockton", None, None, None, None, None, None, None), (4, "A", "B", "North Hooper", "Discovery Bay", "$1", "$2", "3", [("2", "10", "20", "x")], None, None, None),
    ]
    got = {r.id: [f.code for f in r.findings] for r in C.findings(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == ["CONSIGNOR_EQUALS_CONSIGNEE", "FREIGHT_EXCEEDS_TOTAL", "NEGATIVE_VALUE"]
    assert got[2] == ["LINE_ITEM_QTY_RATE_AMOUNT_MISMATCH", "LINE_ITEM_SUM_MISMATCH", "ORIGIN_DESTINATION_STATE_MISMATCH", "DUPLICATE_TAG", "DUPLICATE_TAG_DATE"]
    assert got[3] == ["DESTINATION_COPIED_FROM_ORIGIN"] and got[4] == ["LINE_ITEM_SUM_MISMATCH"]


def test_line_items(spark):
    item = "struct<item_no:string,description:string,quantity:string,rate:string,amount:string,tag:string,weight:string,load_arrive:string,load_depart:string,unload_arrive:string,unload_depart:string>"
    rows = [([(None, "Gravel", "2", "10", "20.5", None, None, None, None, None, None), (None, "ADDRESS", None, None, None, None, None, None, None, None, None), (None, None, None, None, None, "684755", "12.85", "930", None, None, None)],)]
    r = spark.createDataFrame(rows, f"i array<{item}>").select(C.clean_items(F.col("i")).alias("c"), C.usable_items(F.col("i")).alias("n")).first()
    assert [(x.item_no, x.description, x.amount, x.load_arrive) for x in r.c] == [("1", "Gravel", "$20.50", None), ("2", None, None, "9:30")] and r.n == 3


def test_validation(spark):
    full = ("HB-1", "Acme Sand", "Borax Gravel", "Tracy, CA", "Lodi, CA", "$10.00", "$12.00")
    rows = [(1, *full, 0.9, False, None), (2, *full, 0.5, False, None), (3, *full[:5], None, None, 0.9, True, None), (4, *full[:1], None, *full[2:], 0.9, True, None), (5, *full, 0.9, False, 13.0)]
    df = spark.createDataFrame(rows, "id int, bill_number string, consignor string, consignee string, origin string, destination string, freight_amount string, total_amount string, overall double, reviewed boolean, line_sum double")
    got = {r.id: (r.status, r.warnings, r.overall) for r in C.validate(df).collect()}
    assert got[1] == ("COMPLETED", [], 0.9) and got[2] == ("REVIEW", ["Low overall confidence (50.0%)"], 0.5)
    assert got[3] == ("COMPLETED", ["Missing critical field(s): freight_amount, total_amount"], 0.95) and got[4][0] == "REVIEW"
    assert got[5][1] == ["Line item sum ($13.00) mismatches total amount ($12.00)"]


def test_layouts(spark):
    standard = "FREIGHT BILL\nBill No HB-1 Shipper Consignor Acme Consignee Borax Carrier Zed Origin Tracy Destination Lodi " + "freight words printed on the form " * 12
    invoice = "INVOICE\nInvoice Number 7 Invoice Date 1/2/2025 Bill To Acme Subtotal 5 Amount Due 6 " + "words that are printed on it " * 12
    pages = spark.createDataFrame([("s", standard, 1, "native"), ("i", invoice, 1, "native"), ("h", "Mi ke", 1, "preprocessed_image"), ("u", "plain words " * 40, 1, "native")], "id string, text string, pages int, source string")
    none = spark.createDataFrame([], "id string, text string, cx double, cy double, x1 double, y1 double")
    got = {r.id: r for r in L.classify(pages, none).collect()}
    assert {k: r.layout_class for k, r in got.items()} == {"s": "standard_freight_bill", "i": "invoice_style", "h": "handwritten_heavy", "u": "unknown"} and 0.55 <= got["s"].confidence <= 0.95
    boxes = [("t", "item", 100.0 * c + 50, 40.0 * r + 20, 100.0 * c + 90, 40.0 * r + 30) for c in range(4) for r in range(5)]
    table = L.classify(spark.createDataFrame([("t", "quantity description rate amount " + "words " * 60, 1, "native")], "id string, text string, pages int, source string"), spark.createDataFrame(boxes, none.schema)).first()
    assert table.layout_class == "table_heavy" and {"table_headers", "table_structure"} <= set(table.evidence)


def test_label_outcomes(spark):
    rows = [("CALIFORNIA MATERIALS, INC.", "California Materials, Inc."), ("Mike Gordon", ""), (None, "x"), ("a", "b")]
    assert [r[0] for r in spark.createDataFrame(rows, "p string, g string").select(D.label_outcome(F.col("p"), F.col("g"))).collect()] == [1, 0, None, 0]


def test_picks(spark):
    rows = [("CMa+", "California Materials"), ("NO", "Acme Sand"), ("Clean", "Clean Planet"), ("Acme Sand", None), ("Acme Sand Company", "Acme")]
    got = [r[0] for r in spark.createDataFrame(rows, "s string, t string").select(X.pick_value("consignor", F.col("s"), F.col("t"))).collect()]
    assert got == ["California Materials", "Acme Sand", "Clean Planet", "Acme Sand", "Acme Sand Company"]
    a, b = (spark.createDataFrame(r, "id int, x string, y string") for r in ([(1, "", "k")], [(1, "n", "m")]))
    assert [tuple(r) for r in X.fill_gaps(a, b, ["x", "y"]).collect()] == [(1, "n", "k")]
