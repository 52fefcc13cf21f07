"""Joint choice, spatial labels, rescue and label files on small fixtures."""

from drayage.operators import priors, rescue, resolve, spatial
from drayage.sources import labels


def _found(rows):
    return [(1, f, v, s, x, c, p) for f, v, s, x, c, p in rows]


DDL = "doc_id long, field string, value string, source string, fuzzy double, prior_count long, prior_prob double"


def test_candidates_merge_by_key_and_rank(spark):
    rows = _found([("carrier", "A & B", "ocr", 0.9, None, None), ("carrier", "a&b", "prior", 0.74, 3, 1.0), ("carrier", "Zed", "ocr", 0.95, None, None), ("carrier", "--", "ocr", 1.0, None, None), ("carrier", None, "ocr", 1.0, None, None)])
    got = resolve.rank_candidates(spark.createDataFrame(rows, DDL)).orderBy("rank").collect()
    assert [(r.value, r.sources, r.score) for r in got] == [("A & B", ["ocr", "prior"], 0.95), ("Zed", ["ocr"], 0.95)]


def test_history_decides_between_equals_and_guard_keeps_strong(spark):
    past = [("S", "T", "X", "d", "o", "p")] * 3 + [("S", "U", "X", "d", "o", "p")]
    edges = priors.edges(spark.createDataFrame(past, "consignor string, consignee string, carrier string, driver_name string, origin string, destination string"), [*priors.PAIRS, *priors.TRIPLES, *priors.FULL])
    rows = _found([("consignor", "S", "ocr", 1.0, None, None), ("consignee", "U", "ocr", 0.88, None, None), ("consignee", "T", "prior", 0.88, 3, 0.75), ("origin", "o", "ocr", 1.0, None, None), ("origin", "weak", "prior", 0.5, 1, 1.0)])
    got = resolve.joint(resolve.rank_candidates(spark.createDataFrame(rows, DDL)), edges).collect()
    assert [(r.consignor, r.consignee, r.origin, r.carrier) for r in got] == [("S", "T", "o", None)]
    assert got[0].joint_score == round(1.0 + 0.88 + 0.15 * 0.75 + 0.15 * 0.75 + 1.0, 4)


def test_no_candidates(spark):
    edges = priors.edges(spark.createDataFrame([], "consignor string, consignee string, carrier string, driver_name string, origin string, destination string"), priors.PAIRS)
    assert resolve.joint(resolve.rank_candidates(spark.createDataFrame([], DDL)), edges).count() == 0


def test_rescue_actions(spark):
    rows = [
        ("Acme Inc", "Acme, Inc.", ["low_confidence"], False, "keep"), (None, "Acme Inc", None, None, "accept"), ("Acme Inc", "—", ["missing_field"], False, "keep"),
        ("Acme Inc", "Borax Co", ["low_confidence"], False, "accept"), ("Acme Inc", "Borax Co", ["low_confidence"], True, "keep_disagreement"),
        ("Acme Inc", "Borax Co", ["inconsistent_with_ticket"], True, "accept"), ("Acme Inc", "Borax Co", [], False, "keep_disagreement"), ("Acme Inc", None, ["missing_field"], False, "keep"),
    ]
    df = spark.createDataFrame([(i, "carrier", *r) for i, r in enumerate(rows)], "doc_id long, field string, previous string, answer string, reasons array<string>, strong boolean, want string")
    assert [(r.doc_id, r.want) for r in rescue.merge(df).orderBy("doc_id").collect()] == [(r.doc_id, r.action) for r in rescue.merge(df).orderBy("doc_id").collect()]


def test_values_by_place(spark):
    labels_ = spark.createDataFrame([(1, 1, "total_amount", 0.0, 0.0, 100.0, 20.0), (1, 1, "consignee", 0.0, 100.0, 100.0, 120.0), (1, 1, "pickup_time", 0.0, 400.0, 100.0, 420.0)], "doc_id long, page int, field string, x0 double, y0 double, x1 double, y1 double")
    items = spark.createDataFrame(
        [(1, 1, 0, "$5", 0.9, 120.0, 0.0, 200.0, 20.0), (1, 1, 1, "below", 0.9, 0.0, 50.0, 50.0, 70.0), (1, 1, 2, "side", 0.8, 120.0, 100.0, 200.0, 120.0), (1, 1, 3, "Bell", 0.71234, 0.0, 130.0, 60.0, 150.0), (1, 1, 4, "no time", 0.9, 120.0, 400.0, 200.0, 420.0), (1, 1, 5, "9:30", 0.9, 0.0, 440.0, 50.0, 460.0), (1, 2, 6, "else", 1.0, 101.0, 0.0, 200.0, 20.0), (1, 1, 7, None, 1.0, 101.0, 0.0, 200.0, 20.0)],
        "doc_id long, page int, pos int, text string, conf double, x0 double, y0 double, x1 double, y1 double",
    )
    got = {r.field: (r.value, r.conf) for r in spatial.values_of_labels(labels_, items).collect()}
    assert got == {"total_amount": ("$5", 0.9), "consignee": ("Bell", 0.712), "pickup_time": ("9:30", 0.9)}


def test_label_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "path": "x/y.pdf", "gold": {"carrier": "A"}}\n\nnot json\n{"pdf": "z.pdf", "carrier": "B"}\n{"id": "9"}\n')
    (tmp_path / "b.json").write_text('{"bills": [{"path": "q.pdf", "layout": "table", "consignee": "C"}]}')
    (tmp_path / "c.json").write_text('[{"path": "q.pdf", "consignee": "C"}]')
    (tmp_path / "d.csv").write_text("bill_id,path,carrier\n7,p.pdf,D\n8,,E\n")
    rows = {r.id: r for r in labels.read(spark, str(tmp_path / "a.jsonl")).collect()}
    assert rows["1"].gold == {"carrier": "A"} and rows["z"].gold == {"carrier": "B"} and rows["9"].error == "missing_path"
    assert [r.error for k, r in rows.items() if k.startswith("line-")] == ["invalid_json"]
    assert [(r.id, r.layout_class, r.gold) for r in labels.read(spark, str(tmp_path / "b.json")).collect()] == [("q", "table", {"consignee": "C"})]
    assert labels.read(spark, str(tmp_path / "c.json")).count() == 1
    assert {(r.id, r.error) for r in labels.read(spark, str(tmp_path / "d.csv")).collect()} == {("7", None), ("8", "missing_path")}


def test_outputs(spark, tmp_path):
    s = spark.createDataFrame([("carrier", 4, 3), ("origin", 2, 2), ("none", 0, 0)], "name string, n long, correct long")
    lines = [r.line for r in labels.report(s).collect()]
    assert lines[0].split() == ["origin", "2", "2", "100.0%"] and lines[-1].split() == ["none", "0", "0", "-"]
    labels.write_outputs(s, s, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out/report.txt")).count() == 3
