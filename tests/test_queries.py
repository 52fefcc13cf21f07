"""Every query against its SQL on the small tables."""

import glob
import os

import duckdb
import pytest

from drayage.plans import registry
from drayage.sources import inbox
from drayage.streaming import ingest

DATA = "/root/testdata/sf{}"
#: Queries with rounded or divided figures, which more rows are needed for.
LARGER = ["field_candidates", "eval_field_metrics", "calibration_status"]


@pytest.fixture(scope="module")
def duck():
    out = {}
    for sf in ("0.001", "0.01"):
        c = out[sf] = duckdb.connect()
        for p in glob.glob(f"{DATA.format(sf)}/*.parquet"):
            files = f"{p}/*.parquet" if os.path.isdir(p) else p
            c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return out


@pytest.mark.parametrize("sf,name", [*(("0.001", n) for n in sorted(registry.QUERIES)), *(("0.01", n) for n in LARGER)])
def test_query(spark, duck, sf, name):
    df = registry.QUERIES[name](spark, DATA.format(sf))
    cols = sorted(df.columns)
    got = sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect())))
    assert got
    if name in registry.ORACLES:
        want = duck[sf].execute(f"SELECT {', '.join(cols)} FROM ({registry.ORACLES[name]})").fetchall()
        assert got == sorted(map(repr, want))


def test_inbox(spark, tmp_path):
    for name, raw in {"b.pdf": b"%PDF-1", "a.PDF": b"%PDF-1", "c.pdf": b"nope", "b.png": b"x", "temp_1.pdf": b"%PDF-2", "n.txt": b"y"}.items():
        (tmp_path / name).write_bytes(raw)
    rows = {r["name"]: r for r in inbox.first_arrivals(inbox.hashed(inbox.scan(spark, str(tmp_path)))).collect()}
    assert set(rows) == {"a.PDF", "b.pdf", "c.pdf"}
    assert not rows["a.PDF"]["duplicate"] and rows["b.pdf"]["duplicate"] and not rows["c.pdf"]["valid"]


def test_stream_takes_in_once(spark, tmp_path):
    box, out, ck = (str(tmp_path / p) for p in ("box", "out", "ck"))
    os.mkdir(box)
    for turn, name in enumerate(("a.pdf", "b.pdf")):
        with open(f"{box}/{name}", "wb") as f:
            f.write(b"%PDF same")
        ingest.ingest(spark, box, out, ck)
        assert spark.read.parquet(out).count() == 1, turn
