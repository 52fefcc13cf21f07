"""The joint choice by groups of consignors against the beam over tables and, where nothing is null or empty, SQL; and the rows that it makes on the way."""

import random

import duckdb
import pytest

from drayage.operators import priors, resolve
from drayage.operators.bills import bills
from drayage.plans import registry, resolving
from tests.test_scale import ran

COLUMNS = ["doc_id", *resolve.ORDER, "joint_score"]
NAMES = ["Acme & Co", "ACME & CO.", "Acme Cox", "Acme Co", "É Frères", "É", "--", "", None, "Straße", "Zed", "zed ", "Zedx", "A|B"]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Few suppliers and customers of odd names, which meet often; and as many of names that all differ."""
    out = {}
    for kind in ("odd", "differ"):
        r, d = random.Random(7), str(tmp_path_factory.mktemp(kind))
        name = (lambda i: r.choice(NAMES)) if kind == "odd" else (lambda i: f"Name#{i:05d}")
        few = 12 if kind == "odd" else 300
        rows = {
            "nation": ("n_nationkey INTEGER, n_name VARCHAR", [(i, n) for i, n in enumerate(["North", "NORTH ", "South", "Southx", None if kind == "odd" else "West"])]),
            "supplier": ("s_suppkey BIGINT, s_name VARCHAR, s_nationkey INTEGER", [(i, name(i), r.randrange(5)) for i in range(few)]),
            "customer": ("c_custkey BIGINT, c_name VARCHAR, c_nationkey INTEGER, c_mktsegment VARCHAR", [(i, name(i), r.randrange(5), r.choice(["Van", "VAN", "Vanx", "Ship", None if kind == "odd" else "Bus", "Rail"])) for i in range(few)]),
            "orders": ("o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority VARCHAR", [(i, r.randrange(few), r.choice("FFO"), 1.0, None, r.choice(["Ann", "ann", "Bo", "Box", "Cy", "Dé", None if kind == "odd" else "Di"])) for i in range(700)]),
            "lineitem": ("l_orderkey BIGINT, l_suppkey BIGINT, l_quantity DOUBLE, l_extendedprice DOUBLE", [(i, r.randrange(few), 1.0, 1.0) for i in range(700)]),
        }
        c = out[kind] = d, duckdb.connect()
        for t, (columns, values) in rows.items():
            c[1].execute(f"CREATE TABLE {t} ({columns})")
            c[1].executemany(f"INSERT INTO {t} VALUES ({', '.join('?' * len(values[0]))})", values)
            c[1].execute(f"COPY {t} TO '{d}/{t}.parquet' (FORMAT parquet)")
    return out


@pytest.mark.parametrize("kind", ["odd", "differ"])
def test_equal_without_a_row_for_each_question(spark, tables, kind):
    d, duck = tables[kind]
    rows, nodes = ran(registry.QUERIES["joint_decode"](spark, d))
    b = bills(spark, d)
    edges = priors.edges(b.where("reviewed"), resolving.ALL)
    want = resolve.joint(resolving._candidates(resolving._asked(b), edges), edges).select(*COLUMNS).collect()
    got = sorted(repr(tuple(r[c] for c in COLUMNS)) for r in rows)
    assert len(want) > 600 and sorted(map(repr, map(tuple, want))) == got
    if kind == "differ":
        assert sorted(map(repr, duck.execute(f"SELECT {', '.join(COLUMNS)} FROM ({registry.ORACLES['joint_decode']})").fetchall())) == got
    # a bill makes six rows at most: what it asks of history apart from its consignor
    assert max(n for name, n in nodes if "Generate" in name) <= 6 * 700
    assert not any("Window" in name and n > 700 * 3 for name, n in nodes)
