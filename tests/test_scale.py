"""What queries do with tables that repeat: rows that their joins make, and how often tables are read."""

import duckdb
import pytest
from pyspark.sql import functions as F

from drayage.operators import decisions, extract, priors
from drayage.plans import registry

COPIES = 20
SHIFTED = {"customer": ["c_custkey"], "supplier": ["s_suppkey"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_suppkey"]}


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """sf0.001 so many times, with keys that are shifted and names that are not."""
    d = tmp_path_factory.mktemp("repeated")
    for t in (*SHIFTED, "nation"):
        keys = ", ".join(f"{k} + i * 1000000 AS {k}" for k in SHIFTED.get(t, []))
        duckdb.execute(f"COPY (SELECT x.*{f' REPLACE ({keys})' if keys else ''} FROM range({COPIES if keys else 1}) g(i), '/root/testdata/sf0.001/{t}.parquet' x) TO '{d}/{t}.parquet' (FORMAT parquet)")
    return str(d)


def _nodes(plan):
    yield plan
    name = plan.getClass().getSimpleName()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else []
    children = plan.children()
    for p in [*inner, *(children.apply(i) for i in range(children.size()))]:
        yield from _nodes(p)


def ran(df):
    """(name, rows out) of all that a query ran, but for what it reused."""
    rows = df.collect()
    out = []
    for p in _nodes(df._jdf.queryExecution().executedPlan()):
        m = p.metrics().get("numOutputRows")
        out.append((p.nodeName(), m.get().value() if m.isDefined() else 0))
    return rows, out


def test_alike_fields_are_ranked_once(spark, repeated):
    rows, nodes = ran(registry.QUERIES["chosen_rank"](spark, repeated))
    bills = sum(r.n for r in rows if r.field == "carrier")
    assert bills > COPIES * 1000
    assert max(n for name, n in nodes if "Join" in name) <= bills


@pytest.mark.parametrize("name", ["likely_entities", "peaked_fill"])
def test_lists_of_history_stay_behind(spark, repeated, name):
    df = registry.QUERIES[name](spark, repeated)
    assert df.columns and "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_lookup_says_where_the_list_is(spark):
    past = [("S", "T", "X", "d", "o", "p")] * 3 + [("S", "U", "Y", "d", "o", "p"), (None, "U", "Y", "d", "o", "p")]
    b = spark.createDataFrame([(i, *r) for i, r in enumerate(past)], "doc_id long, consignor string, consignee string, carrier string, driver_name string, origin string, destination string")
    edges = priors.edges(b, priors.PAIRS)
    got = decisions.look_up(b, edges, ["c_ship", "consignees"]).orderBy("doc_id").collect()
    assert [r.c_ship and (r.c_ship.n, r.c_ship.value, r.c_ship.cnt, r.c_ship.prob) for r in got] == [(2, "X", 3, 0.75)] * 4 + [None]
    said = got[0].consignees
    assert edges.where((F.col("relation") == said.relation) & (F.col("given_key") == said.given_key)).count() == said.n == 2


def test_lines_of_a_text_are_split_once(spark):
    for fn in (extract.route, extract.signature_driver):
        assert str(fn(F.col("t"))).count("split(") == 1


def test_names_are_compared_once(spark, repeated):
    rows, nodes = ran(registry.QUERIES["fuzzy_top1"](spark, repeated))
    assert len(rows) == COPIES * 10 and {r.match for r in rows} <= set(range(1000000))
    assert max(n for name, n in nodes if "Join" in name) <= len(rows)


def test_bills_alike_are_chosen_for_once(spark, repeated):
    rows, nodes = ran(registry.QUERIES["joint_decode"](spark, repeated))
    assert len({r.doc_id for r in rows}) == len(rows) > COPIES * 1000
    assert max(n for name, n in nodes if "Generate" in name) <= 6 * len(rows)
