"""The most alike name against all names of its block, and what its search makes on the way."""

import random

import pytest
from pyspark.sql import functions as F

from drayage.functions import fuzzy
from drayage.plans import learning
from tests.test_scale import ran

ODD = [None, "", "A", "é", "Supplier#", "SUPPLIER#000000017", "supplier#000000017", "Spuplier#000000017", "Spuplier", "plier#000000017", "Acme Co 17", "acme co  17"]


@pytest.fixture(scope="module")
def odd(tmp_path_factory, spark):
    """Suppliers whose names differ: usual ones, short, long and empty ones, ones that hold another, errors at any place."""
    r, d = random.Random(3), str(tmp_path_factory.mktemp("odd"))
    names = [*ODD, *("Supplier#%07d17" % i for i in range(60)), *("Spxuplier#y%06d17" % i for i in range(20))]
    names += ["".join(r.choice("splieru# ") for _ in range(r.randrange(8, 30))) + "17" for _ in range(60)] + ["".join(r.choice("ab1") for _ in range(r.randrange(60, 90))) + "17" for _ in range(30)]
    keys = r.sample(range(1000), len(names))
    spark.createDataFrame([(k if i % 50 else None, n) for i, (k, n) in enumerate(zip(keys, names))], "s_suppkey long, s_name string").write.parquet(f"{d}/supplier.parquet")
    return d


@pytest.mark.parametrize("size", [7, 512])
def test_top1_is_that_of_all_pairs(spark, odd, size, monkeypatch):
    monkeypatch.setattr(learning, "NAMES", size)
    s = spark.read.parquet(f"{odd}/supplier.parquet").where("s_name IS NOT NULL").select("s_suppkey", F.col("s_name").alias("name"), F.substring("s_name", -2, 2).alias("block"))
    q = s.select(F.col("s_suppkey").alias("own"), F.concat(F.lit("Spuplier"), F.substring("name", 9, 100)).alias("query"), "block", F.col("name").alias("asks"))
    pairs = q.join(s, "block").withColumn("score", F.round(fuzzy.similarity(F.lower("query"), F.lower("name")), 4))
    want = pairs.groupBy("own", "asks").agg(F.max(F.struct("score", (-F.col("s_suppkey")).alias("less"))).alias("b")).select("own", (-F.col("b.less")).alias("match"), "b.score")
    rows, nodes = ran(learning.fuzzy_top1(spark, odd))
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, map(tuple, want.collect())))
    # lists meet, not names: no join makes a row for each pair
    assert size < 512 or max(n for name, n in nodes if "Join" in name) <= len(rows)


def test_shared_is_a_longest_subsequence():
    r = random.Random(1)
    texts = ["", "a", *("".join(r.choice("abc") for _ in range(r.randrange(1, 70))) for _ in range(30))]
    for names in (texts, [t[:64] for t in texts]):
        for a, row in zip(texts, fuzzy._shared(texts, names).tolist()):
            for b, n in zip(names, row):
                last = [0] * (len(b) + 1)
                for x in a:
                    last, was = [0], last
                    for j, y in enumerate(b):
                        last.append(was[j] + 1 if x == y else max(was[j + 1], last[j]))
                assert n == last[-1]
