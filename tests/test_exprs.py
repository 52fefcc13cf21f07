import numpy as np
import pytest
from pyspark.sql import functions as F

from drayage.functions import exprs as X
from drayage.functions import shapes as S
from drayage.functions.fuzzy import similarity
from drayage.operators import calibrate

GOLDEN = [
    (S.clean_money, "$3450", "$3,450.00"), (S.clean_money, "3450.00", "$3,450.00"), (S.clean_money, "INVALID", None),
    (S.clean_date, "26/08/2026", "2026-08-26"), (S.clean_date, "08/26/2026", "2026-08-26"), (S.clean_date, "4", None), (S.clean_date, "2026-02-30", None),
    (S.clean_clock, "930", "9:30"), (S.clean_clock, "1020", "10:20"), (S.clean_clock, "9:05 pm", "9:05 PM"), (S.clean_clock, "000", None),
    (S.clean_weight, "27.0215:20 5:27", "27.02"), (S.clean_weight, "32,450los", "32,450 lbs"), (S.clean_weight, "14.920lbs", "14,920 lbs"), (S.clean_weight, "18,760 Ibs", "18,760 lbs"),
    (S.clean_place, "Columbus,OH", "Columbus, OH"), (X.glyph_repair, "HB-O78421", "HB-078421"), (X.glyph_repair, "28O", "280"), (X.glyph_repair, "ISAAC", "ISAAC"),
    (S.clean_identifier, "Bill No: HB-78421", "HB-78421"), (X.indic_digits, "३६", "36"), (X.collapse, "A & A, Inc.", "a&ainc"), (X.party_key, "A & A, Inc.", "aainc"),
]


@pytest.mark.parametrize("fn,given,expected", GOLDEN, ids=lambda v: getattr(v, "__name__", None))
def test_golden(spark, fn, given, expected):
    assert spark.createDataFrame([(given,)], "c string").select(fn(F.col("c"))).first()[0] == expected


def test_signed_numbers(spark):
    rows = spark.createDataFrame([("(1,200.50)",), ("$-3",), ("7",), ("x",), (None,)], "c string").select(S.signed(F.col("c"))).collect()
    assert [r[0] for r in rows] == [-1200.5, -3.0, 7.0, None, None]


def test_similarity_is_ordered(spark):
    got = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), ("", "x"), ("clean planet", "clean planet hooper")], "a string, b string").select(similarity(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [0.25, 0.5, 0.0, 0.92]


def test_pool_takes_middles():
    a, v = calibrate.pool(np.array([0.2, 0.3, 0.4, 0.5, 0.5]), np.array([0, 1, 0, 1, 0]))
    assert a.tolist() == [0.2, 0.35, 0.5] and v.tolist() == [0, 0.5, 0.5]
