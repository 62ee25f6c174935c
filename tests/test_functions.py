import pytest
from conftest import rows
from pyspark.sql import functions as F

from tenuria.functions import columns as C


def values(spark, data, schema, column):
    return [r[0] for r in spark.createDataFrame(data, schema).select(column).collect()]


def test_cohort_bounds(spark):
    got = values(spark, [(15,), (30,), (31,), (180,), (181,)], "t INT", C.cohort_of("t"))
    assert got == ["new_user", "new_user", "established", "established", "mature"]


def test_tier_bounds(spark):
    got = values(spark, [(799.99,), (800.0,), (4999.99,), (5000.0,)], "m DOUBLE", C.ltv_tier("m"))
    assert got == ["smb", "mid_market", "mid_market", "enterprise"]


def test_velocity(spark):
    data = [(120, 100), (80, 100), (100, 100), (50, 0), (0, 0)]
    assert values(spark, data, "a INT, b INT", C.velocity("a", "b")) == pytest.approx([0.2, -0.2, 0, 1, 0])


def test_trend_slope(spark):
    data = [(1, 2, 3, 4), (4, 3, 2, 1), (5, 5, 5, 5)]
    assert values(spark, data, "a INT, b INT, c INT, d INT", C.trend_slope(["a", "b", "c", "d"])) == [1.0, -1.0, 0.0]
    assert values(spark, [(10,)], "a INT", C.trend_slope(["a"])) == [0.0]
    assert values(spark, [(10,)], "a INT", C.trend_slope([])) == [0.0]


def test_trend_normalised(spark):
    data = [(4, 4, 1, 1), (4, 4, 0, 0)]
    got = values(spark, data, "a INT, b INT, c INT, d INT", C.trend_normalised("a", "b", "c", "d"))
    assert got == pytest.approx([6 / 11, 0.0])


def test_renewal_whole_period_and_unknown(spark):
    data = [("One year", 730), ("Month-to-month", 31), ("Two year", 1), ("Weekly", 5), (None, 5)]
    got = values(spark, data, "c STRING, t INT", C.days_to_renewal("c", "t"))
    assert got == [365, 29, 729, None, None]
    assert values(spark, data, "c STRING, t INT", C.days_to_renewal("c", "t", 730))[3:] == [725, 725]


def test_label_window_is_half_open_and_never_null(spark):
    data = [("2024-01-01",), ("2024-01-02",), ("2024-01-31",), ("2024-02-01",), (None,)]
    got = values(spark, data, "d STRING", C.churned_within(F.col("d").cast("date"), "2024-01-01", 30))
    assert got == [False, True, True, False, False]


def test_encoding_unknowns(spark):
    from tenuria.operators.training import encode_categoricals

    df = spark.createDataFrame([("mature", "enterprise", "Two year"), ("x", "x", "x"), (None, None, None)],
                               "cohort STRING, ltv_tier STRING, contract_type STRING")
    got = [(r.cohort_encoded, r.ltv_tier_encoded, r.contract_type_encoded) for r in encode_categoricals(df).collect()]
    assert got == [(2, 2, 2), (1, 0, 0), (1, 0, 0)]


def test_pearson_ignores_nan_and_constant(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0, 5.0), (2.0, 2.0, 5.0), (float("nan"), 9.0, 5.0), (None, 9.0, 5.0), (3.0, 3.0, 5.0)],
        "a DOUBLE, b DOUBLE, c DOUBLE",
    )
    got = rows(df.agg(C.pearson(F.col("a"), F.col("b")).alias("ab"), C.pearson(F.col("a"), F.col("c")).alias("ac")))[0]
    assert got["ab"] == pytest.approx(1.0) and got["ac"] is None


def test_risk_levels(spark):
    got = values(spark, [(0.7,), (0.5,), (0.3,), (0.29,)], "p DOUBLE", C.risk_level("p"))
    assert got == ["critical", "high", "medium", "low"]
