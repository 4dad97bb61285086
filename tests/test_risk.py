import math

import pytest
from pyspark.sql import functions as F

from hushframe.operators import ec, privacy, risk
from tests.fixtures_tables import EIGHT_SCHEMA, EIGHT_ROWS

KEYS = ["key1", "key2", "key3", "key4"]


def test_eight_rows_by_hand(spark):
    d = spark.createDataFrame(EIGHT_ROWS, EIGHT_SCHEMA)
    r = risk.reid(d, KEYS).first()
    assert r["reid_95"] == 1.0 and r["evaluated"] == 8 and r["suppressed"] == 0
    assert sorted(x["risk"] for x in risk.record_risk(d, KEYS).collect()) == [0.5] * 4 + [1.0] * 4
    assert risk.uniqueness(d, KEYS).first()["uniqueness"] == 0.5
    assert risk.k_check(d, KEYS, 2).first()["n_violations"] == 4


def test_null_conventions(spark):
    d = spark.createDataFrame([("a",), ("a",), (None,), (None,), (None,)], "q string")
    assert {r["n"] for r in ec.ec_sizes(d, ["q"]).collect()} == {2}
    assert {r["n"] for r in ec.ec_sizes(d, ["q"], "as_value").collect()} == {2, 3}
    r = risk.reid(d, ["q"]).first()
    assert (r["evaluated"], r["suppressed"]) == (2, 3)


def test_all_suppressed_and_empty(spark):
    for rows in ([(None,), (None,)], []):
        r = risk.reid(spark.createDataFrame(rows, "q string"), ["q"]).first()
        assert r["reid_95"] == 0.0 and r["evaluated"] == 0 and r["suppressed"] == len(rows)


def test_checks_columns_first(spark):
    d = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="not found"):
        risk.reid(d, ["b"])
    with pytest.raises(ValueError):
        ec.ec_sizes(d, [])


def test_record_risk_quantiles_equal_weighted_ones(spark):
    d = spark.range(500).select((F.col("id") % 7 * (F.col("id") % 3)).alias("a"), (F.col("id") % 5).alias("b"))
    by_row = risk.record_risk(d, ["a", "b"]).agg(F.percentile("risk", F.lit(0.95))).first()[0]
    assert math.isclose(by_row, risk.reid(d, ["a", "b"]).first()["reid_95"])


def test_patterns_and_levels():
    assert risk.risk_pattern(0.3, 0.35, 0.35) == "uniform_high"
    assert risk.risk_pattern(0.25, 0.5, 1.0) == "widespread"
    assert risk.risk_pattern(0.019, 0.024, 1.0) == "severe_tail"
    assert risk.risk_pattern(0.167, 0.333, 0.34) == "tail"
    assert risk.risk_pattern(0.01, 0.02, 0.03) == "uniform_low"
    assert risk.risk_level(0.2, 0.0, 5) == "critical" and risk.risk_level(0, 0, 5, False) == "high" and risk.risk_level(0, 0, 5) == "low"


def test_row_ids_tell_equal_rows_apart(spark):
    d = ec.with_row_id(spark.createDataFrame([(1,), (1,), (2,)], "a int"))
    assert d.select("_rid").distinct().count() == 3


def test_t_closeness_numeric_by_brute_force(spark):
    rows = [(i % 3, (i * 37) % 11 * (1 + i % 3)) for i in range(60)]
    got = {r["g"]: r["t"] for r in privacy.t_closeness_numeric(spark.createDataFrame(rows, "g int, v int"), ["g"], "v").collect()}
    values = sorted({v for _, v in rows})
    for g in {g for g, _ in rows}:
        own = [v for x, v in rows if x == g]
        t = sum(abs(sum(v <= a for v in own) / len(own) - sum(v <= a for _, v in rows) / len(rows)) * (b - a) for a, b in zip(values, values[1:])) / (values[-1] - values[0])
        assert math.isclose(got[g], t, abs_tol=1e-9)
