import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from tabgauge.operators.correlation import (
    Sums,
    corr_matrix,
    corr_pairs,
    high_corr_pairs,
    report_relationship,
    strong_corr,
    strongest_pair,
)
from tabgauge.operators.groups import (
    alerts,
    hierarchy_counts,
    machine_alerts,
    risk_score,
    system_alert,
    top_groups,
    trend,
    unit_share,
)
from tabgauge.operators.roles import Scenario
from tabgauge.plans.dashboard import diagnosed_alerts, kpi


def pairs(frame):
    return {(r["col1"], r["col2"]): r["r"] for r in frame.collect()}


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=200)
    b = a * 2 + rng.normal(size=200) * 0.1
    c = rng.normal(size=200)
    rows = [
        (float(x), float(y) if i % 3 else None, float(z) if i % 4 else None, 0.1, 7)
        for i, (x, y, z) in enumerate(zip(a, b, c))
    ]
    return spark.createDataFrame(rows, "a double, b double, c double, k double, n int")


@pytest.mark.parametrize("entries", [0, 128])
def test_pairs_use_rows_where_both_are_present(mixed, entries):
    want = mixed.toPandas().corr()
    got = pairs(corr_pairs(mixed, entries=entries))
    assert len(got) == 10
    for (x, y), r in got.items():
        if "k" in (x, y) or "n" in (x, y):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[x, y])


@pytest.mark.parametrize("entries", [0, 128])
def test_gap_free_columns_match_pandas(spark, sf_dir, entries):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_quantity", "l_extendedprice", "l_tax")
    want = df.toPandas().corr()
    for (x, y), r in pairs(corr_pairs(df, entries=entries)).items():
        assert r == pytest.approx(want.loc[x, y])


def test_sums_stay_in_the_jvm(mixed, monkeypatch):
    """Sums for any width in one matrix, and no rows go through Python."""
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(mixed), name, None)
    for df, size in ((mixed, 2 * 5 + 3), (mixed.na.drop(), 5 + 1)):
        assert Sums(df, df.columns).gram.shape == (size, size)
        assert Sums(df, df.columns, 0).gram == pytest.approx(Sums(df, df.columns).gram)
    wide = mixed.select(*[(F.col("a") * i + F.col("b")).alias(f"w{i}") for i in range(60)])
    assert corr_pairs(wide).count() == 60 * 59 // 2


def test_infinite_values_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, float("inf")), (2.0, 1.0), (3.0, 2.0)], "x double, y double")
    for entries in (0, 128):
        assert pairs(corr_pairs(df, entries=entries)) == {("x", "y"): None}


def test_a_column_constant_where_both_are_present_has_no_correlation(spark):
    rows = [(1.0, 1.0), (1.0, 2.0), (1.0, 5.0), (9.0, None)]
    df = spark.createDataFrame(rows, "x double, y double")
    for entries in (0, 128):
        assert pairs(corr_pairs(df, entries=entries)) == {("x", "y"): None}
    assert strongest_pair(df).first()["strength"] == 0.0
    assert report_relationship(df).count() == 0


def test_square_has_both_sides_and_a_diagonal(mixed):
    got = pairs(corr_matrix(mixed, ["a", "b", "k"]))
    assert len(got) == 9
    assert got["a", "a"] == 1.0 and got["k", "k"] is None
    assert got["a", "b"] == got["b", "a"]


def test_strong_pairs(mixed):
    assert pairs(high_corr_pairs(mixed)).keys() == {("a", "b")}
    assert high_corr_pairs(mixed).first()["issue"] == "Very High"
    assert strong_corr(mixed).count() == 1
    best = strongest_pair(mixed).first()
    assert (best["col1"], best["col2"], best["direction"]) == ("a", "b", "rising together")
    assert report_relationship(mixed).first()["relation"] == "positive, above the limit"


def test_nan_is_missing_in_correlation(spark):
    nan = float("nan")
    rows = [(float(i), float(-i), float(i % 3)) for i in range(30)] + [(nan, 1.0, 2.0), (1.0, None, nan)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    want = df.toPandas().corr()
    for (x, y), r in pairs(corr_pairs(df)).items():
        assert r == pytest.approx(want.loc[x, y])


def test_wide_tables_take_one_scan_for_all_pairs(spark):
    df = spark.range(200).selectExpr(*[f"sin(id * {i + 1}) AS c{i}" for i in range(40)])
    got = pairs(corr_pairs(df))
    want = df.toPandas().corr()
    assert len(got) == 780
    assert all(abs(r - want.loc[x, y]) < 1e-9 for (x, y), r in got.items())


def test_single_column_has_no_pairs(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    assert corr_pairs(df).count() == 0
    assert strongest_pair(df).count() == 1


@pytest.fixture(scope="module")
def readings(spark):
    normal = [("calm", float(i % 10)) for i in range(200)]
    edge = [("edge", 100.0)] + [("edge", 5.0)] * 4
    over = [("over", 100.0)] * 2 + [("over", 5.0)] * 4
    lost = [(None, 100.0)] * 5
    return spark.createDataFrame(normal + edge + over + lost, "machine string, vibration double")


def test_alerts_need_more_than_a_fifth_and_a_named_unit(readings):
    raised = machine_alerts(readings, "machine", "vibration").collect()
    assert [(r["unit"], r["critical_count"], r["severity"]) for r in raised] == [("over", 2, "HIGH")]
    whole = system_alert(readings, "vibration").first()
    assert (whole["critical_count"], whole["severity"]) == (8, "MEDIUM")


def test_text_metrics_raise_no_alert(readings):
    assert alerts(readings, None, "machine").count() == 0


def test_risk_is_capped(readings):
    raised = system_alert(readings, "vibration")
    row = risk_score(readings, raised).first()
    assert row["score"] == pytest.approx(8 / 216 * 1000)
    assert (row["band"], row["over_threshold"]) == ("medium", False)
    small = readings.where("vibration > 50")
    assert risk_score(small, raised).first()["score"] == 100.0


def test_key_figures_and_diagnosis(readings):
    wider = readings.selectExpr("machine", "vibration * 3 + 1 as rpm", "vibration")
    row = kpi(wider).first()
    assert (row["scenario"], row["active_units"], row["alerts"]) == ("MANUFACTURING", 3, 1)
    pdf = wider.toPandas()
    assert row["efficiency"] == pytest.approx(pdf["rpm"].mean() / pdf["rpm"].max() * 100)
    cause = diagnosed_alerts(wider).first()
    assert (cause["alert"], cause["likely_cause"]) == ("over", "rpm")
    assert cause["correlation"] == pytest.approx(1.0)
    assert diagnosed_alerts(readings, Scenario("GENERIC", critical="vibration")).count() == 0


def test_groups_leave_out_missing_keys(readings):
    assert {r["value"] for r in top_groups(readings, "machine", "vibration").collect()} == {"calm", "edge", "over"}
    shares = [r["share"] for r in unit_share(readings, "machine").collect()]
    assert math.isclose(sum(shares), 1.0)


def test_hierarchy_totals(spark):
    rows = [(1, "a", "x"), (2, "a", None), (3, "b", "x"), (4, None, "x"), (5, "b", "y")]
    df = spark.createDataFrame(rows, "k int, p string, c string")
    got = {(r["parent"], r["child"], r["is_total"]): r["n"] for r in hierarchy_counts(df, "p", "c").collect()}
    assert got == {("a", "x", False): 1, ("a", None, False): 1, ("a", None, True): 2,
                   ("b", "x", False): 1, ("b", "y", False): 1, ("b", None, True): 2}


def test_trend_is_per_raw_date_value(spark):
    rows = [("2024-01-01", 1.0), ("2024-01-01", 3.0), (None, 9.0), ("2023-12-31", 5.0)]
    df = spark.createDataFrame(rows, "d string, y double")
    assert [tuple(r) for r in trend(df, "d", "y").collect()] == [("2023-12-31", 5.0), ("2024-01-01", 2.0)]
