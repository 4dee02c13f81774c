import math

import pytest
from pyspark.sql import functions as F

from tabgauge.functions.expr import merge_rows
from tabgauge.operators.clean import remove_outliers, rows_outlier
from tabgauge.operators.profile import (
    cardinality,
    categorical_stats,
    column_facts,
    column_metrics,
    column_summary,
    complete_columns,
    describe,
    distinct_counts,
    duplicate_stats,
    histogram,
    histograms,
    missing_cells,
    outlier_cells,
    problem_columns,
    profile_report,
    shape,
    value_counts,
    zscore_outliers,
)
from tabgauge.plans.health import (
    health_facts,
    health_score,
    integrity_score,
    quality_report,
    recommendations,
    report_recommendations,
    scan_stages,
    severity_labels,
)


def test_summary_counts_missing_and_distinct(nulls):
    got = {r["column"]: r for r in column_summary(nulls).collect()}
    assert (got["a"]["missing"], got["a"]["unique"], got["a"]["mean"]) == (2, 4, 2.75)
    assert (got["s"]["missing"], got["s"]["unique"], got["s"]["mean"]) == (3, 2, None)


def test_approximate_distinct_on_request(nulls):
    exact = {r["column"]: r["unique"] for r in column_facts(nulls).collect()}
    near = {r["column"]: r["unique"] for r in column_facts(nulls, exact=False).collect()}
    assert exact == near


def test_long_text_is_counted_by_digest(spark):
    long = "x" * 500
    rows = [(long + "a",), (long + "b",), (long + "a",), ("short",), (None,)]
    df = spark.createDataFrame(rows, "s string")
    assert distinct_counts(df, ["s"]).first()["unique"] == 3
    assert duplicate_stats(df).first()["duplicates"] == 1


def test_column_metrics_and_mode_ties(spark):
    ties = spark.createDataFrame([(s,) for s in ["b", "a", "c", "a", "b", None]], "s string")
    row = column_metrics(ties, "s").first()
    assert (row["mode"], row["unique"], row["missing"]) == ("a", 3, 1)
    stats = categorical_stats(ties, "s").first()
    assert (stats["mode_count"], stats["total"]) == (2, 6)
    assert stats["mode_pct"] == pytest.approx(100 / 3)
    assert [r["value"] for r in value_counts(ties, "s").collect()] == ["a", "b", "c"]


def test_describe_and_shape_match_pandas(events):
    pdf = events.select("value").toPandas()["value"]
    got, want = describe(events, "value").first(), pdf.describe()
    for ours, theirs in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                         ("q25", "25%"), ("q50", "50%"), ("q75", "75%"), ("max", "max")):
        assert got[ours] == pytest.approx(want[theirs])
    row = shape(events, "value").first()
    assert row["skew"] == pytest.approx(pdf.skew())
    assert row["kurtosis"] == pytest.approx(pdf.kurtosis())


@pytest.mark.parametrize("values, skew, kurtosis", [([5.0] * 4, 0.0, 0.0), ([1.0, 2.0], None, None),
                                                    ([3.0] * 3, 0.0, None)])
def test_shape_of_constant_and_short_columns(spark, values, skew, kurtosis):
    row = shape(spark.createDataFrame([(v,) for v in values], "x double"), "x").first()
    assert (row["skew"], row["kurtosis"]) == (skew, kurtosis)


def test_missing_problem_and_complete_columns(nulls):
    row = missing_cells(nulls).first()
    assert (row["cells"], row["missing"]) == (18, 7)
    assert {r["column"] for r in problem_columns(nulls).collect()} == {"a", "b", "s"}
    assert complete_columns(nulls).first()["complete"] == 0


def test_empty_table_gives_no_errors(empty):
    row = missing_cells(empty).first()
    assert (row["missing_pct"], row["completeness"]) == (None, 100.0)
    assert duplicate_stats(empty).first()["duplicates"] == 0
    assert outlier_cells(empty).first()["outliers"] == 0
    assert describe(empty, "a").first()["q50"] is None
    assert column_summary(empty).count() == 3
    assert histogram(empty, "a").count() == 0
    assert scan_stages(empty).where("stage = 7").first()["status"] == "CRITICAL"
    assert zscore_outliers(empty).first()["z_outliers"] == 0
    assert health_facts(empty).first()["outlier_pct"] == 0.0


def test_histogram_closes_the_last_bin_and_lists_empty_ones(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (10.0,), (None,)], "x double")
    got = [r["n"] for r in histogram(df, "x", 5).orderBy("bin").collect()]
    assert got == [2, 0, 0, 0, 1]
    flat = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert histogram(flat, "x", 3).agg(F.sum("n")).first()[0] == 2


def test_cardinality_order_of_rules(spark):
    rows = [(1, i, i if i < 97 else 0, i % 3, i // 3) for i in range(100)]
    df = spark.createDataFrame(rows, "one int, id int, most int, few int, mid int")
    got = {r["column"]: r["category"] for r in cardinality(df).collect()}
    assert got == {"one": "Constant", "id": "Unique ID", "most": "High Cardinality",
                   "few": "Low Cardinality", "mid": "Medium"}


def test_profile_sample_takes_the_first_filled_values(spark):
    rows = [(3, "c"), (1, None), (2, "b" * 30), (4, "d"), (5, "e")]
    df = spark.createDataFrame(rows, "k int, s string")
    got = {r["column"]: r for r in profile_report(df, ["k"]).collect()}
    assert got["s"]["sample"] == "b" * 30 + ", c, d"
    assert got["s"]["quality"] == "Poor" and got["k"]["quality"] == "Excellent"


def test_constant_columns_are_never_z_outliers(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(50)] + [(1.0, 9000.0)], "c double, x double")
    assert zscore_outliers(df).first()["z_outliers"] == 1


def test_scores_and_their_floor(spark):
    df = spark.createDataFrame([(None, None)] * 50, "a double, b double")
    row = health_score(df).first()
    assert (row["score"], row["grade"]) == (50.0, "Needs Fixing")
    assert integrity_score(df).first()["score"] == 0.0
    labels = severity_labels(df).first()
    assert (labels["missing"], labels["duplicates"], labels["outliers"]) == ("High", "Review", "Normal")


def test_recommendations_name_constants_and_default(spark, empty):
    df = spark.createDataFrame([(1, i, 2) for i in range(30)], "a int, b int, c int")
    row = recommendations(df).collect()
    assert [r["rule"] for r in row] == ["constants"]
    assert row[0]["detail"].endswith("a, c")
    text = spark.createDataFrame([("x", "p"), ("y", "q")], "s string, t string")
    assert [r["rule"] for r in report_recommendations(text).collect()] == ["excellence", "automation"]
    lines = [r["text"] for r in quality_report(text).collect()]
    assert lines[0] == "DATA QUALITY REPORT" and lines[-1] == "- No issues detected"


def test_scan_decision_uses_cells_against_rows(spark):
    df = spark.createDataFrame([(float(i), None if i < 2 else 1.0) for i in range(20)], "a double, b double")
    assert scan_stages(df).where("stage = 7").first()["status"] == "CRITICAL"
    more = spark.createDataFrame([(float(i), None if i < 1 else 1.0) for i in range(20)], "a double, b double")
    assert scan_stages(more).where("stage = 7").first()["status"] == "GOOD"


def test_merging_rows_keeps_each_fact(spark):
    a, b = spark.sql("select 1 as x"), spark.sql("select 'q' as y, true as z")
    assert merge_rows(a, b).first().asDict() == {"x": 1, "y": "q", "z": True}


def test_nan_is_missing_in_profiles(spark):
    nan = float("nan")
    rows = [(float(i), i) for i in range(20)] + [(nan, 20), (500.0, 21), (None, 22)]
    df = spark.createDataFrame(rows, "x double, k int")
    clean = spark.createDataFrame([r for r in rows if r[0] == r[0]], "x double, k int")
    assert describe(df, "x").first() == describe(clean, "x").first()
    assert rows_outlier(df, "x").count() == 1
    assert remove_outliers(df, "x").count() == 22
    assert outlier_cells(df).first()["outliers"] == 1


def test_samples_take_a_fixed_number_of_scans(spark):
    rows = [(3, None, "c" * 30), (1, 5.0, None), (2, 6.0, "b"), (4, 7.0, "d"), (5, 8.0, "e")]
    df = spark.createDataFrame(rows, "k int, x double, s string")
    got = {r["column"]: r["sample"] for r in profile_report(df, ["k"]).collect()}
    assert got == {"k": "1, 2, 3", "x": "5.0, 6.0, 7.0", "s": "b, " + "c" * 30 + ", d"}
    none = spark.createDataFrame([(1, None)], "k int, x double")
    assert {r["sample"] for r in profile_report(none, ["k"]).collect()} == {"1", None}


def test_histograms_of_all_columns_agree_with_one_by_one(spark):
    nan = float("nan")
    rows = [(float(i % 7), i, 5.0) for i in range(100)] + [(None, None, None), (nan, 3, 5.0)]
    df = spark.createDataFrame(rows, "x double, k int, c double")
    got = histograms(df, bins=6)
    for name in ("x", "k", "c"):
        one = histogram(df, name, 6).select("bin", "n").collect()
        assert sorted(got.where(f"column = '{name}'").select("bin", "n").collect()) == sorted(one)
    assert histograms(spark.createDataFrame([], "x double")).count() == 0
