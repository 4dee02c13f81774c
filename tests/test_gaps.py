"""NaN is missing in every operator that counts or fills gaps; counts without unfolding."""

import datetime

import pytest
from pyspark.sql import functions as F

from tabgauge.operators.clean import (
    drop_missing_rows,
    encode_labels,
    fill_mean,
    fill_missing,
    fill_mode,
    filled_cells,
    filter_values,
    rows_missing,
)
from tabgauge.operators.profile import (
    BITMAP,
    cardinality,
    categorical_stats,
    column_facts,
    column_metrics,
    column_summary,
    complete_columns,
    constant_columns,
    distinct_counts,
    missing_cells,
    problem_columns,
    profile_report,
    value_counts,
)
from tabgauge.plans.health import health_score, integrity_score, report_health_score
from tabgauge.sources.sampling import missing_matrix

NAN = float("nan")


@pytest.fixture(scope="module")
def nan(spark):
    rows = [(1, 1.0, "x"), (2, NAN, None), (3, 3.0, "y"), (4, None, "x"), (5, 3.0, "x"), (6, NAN, "x")]
    return spark.createDataFrame(rows, "k int, v double, s string")


@pytest.fixture(scope="module")
def null(nan):
    """The same with nulls in place of NaN."""
    return nan.withColumn("v", F.nanvl("v", F.lit(None).cast("double")))


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize(
    "make",
    [
        missing_cells,
        problem_columns,
        complete_columns,
        column_summary,
        column_facts,
        cardinality,
        filled_cells,
        fill_missing,
        drop_missing_rows,
        health_score,
        report_health_score,
        integrity_score,
        lambda df: profile_report(df, ["k"]),
        lambda df: column_metrics(df, "v"),
        lambda df: categorical_stats(df, "v"),
        lambda df: value_counts(df, "v"),
        lambda df: fill_mean(df, "v"),
        lambda df: fill_mode(df, "v"),
        lambda df: filter_values(df, "v"),
        lambda df: encode_labels(df.select("v"), "v").select("code"),
        lambda df: rows_missing(df, "v").select("k"),
        lambda df: missing_matrix(df, ["k"]),
    ],
)
def test_nan_counts_as_a_gap(nan, null, make):
    same(make(nan), make(null))


def test_gaps_are_filled_and_counted(nan):
    mean = 7 / 3
    assert [r["v"] for r in fill_missing(nan).orderBy("k").collect()] == [1.0, mean, 3.0, mean, 3.0, mean]
    assert rows_missing(nan, "v").count() == 3
    assert missing_cells(nan).first()["missing"] == 4
    assert {r["column"]: r["unique"] for r in column_facts(nan).collect()} == {"k": 6, "v": 2, "s": 2}


def test_distinct_counts_of_every_type(spark):
    day = datetime.date(2024, 1, 1)
    rows = [
        (i % 7 - 3, i * 10**12, float(i % 5), i / 3, -0.0 if i % 2 else 0.0, day + datetime.timedelta(i % 9),
         i % 2 == 0, [i % 4], {"a": i % 6}, None, f"t{i % 8}" * 40, float("inf") if i % 3 else 1.0)
        for i in range(300)
    ]
    schema = (
        "small int, wide bigint, whole double, parts double, zero double, day date, flag boolean, "
        "list array<int>, map map<string,int>, gone int, text string, ends double"
    )
    df = spark.createDataFrame(rows, schema)
    wanted = {"small": 7, "wide": 300, "whole": 5, "parts": 300, "zero": 1, "day": 9, "flag": 2,
              "list": 4, "map": 6, "gone": 0, "text": 8, "ends": 2}
    got = {df.columns[r["position"]]: r["unique"] for r in distinct_counts(df, df.columns).collect()}
    assert got == wanted
    assert {r["column"] for r in constant_columns(df).collect()} == {"zero"}


@pytest.mark.parametrize("low", [-(2**63), -5, 0, 2**63 - BITMAP])
def test_bitmaps_hold_the_whole_span(spark, low):
    values = [(low,), (low + 1,), (low + BITMAP - 1,), (low,)]
    df = spark.createDataFrame(values, "v bigint")
    assert distinct_counts(df, ["v"]).first()["unique"] == 3


def test_counts_unfold_no_rows(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = column_facts(lines)._jdf.queryExecution().toString()
    assert "Expand" not in plan and "unpivot" not in plan.lower()
    assert "bitmap_construct_agg" in plan


def test_first_values_behind_many_gaps(spark):
    rows = [(i, None if i < 500 else f"late {i}", i) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, s string, v int").repartition(5)
    got = {r["column"]: r["sample"] for r in profile_report(df, ["k"]).collect()}
    assert got == {"k": "0, 1, 2", "s": "late 500, late 501, late 502", "v": "0, 1, 2"}
