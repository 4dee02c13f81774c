import datetime as dt

import numpy as np
import pytest

from tabgauge.operators.forecast import (
    forecast_category_summary,
    forecast_numeric_summary,
)
from tabgauge.operators.ordering import over_previous, with_row_number
from tabgauge.operators.series import (
    category_features,
    daily_category_counts,
    daily_category_share,
    daily_mean,
    future_days,
    growth,
    history_tail,
    lag_features_backfill,
    moving_average,
    numeric_features,
    trend_direction,
)

START = dt.date(2024, 1, 1)


def day(n):
    return START + dt.timedelta(days=n - 1)


@pytest.fixture(scope="module")
def gaps(spark):
    rows = [(day(1), 2.0, "a"), (day(1), 4.0, "b"), (day(4), 8.0, "a"), (day(9), 1.0, None),
            (None, 5.0, "a"), (day(9), None, "b")]
    return spark.createDataFrame(rows, "day date, y double, cat string")


def test_three_ways_of_treating_missing_days(gaps):
    filled = [r["y"] for r in daily_mean(gaps, "day", "y").orderBy("day").collect()]
    assert filled == [3.0, 3.0, 3.0, 8.0, 8.0, 8.0, 8.0, 8.0, 1.0]
    counts = {(r["category"], r["day"]): r["n"] for r in daily_category_counts(gaps, "day", "cat").collect()}
    seen = {("a", day(1)): 1, ("b", day(1)): 1, ("a", day(4)): 1, ("b", day(9)): 1}
    assert counts == seen
    named = daily_category_counts(gaps, "day", "cat", named=["b", "z"])
    assert {(r["category"], r["day"]): r["n"] for r in named.collect()} == seen | {
        ("b", day(4)): 0, ("z", day(1)): 0, ("z", day(4)): 0, ("z", day(9)): 0}
    averaged = [r["moving_average"] for r in moving_average(gaps, "day", "y").orderBy("stamp").collect()]
    assert averaged == [None, None, 4.0]


def test_shares_sum_to_one_per_day(gaps):
    shares = daily_category_share(gaps, "day", "cat").groupBy("day").sum("share").collect()
    assert all(r[1] == pytest.approx(1.0) for r in shares)


def test_counts_by_group_list_what_occurs(spark):
    rows = [("x", day(1), "a"), ("x", day(2), "b"), ("y", day(1), "c")]
    df = spark.createDataFrame(rows, "g string, day date, cat string")
    got = daily_category_counts(df, "day", "cat", ["g"]).collect()
    assert len(got) == 3
    assert sum(r["n"] for r in got) == 3


def test_moving_average_is_that_of_pandas(spark, events):
    pdf = events.select("ts", "value").toPandas().groupby("ts")["value"].mean().sort_index()
    want = pdf.rolling(7).mean()
    got = moving_average(events, "ts", "value").toPandas().sort_values("stamp")
    assert len(got) == len(want)
    np.testing.assert_allclose(got["moving_average"].to_numpy(float), want.to_numpy(), rtol=1e-9)


@pytest.mark.parametrize("run_length", [1, 3, 6, 1000])
def test_runs_hand_their_tail_to_all_that_need_it(spark, run_length):
    from pyspark.sql import functions as F

    df = spark.range(40).select(F.col("id").alias("row_number"))
    got = over_previous(df, 6, {"s": F.sum("row_number")}, run_length=run_length).collect()
    assert len(got) == 40
    assert {r["row_number"]: r["s"] for r in got} == {i: sum(range(max(0, i - 5), i + 1)) for i in range(40)}


def test_row_numbers_follow_the_order(spark, orders):
    keys = ["o_totalprice", "o_orderkey"]
    got = with_row_number(orders, keys).select("o_orderkey", "row_number").collect()
    want = [r["o_orderkey"] for r in orders.orderBy(*keys).collect()]
    assert [k for k, _ in sorted(got, key=lambda r: r[1])] == want
    assert sorted(r[1] for r in got) == list(range(len(want)))


def test_short_series_have_no_seven_day_lag(spark):
    df = spark.createDataFrame([(day(i), float(i)) for i in range(1, 8)], "day date, y double")
    rows = lag_features_backfill(df).orderBy("day").collect()
    assert [r["lag1"] for r in rows] == [1.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    assert all(r["lag7"] is None for r in rows)


def test_features_match_pandas(orders):
    got = numeric_features(orders, "o_orderdate", "o_totalprice").toPandas().sort_values("day")
    pdf = orders.select("o_orderdate", "o_totalprice").toPandas()
    series = pdf.set_index("o_orderdate")["o_totalprice"].resample("D").mean().ffill().bfill()
    assert len(got) == len(series)
    np.testing.assert_allclose(got["y"], series.to_numpy())
    np.testing.assert_allclose(got["lag7"], series.shift(7).bfill().to_numpy())
    np.testing.assert_allclose(got["rolling7"], series.rolling(7, min_periods=1).mean().to_numpy())
    assert list(got["day_of_week"]) == list(series.index.dayofweek)
    assert list(got["quarter"]) == list(series.index.quarter)
    assert list(got["trend"]) == list(range(len(series)))


def test_category_features_match_pandas(orders):
    pdf = orders.select("o_orderdate", "o_orderpriority").toPandas()
    named = sorted(pdf["o_orderpriority"].unique())
    got = category_features(orders, "o_orderdate", "o_orderpriority", named=named).toPandas()
    counts = pdf.groupby(["o_orderdate", "o_orderpriority"]).size().unstack(fill_value=0)
    for category in counts.columns:
        mine = got[got["category"] == category].sort_values("day")
        assert list(mine["y"]) == list(counts[category])
        assert list(mine["lag7"]) == list(counts[category].shift(7).fillna(0))


def test_leak_free_rolling_mean_sees_only_the_past(spark):
    df = spark.createDataFrame([(day(i), float(i)) for i in range(1, 12)], "day date, y double")
    rows = numeric_features(df, "day", "y", leak_free=True).orderBy("day").collect()
    assert rows[0]["rolling7"] == 1.0
    assert rows[10]["rolling7"] == pytest.approx(np.mean([4, 5, 6, 7, 8, 9, 10]))


def test_future_and_tail(gaps):
    series = daily_mean(gaps, "day", "y")
    assert [r["day"] for r in future_days(series, 2).orderBy("day").collect()] == [day(10), day(11)]
    assert {r["day"] for r in history_tail(series, 2).collect()} == {day(8), day(9)}
    with pytest.raises(ValueError):
        future_days(series, 366)


def test_growth_guards(spark, gaps):
    df = spark.createDataFrame([(day(1), 2, 5.0), (day(1), 1, 4.0), (day(3), 1, 6.0)], "d date, k int, y double")
    assert growth(df, "d", "y", ["k"]).first()["growth"] == pytest.approx(50.0)
    zero = spark.createDataFrame([(day(1), 1, 0.0), (day(2), 1, 6.0)], "d date, k int, y double")
    assert growth(zero, "d", "y", ["k"]).first()["growth"] == 0.0
    one = spark.createDataFrame([(day(1), 1, 3.0)], "d date, k int, y double")
    assert growth(one, "d", "y", ["k"]).first()["has_time"] is False
    assert trend_direction(gaps, "day", "y").first()["direction"] == "Decreasing"


def test_summaries(spark):
    given = spark.createDataFrame(
        [("a", day(1), 1.9), ("a", day(2), 3.5), ("a", day(3), 3.5), ("b", day(1), 0.5)],
        "category string, day date, prediction double",
    )
    rows = {r["category"]: r for r in forecast_category_summary(given).collect()}
    assert (rows["a"]["total"], rows["a"]["peak_day"], rows["a"]["peak_count"]) == (8, day(2), 3)
    assert rows["a"]["dominant"] and not rows["b"]["dominant"]
    history = spark.createDataFrame([(day(1), 5.0), (day(2), 2.0)], "day date, y double")
    row = forecast_numeric_summary(history, given).first()
    assert row["current"] == 2.0
    assert row["direction"] == "up"
    zero = spark.createDataFrame([(day(1), 0.0)], "day date, y double")
    assert forecast_numeric_summary(zero, given).first()["change_pct"] == 0.0
