import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tabgauge.operators.clean import (
    apply_edits,
    convert_type,
    dedupe_column_names,
    drop_missing_rows,
    encode_labels,
    fill_mean,
    fill_missing,
    fill_mode,
    filled_cells,
    filter_category,
    require_rows,
    filter_values,
    label_codes,
    remove_all_outliers,
    remove_duplicates,
    remove_outliers,
    rename_column,
    rows_above_threshold,
    rows_duplicated,
    rows_missing,
    rows_outlier,
)
from tabgauge.operators.profile import outlier_cells
from tabgauge.operators.quantiles import find_fences


@pytest.fixture(scope="module")
def dups(spark):
    rows = [(1, 2.0), (1, 2.0), (1, None), (1, None), (1, None), (2, 2.0), (3, None)]
    return spark.createDataFrame(rows, "k int, v double")


@pytest.fixture(scope="module")
def outliers(spark):
    base = [(float(i), float(i % 7)) for i in range(40)]
    rows = base + [(1000.0, 60.0), (1200.0, 70.0), (None, 3.0), (None, 5.0), (20.0, 11.0)]
    return spark.createDataFrame(rows, "x double, y double")


def test_duplicates_are_equal_where_both_are_missing(dups):
    assert remove_duplicates(dups).count() == 4
    assert remove_duplicates(remove_duplicates(dups)).count() == 4


@pytest.mark.parametrize("chunk", [1, 2, 1_000_000])
def test_all_copies_of_repeated_rows_are_listed(dups, chunk):
    got = sorted(rows_duplicated(dups, chunk).collect(), key=str)
    assert got == sorted([(1, 2.0)] * 2 + [(1, None)] * 3, key=str)


def test_a_row_making_up_a_third_of_the_table_is_written_by_many_tasks(spark):
    hot = spark.range(30_000).select(F.lit("same").alias("s"))
    rest = spark.range(60_000).select(F.col("id").cast("string").alias("s"))
    got = rows_duplicated(hot.unionByName(rest), chunk=500)
    sizes = [len(p) for p in got.rdd.glom().collect()]
    assert sum(sizes) == 30_000
    assert max(sizes) < 15_000


def test_fill_takes_mean_and_smallest_mode(spark, nulls):
    ties = spark.createDataFrame(
        [(s, 1 if s else None) for s in ["b", "a", "c", "a", "b", None]], "s string, n int"
    )
    filled = fill_missing(ties).collect()
    assert [r["s"] for r in filled].count("a") == 3
    assert all(r["n"] == 1.0 for r in filled)
    assert fill_missing(nulls).where("a is null or b is null or s is null").count() == 0
    assert filled_cells(nulls).first()["filled"] == 2 + 2 + 3
    assert fill_mean(nulls, "a").where("a = 2.75").count() == 2
    assert fill_mode(nulls, "s").where("s = 'x'").count() == 5


def test_a_column_without_values_stays_empty(spark):
    df = spark.createDataFrame([(None, None), (None, 1.0)], "s string, x double")
    assert fill_missing(df).where("s is null").count() == 2
    assert fill_missing(df).where("x is null").count() == 0


def test_rows_missing_the_value_survive_outlier_removal(outliers):
    kept = remove_outliers(outliers, "x")
    assert kept.where("x is null").count() == 2
    assert kept.where("x > 100").count() == 0
    assert rows_outlier(outliers, "x").count() == 2


def test_fences_move_as_outliers_go(outliers):
    one_by_one = outliers.count() - remove_all_outliers(outliers).count()
    at_once = outlier_cells(outliers).first()["outliers"]
    pdf = outliers.toPandas()
    for c in ("x", "y"):
        q1, q3 = pdf[c].quantile(0.25), pdf[c].quantile(0.75)
        out = (pdf[c] < q1 - 1.5 * (q3 - q1)) | (pdf[c] > q3 + 1.5 * (q3 - q1))
        pdf = pdf[~out]
    assert one_by_one == outliers.count() - len(pdf)
    assert one_by_one != at_once
    assert remove_outliers(outliers, "x").count() < outliers.count()


def test_sequential_removal_matches_pandas_on_given_tables(events):
    pdf = events.select("event_id", "user_id", "value").toPandas()
    for c in pdf.columns:
        q1, q3 = pdf[c].quantile(0.25), pdf[c].quantile(0.75)
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        pdf = pdf[~((pdf[c] < low) | (pdf[c] > high))]
    assert remove_all_outliers(events).count() == len(pdf)
    assert remove_all_outliers(events, k=400, kept_rows=0).count() == len(pdf)


def test_removed_rows_are_filtered_in_the_scan(events):
    pushed = {
        "Or(IsNull(event_id),And(GreaterThanOrEqual(event_id": remove_outliers(events, "event_id"),
        "Or(IsNull(user_id),And(GreaterThanOrEqual(user_id": remove_all_outliers(events),
        "Or(LessThan(value": rows_outlier(events, "value"),
        "GreaterThan(value": rows_above_threshold(events, "value"),
    }
    for text, frame in pushed.items():
        plan = frame._jdf.queryExecution().explainString(
            frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        )
        assert text in plan.split("PushedFilters: ")[1], plan


def test_whole_numbers_are_cut_like_doubles(spark):
    values = [0, 1, 1, 2, 2, 3, 3, 4, -4, -3, 7, 8, 100, None]
    whole = spark.createDataFrame([(v,) for v in values], "x bigint")
    real = whole.selectExpr("cast(x as double) as x")
    assert sorted(map(str, (r[0] for r in remove_outliers(whole, "x").collect()))) == sorted(
        "None" if r[0] is None else str(int(r[0])) for r in remove_outliers(real, "x").collect()
    )
    assert rows_outlier(whole, "x").count() == rows_outlier(real, "x").count()


def test_filters(spark, nulls, orders):
    assert rows_missing(nulls, "s").count() == 3
    assert drop_missing_rows(nulls).count() == 2
    assert [r[0] for r in filter_values(nulls, "s").collect()] == ["x", "y"]
    assert filter_category(orders, "o_orderstatus", "").count() == 0
    assert filter_category(nulls, "s", "x").count() == 2
    assert filter_category(nulls, "s", None).count() == 3
    zeros = spark.createDataFrame([(0,), (1,)], "n int")
    assert filter_category(zeros, "n", 0).count() == 1
    with pytest.raises(ValueError):
        require_rows(filter_category(nulls, "s", "x"))
    assert require_rows(nulls, 2).count() == nulls.count()


def test_conversions_turn_misfits_into_missing(spark):
    texty = spark.createDataFrame([("12",), ("1.5",), ("-3",), ("x",), (" 2 ",), (None,)], "s string")
    got = [r[0] for r in convert_type(texty, "s", "numeric").collect()]
    assert got == [12.0, 1.5, -3.0, None, 2.0, None]
    dates = spark.createDataFrame([("2024-01-05",), ("nope",), (None,)], "d string")
    got = [r[0] for r in convert_type(dates, "d", "datetime").collect()]
    assert got == [pd.Timestamp("2024-01-05"), None, None]
    with pytest.raises(ValueError):
        convert_type(dates, "d", "colour")


def test_codes_follow_the_value_order(spark):
    df = spark.range(500).select(F.concat(F.lit("v"), F.col("id") % 97).alias("s"))
    one = {r["value"]: r["code"] for r in label_codes(df, "s").collect()}
    assert sorted(one.values()) == list(range(97))
    assert [v for v, _ in sorted(one.items(), key=lambda x: x[1])] == sorted(one)
    coded = encode_labels(df.unionByName(spark.createDataFrame([(None,)], "s string")), "s")
    assert coded.count() == 501
    assert coded.where("code is null").count() == 1


def test_names(spark, orders):
    assert "amount" in rename_column(orders, "o_totalprice", "amount").columns
    with pytest.raises(ValueError):
        rename_column(orders, "o_totalprice", "o_orderkey")
    doubled = orders.select("o_orderkey", F.lit(1).alias("x"), F.lit(2).alias("o_orderkey"))
    assert dedupe_column_names(doubled).columns == ["o_orderkey", "x"]


def test_edits_update_clear_delete_and_add(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)], "k int, s string, v double")
    edits = spark.createDataFrame(
        [(1, "z", False, []), (2, None, True, []), (3, None, False, ["s"]), (9, "n", False, [])],
        "k int, s string, deleted boolean, cleared array<string>",
    )
    got = sorted(apply_edits(df, edits, ["k"]).collect())
    assert got == [(1, "z", 1.0), (3, None, 3.0), (9, "n", None)]
    plan = apply_edits(df, edits, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_edits_of_repeated_and_of_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (None, "n"), (2, "b")], "k int, s string")
    edits = spark.createDataFrame(
        [(1, "first", 1), (1, "last", 2), (None, "null", 3), (5, "new", 4)],
        "k int, s string, no int",
    )
    got = apply_edits(df, edits, ["k"], order="no").collect()
    assert sorted(map(str, got)) == sorted(
        map(str, [Row(k=1, s="last"), Row(k=None, s="null"), Row(k=2, s="b"), Row(k=5, s="new")])
    )
    with pytest.raises(Exception, match="more than once"):
        apply_edits(df, edits.drop("no"), ["k"]).collect()
    unique = edits.where("no > 1").drop("no")
    assert apply_edits(df, unique, ["k"]).count() == 4


def test_fences_of_a_filtered_frame_use_its_rows(events):
    small = events.where("value < 50")
    assert find_fences(small, ["value"])["value"].high < find_fences(events, ["value"])["value"].high
