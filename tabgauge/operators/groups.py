"""Grouped means, shares and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgauge.functions.expr import col, grade
from tabgauge.functions.rules import ALERT_SHARE, SYSTEM_WIDE
from tabgauge.operators.profile import histograms, value_counts
from tabgauge.operators.quantiles import above, find_fences, number
from tabgauge.operators.roles import numeric_columns


def date_means(df: DataFrame, date: str, metric: str) -> DataFrame:
    """Mean per raw date value; missing dates left out."""
    return (
        df.where(col(date).isNotNull())
        .groupBy(col(date).alias("stamp"))
        .agg(F.avg(number(df, metric)).alias("mean"))
    )


def trend(df: DataFrame, date: str, metric: str) -> DataFrame:
    return date_means(df, date, metric).orderBy("stamp")


def multi_trend(
    df: DataFrame, date: str | None, metrics: Sequence[str] | None = None
) -> DataFrame:
    """The trends of the numeric columns, from one grouping; without a date, their
    histograms."""
    names = list(metrics or numeric_columns(df))
    if date is None:
        return histograms(df, names)
    return (
        df.where(col(date).isNotNull())
        .groupBy(col(date).alias("stamp"))
        .agg(*[F.avg(number(df, c)).alias(c) for c in names])
        .orderBy("stamp")
    )


def group_means(df: DataFrame, category: str, metric: str) -> DataFrame:
    return (
        df.where(col(category).isNotNull())
        .groupBy(col(category).alias("value"))
        .agg(F.avg(number(df, metric)).alias("mean"))
    )


def top_groups(df: DataFrame, category: str, metric: str, n: int = 10) -> DataFrame:
    means = group_means(df, category, metric)
    return means.orderBy(F.desc_nulls_last("mean"), "value").limit(n)


def first_groups(df: DataFrame, category: str, metric: str) -> DataFrame:
    """The mean of every category, in category order."""
    return group_means(df, category, metric).orderBy("value")


def unit_share(df: DataFrame, name: str, n: int | None = None) -> DataFrame:
    """Values by frequency and each one's share of all rows that have one.

    ``n`` asks for the most frequent ones only; shares stay those of the table.
    """
    whole = df.agg(F.count(col(name))).scalar()
    return value_counts(df, name, n).withColumn("share", F.col("n") / whole)


def hierarchy_counts(df: DataFrame, parent: str, child: str) -> DataFrame:
    """Rows per (parent, child) and per parent."""
    return (
        df.select(col(parent).alias("parent"), col(child).alias("child"))
        .where(F.col("parent").isNotNull())
        .rollup("parent", "child")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
        .where(F.col("level") < 3)
        .select("parent", "child", (F.col("level") == 1).alias("is_total"), "n")
    )


def critical_threshold(df: DataFrame, metric: str) -> DataFrame:
    high = find_fences(df, [metric])[metric].high
    return df.sparkSession.createDataFrame([(metric, high)], "metric string, threshold double")


def unit_counts(df: DataFrame, unit: str, metric: str) -> DataFrame:
    """Per unit: rows, rows above the fence of the whole table, and the mean."""
    fences = find_fences(df, [metric])[metric]
    return (
        df.where(col(unit).isNotNull())
        .groupBy(col(unit).cast("string").alias("unit"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(above(df, metric, fences)).alias("critical_count"),
            F.avg(number(df, metric)).alias("avg_value"),
        )
    )


def machine_alerts(df: DataFrame, unit: str, metric: str) -> DataFrame:
    """Units with more than a fifth of their rows above the global fence."""
    return (
        unit_counts(df, unit, metric)
        .where(F.col("critical_count") > F.col("rows") * ALERT_SHARE)
        .select(
            "unit",
            F.lit(metric).alias("metric"),
            "avg_value",
            "critical_count",
            F.lit("HIGH").alias("severity"),
        )
    )


def system_alert(df: DataFrame, metric: str) -> DataFrame:
    """One alert for the whole table when any row is above the fence."""
    fences = find_fences(df, [metric])[metric]
    return (
        df.agg(
            F.avg(number(df, metric)).alias("avg_value"),
            F.count_if(above(df, metric, fences)).alias("critical_count"),
        )
        .where(F.col("critical_count") > 0)
        .select(
            F.lit(SYSTEM_WIDE).alias("unit"),
            F.lit(metric).alias("metric"),
            "avg_value",
            "critical_count",
            F.lit("MEDIUM").alias("severity"),
        )
    )


def alerts(df: DataFrame, unit: str | None, metric: str | None) -> DataFrame:
    """Alerts per unit if there is a unit column, else one for the table.

    A metric that is not a number raises none.
    """
    if metric not in numeric_columns(df):
        return df.sparkSession.createDataFrame(
            [],
            "unit string, metric string, avg_value double, critical_count bigint, severity string",
        )
    return machine_alerts(df, unit, metric) if unit else system_alert(df, metric)


def risk_score(df: DataFrame, raised: DataFrame) -> DataFrame:
    """Risk of each alert: incidents per thousand rows times ten, at most 100."""
    rows = df.agg(F.count(F.lit(1))).scalar()
    score = F.least(
        F.lit(100.0), F.try_divide(F.col("critical_count") * F.lit(1000.0), rows)
    )
    scored = raised.withColumn("score", score)
    return scored.select(
        "unit",
        "critical_count",
        "score",
        grade(F.col("score"), [(33, "low"), (66, "medium")], "high").alias("band"),
        (F.col("score") >= 80).alias("over_threshold"),
    )


def metric_scatter(
    df: DataFrame, x: str, y: str, hue: str | None, key: Sequence[str]
) -> DataFrame:
    """Both values of every row; take a sample first where fewer points are wanted."""
    shown = [col(x).alias("x"), col(y).alias("y")]
    if hue:
        shown.append(col(hue).alias("hue"))
    return df.select(*[col(k) for k in key], *shown)

