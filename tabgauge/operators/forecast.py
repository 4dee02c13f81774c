"""Summaries of daily forecasts, whichever model made them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgauge.functions.expr import col


def forecast_category_summary(forecast: DataFrame) -> DataFrame:
    """Per category: total and peak cut to whole numbers, daily mean, peak day."""
    peak = F.min(F.struct((-F.col("prediction")).alias("p"), "day"))
    summary = forecast.groupBy("category").agg(
        F.sum("prediction").alias("__sum"),
        F.avg("prediction").alias("daily_average"),
        peak["day"].alias("peak_day"),
        (-peak["p"]).cast("bigint").alias("peak_count"),
    )
    # The largest sum, the first category on ties.
    first = summary.agg(
        F.min(F.struct((-F.col("__sum")).alias("s"), "category"))["category"]
    ).scalar()
    return summary.select(
        "category",
        F.col("__sum").cast("bigint").alias("total"),
        "daily_average",
        "peak_day",
        "peak_count",
        F.col("category").eqNullSafe(first).alias("dominant"),
    )


def forecast_numeric_summary(
    history: DataFrame, forecast: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Current value, predicted mean, high and low, change and its direction."""
    keys = [col(c) for c in by]
    both = history.select(
        *keys, "day", F.col("y").alias("y"), F.lit(None).cast("double").alias("p")
    ).unionByName(
        forecast.select(*keys, "day", F.lit(None).cast("double").alias("y"), F.col("prediction").alias("p"))
    )
    facts = both.groupBy(*keys).agg(
        F.max_by("y", F.when(F.col("y").isNotNull(), F.col("day"))).alias("current"),
        F.avg("p").alias("mean"),
        F.max("p").alias("high"),
        F.min("p").alias("low"),
    )
    moved = F.try_divide((F.col("mean") - F.col("current")) * 100.0, F.col("current"))
    change = F.when(F.col("current") != 0, moved).otherwise(0.0)
    return facts.withColumn("change_pct", change).withColumn(
        "direction",
        F.when(F.col("change_pct") > 2, "up")
        .when(F.col("change_pct") < -2, "down")
        .otherwise("level"),
    )
