"""Daily series, calendar and lag features, moving averages and growth.

Raw rows are first merged to one row per series and day (partial aggregation
before the shuffle), so every window below runs over days, per series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabgauge.functions.expr import col
from tabgauge.functions.rules import MAX_HORIZON
from tabgauge.operators.groups import date_means
from tabgauge.operators.ordering import over_previous, with_row_number
from tabgauge.operators.quantiles import number
from tabgauge.operators.roles import parsed_time


def moving_average(df: DataFrame, date: str, metric: str, window: int = 7) -> DataFrame:
    """Mean per date value and its moving average over the last ``window`` of them.

    By position, not by calendar; null until the window is full. A table with
    fewer dates than the window uses as many as there are.
    """
    means = with_row_number(date_means(df, date, metric), ["stamp"], "place")
    averaged = over_previous(
        means, window, {"filled": F.count("mean"), "average": F.avg("mean")}, number="place"
    )
    size = F.least(F.lit(window), means.agg(F.count(F.lit(1))).scalar())
    full = F.when(F.col("filled") == size, F.col("average"))
    return averaged.select("stamp", "mean", full.alias("moving_average"))


def day_of(df: DataFrame, date: str) -> Column:
    return F.to_date(parsed_time(df, date))


def daily_mean(
    df: DataFrame, date: str, metric: str, by: Sequence[str] = ()
) -> DataFrame:
    """(by..., day, y): mean per day, days without rows repeating the day before.

    Each observed day is stretched up to the day before the next one, so the
    gaps are filled without a calendar join.
    """
    keys = [col(c) for c in by]
    value = number(df, metric)
    day = day_of(df, date)
    observed = (
        df.where(day.isNotNull() & value.isNotNull())
        .groupBy(*keys, day.alias("day"))
        .agg(F.avg(value).alias("y"))
    )
    order = Window.partitionBy(*keys).orderBy("day")
    until = F.coalesce(F.date_sub(F.lead("day").over(order), 1), F.col("day"))
    return observed.withColumn("__until", until).select(
        *keys, F.explode(F.sequence("day", "__until")).alias("day"), "y"
    )


def daily_category_counts(
    df: DataFrame,
    date: str,
    category: str,
    by: Sequence[str] = (),
    named: Sequence[str] = (),
) -> DataFrame:
    """(by..., category, day, n): rows per category and day.

    Only what occurs is listed. The ``named`` categories also get 0 on each day that
    occurs without them.
    """
    keys = [col(c) for c in by]
    day = day_of(df, date)
    counted = (
        df.where(day.isNotNull() & col(category).isNotNull())
        .groupBy(*keys, col(category).alias("category"), day.alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if not named:
        return counted
    kind = df.schema[category].dataType
    listed = F.array(*[F.lit(c).cast(kind) for c in dict.fromkeys(named)])
    zeros = (
        counted.select(*keys, "day")
        .distinct()
        .select(
            *keys,
            F.explode(listed).alias("category"),
            "day",
            F.lit(0).cast("bigint").alias("n"),
        )
    )
    return (
        counted.unionByName(zeros)
        .groupBy(*keys, "category", "day")
        .agg(F.sum("n").alias("n"))
    )


def daily_category_share(
    df: DataFrame, date: str, category: str, named: Sequence[str] = ()
) -> DataFrame:
    """The counts and each one's share of its day; the days' sums are joined back."""
    counts = daily_category_counts(df, date, category, named=named)
    whole = counts.groupBy("day").agg(F.sum("n").alias("__whole"))
    share = F.coalesce(F.try_divide(F.col("n"), F.col("__whole")), F.lit(0.0))
    return counts.join(whole, "day").select("category", "day", "n", share.alias("share"))


def calendar_features(frame: DataFrame, day: str = "day", quarter: bool = True) -> DataFrame:
    """Day of week (Monday 0), month, day of month and, if asked, quarter."""
    features = {
        "day_of_week": F.weekday(col(day)),
        "month": F.month(col(day)),
        "day_of_month": F.dayofmonth(col(day)),
    }
    if quarter:
        features["quarter"] = F.quarter(col(day))
    return frame.withColumns(features)


def _by_day(by: Sequence[str], day: str = "day"):
    return Window.partitionBy(*[col(c) for c in by]).orderBy(day)


def trend_index(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return series.withColumn("trend", F.row_number().over(_by_day(by)) - 1)


def lag_features_zero(series: DataFrame, y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Values 1 and 7 rows back, 0 where there is none."""
    order = _by_day(by)
    return series.withColumns(
        {
            f"lag{k}": F.coalesce(F.lag(y, k).over(order).cast("double"), F.lit(0.0))
            for k in (1, 7)
        }
    )


def lag_features_backfill(series: DataFrame, y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Values 1 and 7 rows back, the first value where there is none.

    A series no longer than the lag has no value to fill from and stays null.
    """
    order = _by_day(by)
    whole = Window.partitionBy(*[col(c) for c in by])
    start = F.first(y).over(order)
    return series.withColumns(
        {
            f"lag{k}": F.when(
                F.count(F.lit(1)).over(whole) > k,
                F.coalesce(F.lag(y, k).over(order), start),
            )
            for k in (1, 7)
        }
    )


def rolling_mean_partial(
    series: DataFrame, y: str = "y", by: Sequence[str] = (), size: int = 7, leak_free: bool = False
) -> DataFrame:
    """Mean of the last rows, the current one included unless ``leak_free``."""
    last = -1 if leak_free else 0
    window = _by_day(by).rowsBetween(last - size + 1, last)
    mean = F.avg(y).over(window)
    if leak_free:
        mean = F.coalesce(mean, F.first(y).over(_by_day(by)))
    return series.withColumn("rolling7", mean)


def numeric_features(
    df: DataFrame, date: str, metric: str, by: Sequence[str] = (), leak_free: bool = False
) -> DataFrame:
    """The training table of the numeric forecast."""
    series = daily_mean(df, date, metric, by)
    indexed = trend_index(calendar_features(series), by)
    return rolling_mean_partial(lag_features_backfill(indexed, by=by), by=by, leak_free=leak_free)


def category_features(
    df: DataFrame,
    date: str,
    category: str,
    by: Sequence[str] = (),
    leak_free: bool = False,
    named: Sequence[str] = (),
) -> DataFrame:
    """The training table of the category forecast, one series per category."""
    counts = daily_category_counts(df, date, category, by, named)
    series = counts.withColumn("y", F.col("n").cast("double")).drop("n")
    keys = [*by, "category"]
    indexed = trend_index(calendar_features(series, quarter=False), keys)
    return rolling_mean_partial(lag_features_zero(indexed, by=keys), by=keys, leak_free=leak_free)


def future_days(series: DataFrame, horizon: int, by: Sequence[str] = ()) -> DataFrame:
    """The days after the last one of each series."""
    if not 1 <= horizon <= MAX_HORIZON:
        raise ValueError(f"horizon must be 1 to {MAX_HORIZON} days")
    keys = [col(c) for c in by]
    last = series.groupBy(*keys).agg(F.max("day").alias("last"))
    days = F.sequence(F.date_add("last", 1), F.date_add("last", horizon))
    return last.where(F.col("last").isNotNull()).select(*keys, F.explode(days).alias("day"))


def history_tail(series: DataFrame, n: int = 60, by: Sequence[str] = ()) -> DataFrame:
    if not by:
        return series.orderBy(F.desc("day")).limit(n)
    order = Window.partitionBy(*[col(c) for c in by]).orderBy(F.desc("day"))
    return series.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r")


def growth(df: DataFrame, date: str, metric: str, key: Sequence[str]) -> DataFrame:
    """Change from the first to the last raw row by date, in percent."""
    time = parsed_time(df, date)
    place = F.struct(time.alias("t"), *[col(k).alias(f"k{i}") for i, k in enumerate(key)])
    value = number(df, metric)
    ends = df.where(time.isNotNull()).agg(
        F.count(F.lit(1)).alias("dated"),
        F.min_by(value, place).alias("first_value"),
        F.max_by(value, place).alias("last_value"),
    )
    change = F.try_divide(
        (F.col("last_value") - F.col("first_value")) * 100.0, F.col("first_value")
    )
    timed = F.col("dated") > 1
    return ends.select(
        timed.alias("has_time"),
        "first_value",
        "last_value",
        F.when(timed & (F.col("first_value") != 0), change)
        .when(timed & F.col("first_value").isNull(), F.lit(None).cast("double"))
        .otherwise(0.0)
        .alias("growth"),
    )


def trend_direction(df: DataFrame, date: str, metric: str) -> DataFrame:
    """Whether the last date's mean is above the first's."""
    means = date_means(df, date, metric)
    ends = means.agg(
        F.min_by("mean", "stamp").alias("first_mean"), F.max_by("mean", "stamp").alias("last_mean")
    )
    return ends.select(
        "first_mean",
        "last_mean",
        F.when(F.col("last_mean") > F.col("first_mean"), "Increasing")
        .when(F.col("last_mean") < F.col("first_mean"), "Decreasing")
        .otherwise("Stable")
        .alias("direction"),
    )
