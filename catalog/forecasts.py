"""Summaries of forecasts, checked on given series."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.frames import table
from catalog.registry import query
from tabgauge.operators.forecast import (
    forecast_category_summary,
    forecast_numeric_summary,
)
from tabgauge.operators.series import daily_category_counts, daily_mean


@query(
    "forecast_category_summary",
    """WITH c AS (SELECT o_orderpriority AS category, CAST(o_orderdate AS DATE) AS day,
        count(*) * 1.25 AS p FROM orders GROUP BY 1, 2),
    f AS (SELECT * FROM c),
    s AS (SELECT category, sum(p) AS total, avg(p) AS daily_average, max(p) AS peak FROM f GROUP BY 1)
    SELECT category, CAST(trunc(total) AS BIGINT) AS total, daily_average,
    (SELECT min(day) FROM f WHERE f.category = s.category AND f.p = s.peak) AS peak_day,
    CAST(trunc(peak) AS BIGINT) AS peak_count,
    row_number() OVER (ORDER BY total DESC, category) = 1 AS dominant FROM s""",
    daily_average=4,
)
def _forecast_category_summary(spark, sf_dir):
    """The summary over observed counts, scaled, in place of predictions."""
    counts = daily_category_counts(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderpriority")
    given = counts.select("category", "day", (F.col("n") * 1.25).alias("prediction"))
    return forecast_category_summary(given)


@query(
    "forecast_numeric_summary",
    """WITH e AS (SELECT event_type, user_id, CAST(ts AS DATE) AS day, "value" FROM events),
    h AS (SELECT event_type, day, avg("value") AS y FROM e GROUP BY 1, 2),
    p AS (SELECT event_type, user_id, avg("value") AS q FROM e GROUP BY 1, 2),
    c AS (SELECT event_type, arg_max(y, day) AS current FROM h GROUP BY 1),
    s AS (SELECT event_type, avg(q) AS mean, max(q) AS high, min(q) AS low FROM p GROUP BY 1),
    j AS (SELECT c.event_type, current, mean, high, low,
        CASE WHEN current <> 0 THEN (mean - current) / current * 100 ELSE 0 END AS change_pct
        FROM c JOIN s ON c.event_type = s.event_type)
    SELECT *, CASE WHEN change_pct > 2 THEN 'up' WHEN change_pct < -2 THEN 'down'
    ELSE 'level' END AS direction FROM j""",
    current=4,
    mean=4,
    high=4,
    low=4,
    change_pct=4,
)
def _forecast_numeric_summary(spark, sf_dir):
    """The summary with one mean per user in place of each predicted day."""
    events = table(spark, sf_dir, "events")
    history = daily_mean(events, "ts", "value", ["event_type"])
    given = events.groupBy("event_type", "user_id").agg(F.avg("value").alias("prediction")).select(
        "event_type", F.lit("2024-02-01").cast("date").alias("day"), "prediction"
    )
    return forecast_numeric_summary(history, given, ["event_type"])
