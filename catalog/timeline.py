"""Daily series, features, moving averages and growth."""

from __future__ import annotations

from catalog.frames import OPEN_ORDERS, open_orders, table
from catalog.registry import query
from tabgauge.operators.series import (
    calendar_features,
    category_features,
    daily_category_counts,
    daily_category_share,
    daily_mean,
    future_days,
    growth,
    history_tail,
    lag_features_backfill,
    lag_features_zero,
    moving_average,
    numeric_features,
    rolling_mean_partial,
    trend_direction,
    trend_index,
)

# Daily means, gaps repeating the day before; orders leave out some days.
DAILY = f"""(WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS y
        FROM {OPEN_ORDERS} AS t WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1),
    s AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM o)
    SELECT s.day, last_value(y IGNORE NULLS) OVER (ORDER BY s.day) AS y
    FROM s LEFT JOIN o ON s.day = o.day)"""


def daily(spark, sf_dir):
    return daily_mean(open_orders(spark, sf_dir), "o_orderdate", "o_totalprice")


@query(
    "moving_average",
    """SELECT stamp, mean, CASE WHEN count(mean) OVER w = 7 THEN avg(mean) OVER w END AS moving_average
    FROM (SELECT ts AS stamp, avg("value") AS mean FROM events GROUP BY 1) AS t
    WINDOW w AS (ORDER BY stamp ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    mean=4,
    moving_average=4,
)
def _moving_average(spark, sf_dir):
    return moving_average(table(spark, sf_dir, "events"), "ts", "value")


@query("daily_mean", f"SELECT * FROM {DAILY} AS d", y=2)
def _daily_mean(spark, sf_dir):
    return daily(spark, sf_dir)


USER_DAYS = """(WITH o AS (SELECT user_id, CAST(ts AS DATE) AS day, avg("value") AS y
        FROM events GROUP BY 1, 2),
    s AS (SELECT user_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day
        FROM o GROUP BY user_id)
    SELECT s.user_id, s.day, last_value(y IGNORE NULLS) OVER (PARTITION BY s.user_id ORDER BY s.day) AS y
    FROM s LEFT JOIN o ON s.day = o.day AND s.user_id = o.user_id)"""


@query("daily_mean_per_user", f"SELECT * FROM {USER_DAYS} AS d", y=4)
def _daily_mean_per_user(spark, sf_dir):
    return daily_mean(table(spark, sf_dir, "events"), "ts", "value", ["user_id"])


SPARSE = f"""(SELECT o_orderpriority AS category, CAST(o_orderdate AS DATE) AS day, count(*) AS n
    FROM {OPEN_ORDERS} AS x WHERE o_orderpriority IS NOT NULL AND o_orderdate IS NOT NULL
    GROUP BY 1, 2)"""
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]
COUNTS = """(SELECT c.category, d.day, coalesce(n, 0) AS n FROM
    (SELECT unnest({p}) AS category) AS c
    CROSS JOIN (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM {t} AS b
        WHERE o_orderpriority IS NOT NULL AND o_orderdate IS NOT NULL) AS d
    LEFT JOIN (SELECT o_orderpriority AS category, CAST(o_orderdate AS DATE) AS day, count(*) AS n
        FROM {t} AS x GROUP BY 1, 2) AS k ON k.category = c.category AND k.day = d.day)""".format(
    t=OPEN_ORDERS, p=PRIORITIES
)


@query("daily_category_counts", f"SELECT * FROM {SPARSE} AS c")
def _daily_category_counts(spark, sf_dir):
    return daily_category_counts(open_orders(spark, sf_dir), "o_orderdate", "o_orderpriority")


@query("daily_category_counts_named", f"SELECT * FROM {COUNTS} AS c")
def _daily_category_counts_named(spark, sf_dir):
    return daily_category_counts(
        open_orders(spark, sf_dir), "o_orderdate", "o_orderpriority", named=PRIORITIES
    )


@query(
    "daily_category_share",
    f"SELECT category, day, n, n / sum(n) OVER (PARTITION BY day) AS share FROM {SPARSE} AS c",
    share=6,
)
def _daily_category_share(spark, sf_dir):
    return daily_category_share(open_orders(spark, sf_dir), "o_orderdate", "o_orderpriority")


WEEK_MONTH = """CAST(isodow(day) - 1 AS INTEGER) AS day_of_week,
    CAST(month(day) AS INTEGER) AS "month", CAST(day(day) AS INTEGER) AS day_of_month"""
CALENDAR = WEEK_MONTH + ", CAST(quarter(day) AS INTEGER) AS quarter"


@query("calendar_features", f"SELECT day, y, {CALENDAR} FROM {DAILY} AS d", y=2)
def _calendar_features(spark, sf_dir):
    return calendar_features(daily(spark, sf_dir))


@query(
    "trend_index",
    f"SELECT day, y, CAST(row_number() OVER (ORDER BY day) - 1 AS INTEGER) AS trend FROM {DAILY} AS d",
    y=2,
)
def _trend_index(spark, sf_dir):
    return trend_index(daily(spark, sf_dir))


@query(
    "lag_features_zero",
    f"""SELECT category, day, n, CAST(coalesce(lag(n, 1) OVER w, 0) AS DOUBLE) AS lag1,
    CAST(coalesce(lag(n, 7) OVER w, 0) AS DOUBLE) AS lag7 FROM {COUNTS} AS c
    WINDOW w AS (PARTITION BY category ORDER BY day)""",
)
def _lag_features_zero(spark, sf_dir):
    counts = daily_category_counts(
        open_orders(spark, sf_dir), "o_orderdate", "o_orderpriority", named=PRIORITIES
    )
    return lag_features_zero(counts, "n", ["category"])


BACKFILLED = """CASE WHEN count(*) OVER (PARTITION BY {p}) > {k}
    THEN coalesce(lag(y, {k}) OVER (PARTITION BY {p} ORDER BY day),
    first_value(y) OVER (PARTITION BY {p} ORDER BY day)) END AS lag{k}"""


@query(
    "lag_features_backfill",
    f"""SELECT user_id, day, y, {BACKFILLED.format(p='user_id', k=1)},
    {BACKFILLED.format(p='user_id', k=7)} FROM {USER_DAYS} AS d""",
    y=4,
    lag1=4,
    lag7=4,
)
def _lag_features_backfill(spark, sf_dir):
    series = daily_mean(table(spark, sf_dir, "events"), "ts", "value", ["user_id"])
    return lag_features_backfill(series, by=["user_id"])


@query(
    "rolling_mean_partial",
    f"""SELECT day, y, avg(y) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling7
    FROM {DAILY} AS d""",
    y=2,
    rolling7=2,
)
def _rolling_mean_partial(spark, sf_dir):
    return rolling_mean_partial(daily(spark, sf_dir))


@query(
    "future_days",
    f"""SELECT CAST(unnest(generate_series(max(day) + INTERVAL 1 DAY, max(day) + INTERVAL 30 DAY,
    INTERVAL 1 DAY)) AS DATE) AS day FROM {DAILY} AS d""",
)
def _future_days(spark, sf_dir):
    return future_days(daily(spark, sf_dir), 30)


@query("history_tail", f"SELECT * FROM {DAILY} AS d ORDER BY day DESC LIMIT 60", y=2)
def _history_tail(spark, sf_dir):
    return history_tail(daily(spark, sf_dir), 60)


@query(
    "growth",
    """SELECT true AS has_time, a AS first_value, b AS last_value, (b - a) / a * 100 AS growth FROM
    (SELECT o_totalprice AS a FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1) AS f,
    (SELECT o_totalprice AS b FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS l""",
    growth=4,
)
def _growth(spark, sf_dir):
    return growth(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", ["o_orderkey"])


DAY_MEANS = "(SELECT o_orderdate AS stamp, avg(o_totalprice) AS mean FROM orders GROUP BY 1)"


@query(
    "trend_direction",
    f"""SELECT a AS first_mean, b AS last_mean, CASE WHEN b > a THEN 'Increasing'
    WHEN b < a THEN 'Decreasing' ELSE 'Stable' END AS direction FROM
    (SELECT mean AS a FROM {DAY_MEANS} AS m ORDER BY stamp LIMIT 1) AS f,
    (SELECT mean AS b FROM {DAY_MEANS} AS m ORDER BY stamp DESC LIMIT 1) AS l""",
    first_mean=2,
    last_mean=2,
)
def _trend_direction(spark, sf_dir):
    return trend_direction(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice")


@query(
    "forecast_features_numeric",
    f"""SELECT user_id, day, y, {CALENDAR},
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS INTEGER) AS trend,
    {BACKFILLED.format(p='user_id', k=1)}, {BACKFILLED.format(p='user_id', k=7)},
    avg(y) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling7
    FROM {USER_DAYS} AS d""",
    y=4,
    lag1=4,
    lag7=4,
    rolling7=4,
)
def _forecast_features_numeric(spark, sf_dir):
    return numeric_features(table(spark, sf_dir, "events"), "ts", "value", ["user_id"])


@query(
    "forecast_features_category",
    f"""SELECT category, day, CAST(n AS DOUBLE) AS y, {WEEK_MONTH},
    CAST(row_number() OVER (PARTITION BY category ORDER BY day) - 1 AS INTEGER) AS trend,
    CAST(coalesce(lag(n, 1) OVER w, 0) AS DOUBLE) AS lag1,
    CAST(coalesce(lag(n, 7) OVER w, 0) AS DOUBLE) AS lag7,
    avg(n) OVER (PARTITION BY category ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling7
    FROM {COUNTS} AS c WINDOW w AS (PARTITION BY category ORDER BY day)""",
    rolling7=4,
)
def _forecast_features_category(spark, sf_dir):
    return category_features(
        open_orders(spark, sf_dir), "o_orderdate", "o_orderpriority", named=PRIORITIES
    )
