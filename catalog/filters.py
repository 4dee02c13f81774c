"""Row filters and projections."""

from __future__ import annotations

from catalog.frames import (
    OPEN_ORDERS,
    PART_NAMES,
    fences,
    open_orders,
    part_names,
    table,
)
from catalog.registry import query
from tabgauge.operators.clean import (
    drop_missing_rows,
    filter_category,
    filter_values,
    rows_above_threshold,
    rows_duplicated,
    rows_missing,
    rows_outlier,
)
from tabgauge.plans.agent import date_text_filter, project_relevant, question_context


@query("rows_missing", f"SELECT * FROM {OPEN_ORDERS} AS t WHERE o_totalprice IS NULL")
def _rows_missing(spark, sf_dir):
    return rows_missing(open_orders(spark, sf_dir), "o_totalprice")


@query(
    "rows_duplicated",
    f"""SELECT p_name, p_brand, p_type FROM (
    SELECT *, count(*) OVER (PARTITION BY p_name, p_brand, p_type) AS n FROM {PART_NAMES} AS t
    ) AS c WHERE n > 1""",
)
def _rows_duplicated(spark, sf_dir):
    return rows_duplicated(part_names(spark, sf_dir))


@query(
    "rows_outlier",
    f"""SELECT t.* FROM events AS t, {fences('events', 'value')} AS f
    WHERE value < low OR value > high""",
)
def _rows_outlier(spark, sf_dir):
    return rows_outlier(table(spark, sf_dir, "events"), "value")


@query(
    "rows_above_threshold",
    f"SELECT t.* FROM events AS t, {fences('events', 'value')} AS f WHERE value > high",
)
def _rows_above_threshold(spark, sf_dir):
    return rows_above_threshold(table(spark, sf_dir, "events"), "value")


@query(
    "drop_missing_rows",
    f"""SELECT * FROM {OPEN_ORDERS} AS t WHERE o_totalprice IS NOT NULL
    AND o_orderpriority IS NOT NULL AND o_orderdate IS NOT NULL AND o_custkey IS NOT NULL""",
)
def _drop_missing_rows(spark, sf_dir):
    return drop_missing_rows(open_orders(spark, sf_dir))


@query("filter_category", "SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'")
def _filter_category(spark, sf_dir):
    return filter_category(table(spark, sf_dir, "orders"), "o_orderpriority", "1-URGENT")


@query(
    "filter_values",
    f"""SELECT DISTINCT o_orderpriority AS "value" FROM {OPEN_ORDERS} AS t
    WHERE o_orderpriority IS NOT NULL""",
)
def _filter_values(spark, sf_dir):
    return filter_values(open_orders(spark, sf_dir), "o_orderpriority")


@query(
    "date_text_filter",
    "SELECT * FROM orders WHERE contains(CAST(o_orderdate AS VARCHAR), '01-01')",
)
def _date_text_filter(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return date_text_filter(orders, "o_orderdate", "What was sold on Jan 15?")


@query(
    "project_relevant",
    "SELECT o_totalprice, o_orderdate FROM orders",
)
def _project_relevant(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return project_relevant(
        orders, ["o_totalprice", "o_orderdate"], "o_orderdate", ["o_orderkey"]
    )


@query(
    "question_context",
    """SELECT o_orderstatus, o_totalprice, o_orderdate FROM orders
    WHERE contains(CAST(o_orderdate AS VARCHAR), '02-01')""",
)
def _question_context(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    question = "Which orderstatus had the highest totalprice on feb 1?"
    return question_context(orders, question, ["o_orderkey"])
