"""Profiles of columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.frames import (
    LABELLED,
    LABELLED_COLUMNS,
    LABELLED_TYPES,
    OPEN_ORDERS,
    PART_NAMES,
    SALES,
    SALES_NUMBERS,
    each,
    fences,
    labelled,
    missing_sum,
    open_orders,
    part_names,
    sales,
    table,
)
from catalog.registry import query
from tabgauge.operators.profile import (
    box_stats,
    cardinality,
    categorical_stats,
    category_insights,
    column_metrics,
    column_outliers,
    column_summary,
    complete_columns,
    constant_columns,
    describe,
    duplicate_stats,
    histogram,
    iqr_fences,
    missing_cells,
    numeric_insights,
    outlier_cells,
    problem_columns,
    profile_report,
    shape,
    value_counts,
    zscore_outliers,
)

ORDER_COLUMNS = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate", "o_custkey"]
ORDER_TYPES = ["bigint", "string", "double", "string", "timestamp_ntz", "bigint"]
LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax"]
NUMERIC = ("bigint", "int", "double")


def mean_of(columns: list[str], types: list[str]) -> list[str]:
    return [f"avg({c})" if t in NUMERIC else "NULL" for c, t in zip(columns, types)]


@query(
    "column_summary",
    each(
        ORDER_COLUMNS,
        """SELECT '{c}' AS "column", '{t}' AS "type", count(*) - count({c}) AS missing,
        count(DISTINCT {c}) AS "unique", CAST({m} AS DOUBLE) AS mean FROM """ + OPEN_ORDERS + " AS t",
        t=ORDER_TYPES,
        m=mean_of(ORDER_COLUMNS, ORDER_TYPES),
    ),
    mean=2,
)
def _column_summary(spark, sf_dir):
    return column_summary(open_orders(spark, sf_dir))


LINE_COLUMNS = [*LINE_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]
LINE_TYPES = ["bigint", "bigint", "bigint", "int", "double", "double", "double", "double",
              "string", "string", "timestamp_ntz"]


@query(
    "column_summary_lineitem",
    each(
        LINE_COLUMNS,
        """SELECT '{c}' AS "column", '{t}' AS "type", count(*) - count({c}) AS missing,
        count(DISTINCT {c}) AS "unique", CAST({m} AS DOUBLE) AS mean FROM lineitem""",
        t=LINE_TYPES,
        m=mean_of(LINE_COLUMNS, LINE_TYPES),
    ),
    mean=2,
)
def _column_summary_lineitem(spark, sf_dir):
    return column_summary(table(spark, sf_dir, "lineitem"))


@query(
    "column_metrics_numeric",
    f"""SELECT 'o_custkey' AS "column", 'bigint' AS "type", count(*) - count(o_custkey) AS missing,
    (count(*) - count(o_custkey)) * 100.0 / count(*) AS missing_pct,
    count(DISTINCT o_custkey) AS "unique", avg(o_custkey) AS mean, CAST(NULL AS VARCHAR) AS mode
    FROM {OPEN_ORDERS} AS t""",
    missing_pct=4,
    mean=4,
)
def _column_metrics_numeric(spark, sf_dir):
    return column_metrics(open_orders(spark, sf_dir), "o_custkey")


TOP_PRIORITY = f"""(SELECT o_orderpriority FROM {OPEN_ORDERS} AS m WHERE o_orderpriority IS NOT NULL
    GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"""


@query(
    "column_metrics_text",
    f"""SELECT 'o_orderpriority' AS "column", 'string' AS "type",
    count(*) - count(o_orderpriority) AS missing,
    (count(*) - count(o_orderpriority)) * 100.0 / count(*) AS missing_pct,
    count(DISTINCT o_orderpriority) AS "unique", CAST(NULL AS DOUBLE) AS mean,
    {TOP_PRIORITY} AS mode FROM {OPEN_ORDERS} AS t""",
    missing_pct=4,
)
def _column_metrics_text(spark, sf_dir):
    return column_metrics(open_orders(spark, sf_dir), "o_orderpriority")


def describe_sql(source: str, c: str) -> str:
    return f"""SELECT count({c}) AS "count", avg({c}) AS mean, stddev_samp({c}) AS std,
    CAST(min({c}) AS DOUBLE) AS min, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25,
    quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q50, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75,
    CAST(max({c}) AS DOUBLE) AS max FROM {source} AS t"""


DESCRIBED = dict(mean=2, std=2, min=2, q25=2, q50=2, q75=2, max=2)


@query("describe", describe_sql("lineitem", "l_extendedprice"), **DESCRIBED)
def _describe(spark, sf_dir):
    return describe(table(spark, sf_dir, "lineitem"), "l_extendedprice")


@query("describe_gaps", describe_sql(OPEN_ORDERS, "o_totalprice"), **DESCRIBED)
def _describe_gaps(spark, sf_dir):
    return describe(open_orders(spark, sf_dir), "o_totalprice")


@query(
    "shape",
    'SELECT skewness("value") AS skew, kurtosis("value") AS kurtosis FROM events',
    skew=4,
    kurtosis=4,
)
def _shape(spark, sf_dir):
    return shape(table(spark, sf_dir, "events"), "value")


@query(
    "categorical_stats",
    f"""SELECT count(*) AS total, count(DISTINCT o_orderpriority) AS "unique",
    count(*) - count(o_orderpriority) AS missing, {TOP_PRIORITY} AS mode,
    (SELECT count(*) FROM {OPEN_ORDERS} AS n WHERE o_orderpriority = {TOP_PRIORITY}) AS mode_count,
    (SELECT count(*) FROM {OPEN_ORDERS} AS n WHERE o_orderpriority = {TOP_PRIORITY}) * 100.0 / count(*)
    AS mode_pct FROM {OPEN_ORDERS} AS t""",
    mode_pct=4,
)
def _categorical_stats(spark, sf_dir):
    return categorical_stats(open_orders(spark, sf_dir), "o_orderpriority")


@query(
    "value_counts",
    """SELECT "text" AS "value", count(*) AS n FROM documents GROUP BY 1
    ORDER BY n DESC, "value" LIMIT 20""",
)
def _value_counts(spark, sf_dir):
    return value_counts(table(spark, sf_dir, "documents"), "text")


@query(
    "value_counts_all",
    f"""SELECT o_orderpriority AS "value", count(*) AS n FROM {OPEN_ORDERS} AS t
    WHERE o_orderpriority IS NOT NULL GROUP BY 1""",
)
def _value_counts_all(spark, sf_dir):
    return value_counts(open_orders(spark, sf_dir), "o_orderpriority", None)


@query(
    "missing_cells",
    f"""SELECT cells, missing, missing * 100.0 / cells AS missing_pct,
    (cells - missing) * 100.0 / cells AS completeness FROM (
    SELECT count(*) * 6 AS cells, {missing_sum(ORDER_COLUMNS)} AS missing FROM {OPEN_ORDERS} AS t) AS c""",
    missing_pct=4,
    completeness=4,
)
def _missing_cells(spark, sf_dir):
    return missing_cells(open_orders(spark, sf_dir))


@query(
    "problem_columns",
    f"""SELECT "column", missing, missing * 100.0 / n AS missing_pct FROM ({each(
        LABELLED_COLUMNS,
        '''SELECT '{c}' AS "column", count(*) - count({c}) AS missing, count(*) AS n FROM '''
        + LABELLED + " AS t",
    )}) AS c WHERE missing > n * 0.1""",
    missing_pct=4,
)
def _problem_columns(spark, sf_dir):
    return problem_columns(labelled(spark, sf_dir))


@query(
    "complete_columns",
    f"""SELECT count(*) FILTER (missing = 0) AS complete, count(*) AS columns FROM ({each(
        LABELLED_COLUMNS,
        "SELECT count(*) - count({c}) AS missing FROM " + LABELLED + " AS t",
    )}) AS c""",
)
def _complete_columns(spark, sf_dir):
    return complete_columns(labelled(spark, sf_dir))


@query(
    "duplicate_stats",
    f"""SELECT CAST(sum(n) AS BIGINT) AS "rows", CAST(sum(n - 1) AS BIGINT) AS duplicates,
    sum(n - 1) * 100.0 / sum(n) AS duplicate_pct FROM (
    SELECT count(*) AS n FROM {PART_NAMES} AS t GROUP BY p_name, p_brand, p_type) AS c""",
    duplicate_pct=4,
)
def _duplicate_stats(spark, sf_dir):
    return duplicate_stats(part_names(spark, sf_dir))


def outliers_sql(source: str, columns: list[str]) -> str:
    return each(
        columns,
        """SELECT {i} AS "position", '{c}' AS "column", low, high,
        count(*) FILTER ({c} < low OR {c} > high) AS outliers FROM """
        + source
        + " AS t, {f} AS f GROUP BY low, high",
        f=[fences(source, c) for c in columns],
    )


@query(
    "outlier_cells",
    f"""SELECT n AS "rows", CAST(o AS BIGINT) AS outliers, o * 100.0 / n AS outlier_pct FROM
    (SELECT sum(outliers) AS o FROM ({outliers_sql(LABELLED, ['doc_id', 'n_chars', 'quality', 'toxic'])}) AS c) AS s,
    (SELECT count(*) AS n FROM documents) AS d""",
    outlier_pct=4,
)
def _outlier_cells(spark, sf_dir):
    return outlier_cells(labelled(spark, sf_dir))


@query("column_outliers", outliers_sql("lineitem", LINE_NUMBERS), low=4, high=4)
def _column_outliers(spark, sf_dir):
    return column_outliers(table(spark, sf_dir, "lineitem"))


@query("column_outliers_sales", outliers_sql(SALES, SALES_NUMBERS), low=4, high=4)
def _column_outliers_sales(spark, sf_dir):
    return column_outliers(sales(spark, sf_dir))


@query(
    "iqr_fences",
    each(
        SALES_NUMBERS,
        """SELECT '{c}' AS "column", q1, q3, q3 - q1 AS iqr, low, high FROM {f} AS f""",
        f=[fences(SALES, c) for c in SALES_NUMBERS],
    ),
    q1=4,
    q3=4,
    iqr=4,
    low=4,
    high=4,
)
def _iqr_fences(spark, sf_dir):
    return iqr_fences(sales(spark, sf_dir))


@query(
    "box_stats",
    f"""SELECT q1, (SELECT quantile_cont("value", 0.5) FROM events) AS median, q3, low, high,
    min("value") FILTER ("value" BETWEEN low AND high) AS whisker_low,
    max("value") FILTER ("value" BETWEEN low AND high) AS whisker_high,
    count(*) FILTER ("value" < low OR "value" > high) AS outliers
    FROM events, {fences('events', 'value')} AS f GROUP BY q1, q3, low, high""",
    q1=4,
    median=4,
    q3=4,
    low=4,
    high=4,
    whisker_low=4,
    whisker_high=4,
)
def _box_stats(spark, sf_dir):
    return box_stats(table(spark, sf_dir, "events"), "value")


@query(
    "histogram",
    """WITH e AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders),
    c AS (SELECT CAST(least(floor((o_totalprice - a) / ((b - a) / 30)), 29) AS INTEGER) AS bin,
        count(*) AS n FROM orders, e GROUP BY 1)
    SELECT CAST(g.i AS INTEGER) AS bin, a + g.i * ((b - a) / 30) AS low,
    a + (g.i + 1) * ((b - a) / 30) AS high, coalesce(n, 0) AS n
    FROM e, range(30) AS g(i) LEFT JOIN c ON c.bin = g.i""",
    low=2,
    high=2,
)
def _histogram(spark, sf_dir):
    return histogram(table(spark, sf_dir, "orders"), "o_totalprice")


def profile_sql(sample: bool) -> str:
    def first(c: str) -> str:
        return f"""(SELECT string_agg(CAST(v AS VARCHAR), ', ' ORDER BY doc_id) FROM (
            SELECT doc_id, {c} AS v FROM {LABELLED} AS s WHERE {c} IS NOT NULL
            ORDER BY doc_id LIMIT 3) AS f)"""

    more = ", {s} AS sample" if sample else ""
    return each(
        LABELLED_COLUMNS,
        """SELECT '{c}' AS "column", '{t}' AS "type", count(*) - count({c}) AS missing,
        (count(*) - count({c})) * 100.0 / count(*) AS missing_pct, count(DISTINCT {c}) AS "unique",
        CASE WHEN count(*) = count({c}) THEN 'Excellent'
        WHEN (count(*) - count({c})) * 100.0 / count(*) < 5 THEN 'Good' ELSE 'Poor' END AS quality"""
        + more
        + " FROM "
        + LABELLED
        + " AS t",
        t=LABELLED_TYPES,
        s=[first(c) for c in LABELLED_COLUMNS],
    )


@query("profile_report", profile_sql(True), missing_pct=4)
def _profile_report(spark, sf_dir):
    return profile_report(labelled(spark, sf_dir), ["doc_id"])


@query("profile_report_short", profile_sql(False), missing_pct=4)
def _profile_report_short(spark, sf_dir):
    return profile_report(labelled(spark, sf_dir))


CONSTANT_COLUMNS = [*LINE_COLUMNS, "flag_length", "dated"]
CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query(
    "cardinality",
    f"""SELECT "column", u AS "unique", u * 100.0 / n AS unique_pct,
    CASE WHEN u = 1 THEN 'Constant' WHEN u = n THEN 'Unique ID'
    WHEN u * 100.0 / n > 95 THEN 'High Cardinality' WHEN u * 100.0 / n < 5 THEN 'Low Cardinality'
    ELSE 'Medium' END AS category FROM ({each(
        CUSTOMER,
        '''SELECT '{c}' AS "column", count(DISTINCT {c}) AS u, count(*) AS n FROM customer''',
    )}) AS c""",
    unique_pct=4,
)
def _cardinality(spark, sf_dir):
    return cardinality(table(spark, sf_dir, "customer"))


@query(
    "constant_columns",
    f"""SELECT "position", "column" FROM ({each(
        CONSTANT_COLUMNS,
        'SELECT {i} AS "position", \'{c}\' AS "column", count(DISTINCT {c}) AS u FROM '
        + "(SELECT *, length(l_returnflag) AS flag_length, year(l_shipdate) > 1900 AS dated "
        + "FROM lineitem) AS t",
    )}) AS c WHERE u = 1""",
)
def _constant_columns(spark, sf_dir):
    """All line items, with two derived columns that do not vary."""
    lines = table(spark, sf_dir, "lineitem")
    return constant_columns(
        lines.withColumns(
            {"flag_length": F.length("l_returnflag"), "dated": F.year("l_shipdate") > 1900}
        )
    )


@query(
    "zscore_outliers",
    f"""SELECT CAST(sum(n) AS BIGINT) AS z_outliers FROM ({each(
        ['event_id', 'user_id', '"value"'],
        '''SELECT count(*) FILTER (abs(({c} - m) / nullif(s, 0)) > 3) AS n FROM events,
        (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM events) AS f''',
    )}) AS t""",
)
def _zscore_outliers(spark, sf_dir):
    return zscore_outliers(table(spark, sf_dir, "events"))


@query(
    "numeric_insights",
    each(
        LINE_NUMBERS,
        """SELECT {i} AS "position", '{c}' AS "column", avg({c}) AS mean,
        CAST(max({c}) AS DOUBLE) AS max, CAST(min({c}) AS DOUBLE) AS min,
        stddev_samp({c}) AS std FROM lineitem""",
    ),
    mean=2,
    std=2,
)
def _numeric_insights(spark, sf_dir):
    return numeric_insights(table(spark, sf_dir, "lineitem"))


def top_values_sql(source: str, columns: list[str]) -> str:
    return each(
        columns,
        """SELECT * FROM (SELECT {i} AS "position", '{c}' AS "column",
        CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS "rank",
        {c} AS "value", count(*) AS n FROM """
        + source
        + " AS t WHERE {c} IS NOT NULL GROUP BY {c}) AS r{i} WHERE \"rank\" <= 5",
    )


@query("category_insights", top_values_sql(OPEN_ORDERS, ["o_orderstatus", "o_orderpriority"]))
def _category_insights(spark, sf_dir):
    return category_insights(open_orders(spark, sf_dir))
