"""Column roles, types and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.frames import (
    EVENT_PROPS,
    MACHINES,
    OPEN_ORDERS,
    each,
    event_props,
    machines,
    open_orders,
    table,
)
from catalog.registry import query
from tabgauge.operators.clean import (
    convert_type,
    dedupe_column_names,
    drop_column,
    encode_labels,
    rename_column,
)
from tabgauge.operators.roles import (
    classify_columns,
    context_date_column,
    date_columns_by_name,
    forecastable_columns,
    match_columns,
    metric_roles,
    text_looks_numeric,
    type_distribution,
)

PROPS_TYPES = ["bigint", "string", "string", "string"]


@query(
    "classify_columns",
    each(
        ["event_id", "event_type", "k", "day"],
        """SELECT {i} AS "position", '{c}' AS "column", '{t}' AS "type",
        {t!r} = 'bigint' AS is_numeric, {t!r} = 'string' AS is_text,
        coalesce({t!r} = 'string' AND bool_and({c} IS NULL OR
        try_cast(CAST({c} AS VARCHAR) AS TIMESTAMP) IS NOT NULL)
        AND bool_or(regexp_matches(CAST({c} AS VARCHAR), '[-/]')), false) AS is_date
        FROM """ + EVENT_PROPS + " AS t",
        t=PROPS_TYPES,
    ),
)
def _classify_columns(spark, sf_dir):
    return classify_columns(event_props(spark, sf_dir))


@query(
    "date_columns_by_name",
    """SELECT 10 AS "position", 'l_shipdate' AS "column", count(l_shipdate) AS filled,
    count(l_shipdate) AS parsed FROM lineitem""",
)
def _date_columns_by_name(spark, sf_dir):
    return date_columns_by_name(table(spark, sf_dir, "lineitem"))


@query(
    "context_date_column",
    f"""SELECT 4 AS "position", 'o_orderdate' AS "column", count(o_orderdate) AS filled,
    count(o_orderdate) AS parsed FROM {OPEN_ORDERS} AS t""",
)
def _context_date_column(spark, sf_dir):
    return context_date_column(open_orders(spark, sf_dir))


@query(
    "convert_numeric",
    f"""SELECT event_id, event_type, try_cast(trim(k) AS DOUBLE) AS k, day
    FROM {EVENT_PROPS} AS t""",
)
def _convert_numeric(spark, sf_dir):
    return convert_type(event_props(spark, sf_dir), "k", "numeric")


@query(
    "convert_text_numeric",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
    try_cast(o_orderpriority AS DOUBLE) AS o_orderpriority FROM orders""",
)
def _convert_text_numeric(spark, sf_dir):
    return convert_type(table(spark, sf_dir, "orders"), "o_orderpriority", "numeric")


@query(
    "convert_string",
    "SELECT doc_id, CAST(quality AS VARCHAR) AS quality, toxic FROM labels",
)
def _convert_string(spark, sf_dir):
    return convert_type(table(spark, sf_dir, "labels"), "quality", "string")


@query(
    "convert_datetime",
    f"""SELECT event_id, event_type, k, CAST(day AS TIMESTAMP) AS day
    FROM {EVENT_PROPS} AS t""",
)
def _convert_datetime(spark, sf_dir):
    return convert_type(event_props(spark, sf_dir), "day", "datetime")


@query(
    "convert_category",
    f"""SELECT t.*, CASE WHEN o_orderpriority IS NOT NULL THEN
    dense_rank() OVER (ORDER BY o_orderpriority NULLS LAST) - 1 END AS o_orderpriority_code
    FROM {OPEN_ORDERS} AS t""",
)
def _convert_category(spark, sf_dir):
    return convert_type(open_orders(spark, sf_dir), "o_orderpriority", "category")


@query(
    "encode_labels",
    """SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment,
    dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer""",
)
def _encode_labels(spark, sf_dir):
    return encode_labels(table(spark, sf_dir, "customer"), "c_mktsegment")


@query(
    "rename_column",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice AS amount, o_orderdate,
    o_orderpriority FROM orders""",
)
def _rename_column(spark, sf_dir):
    return rename_column(table(spark, sf_dir, "orders"), "o_totalprice", "amount")


@query("drop_column", "SELECT event_id, ts, user_id, event_type, value FROM events")
def _drop_column(spark, sf_dir):
    return drop_column(table(spark, sf_dir, "events"), "props")


@query("dedupe_column_names", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def _dedupe_column_names(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    doubled = orders.select(
        "o_orderkey",
        "o_totalprice",
        F.lit(-1).alias("o_orderkey"),
        "o_orderstatus",
        F.lit(0.0).alias("o_totalprice"),
    )
    return dedupe_column_names(doubled)


@query(
    "type_distribution",
    f"""SELECT "type", count(*) AS columns, CAST(sum(filled) AS BIGINT) AS filled FROM (
    {each(
        ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate", "o_custkey"],
        '''SELECT '{t}' AS "type", count({c}) AS filled FROM ''' + OPEN_ORDERS + " AS t",
        t=["bigint", "string", "double", "string", "timestamp_ntz", "bigint"],
    )}) AS c GROUP BY "type" """,
)
def _type_distribution(spark, sf_dir):
    return type_distribution(open_orders(spark, sf_dir))


@query(
    "text_looks_numeric",
    each(
        ["event_type", "k", "day"],
        """SELECT '{c}' AS "column", count(*) FILTER (regexp_matches({c}, '^[0-9]+$')) AS numeric_like,
        count(*) FILTER (regexp_matches({c}, '^[0-9]+$')) > count(*) * 0.8 AS looks_numeric
        FROM """ + EVENT_PROPS + " AS t",
    ),
)
def _text_looks_numeric(spark, sf_dir):
    return text_looks_numeric(event_props(spark, sf_dir))


@query(
    "forecastable_columns",
    """SELECT * FROM ("""
    + each(
        ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"],
        """SELECT '{c}' AS "column", '{k}' AS kind, count(DISTINCT {c}) AS "unique" FROM orders""",
        k=["numeric", "numeric", "numeric", "category", "category"],
    )
    + """) AS t WHERE kind = 'numeric' OR "unique" <= 5""",
)
def _forecastable_columns(spark, sf_dir):
    return forecastable_columns(table(spark, sf_dir, "orders"))


MATCHED = ["o_orderdate", "part_name", "order_total", "unit_tax", "ship_mode", "p_size"]
MATCH_WORDS = [["orderdate"], ["part", "name"], ["order", "total"], ["unit", "tax"],
               ["ship", "mode"], ["size"]]


def _match_sql() -> str:
    found = ", ".join(
        "CASE WHEN "
        + " OR ".join(f"contains(lower(\"text\"), '{w}')" for w in words)
        + f" THEN '{name}' END"
        for name, words in zip(MATCHED, MATCH_WORDS)
    )
    return f"""SELECT conv_id, turn, CASE WHEN concat_ws(' ', {found}) = ''
    THEN 'order_total unit_tax' ELSE concat_ws(' ', {found}) END AS columns FROM conversations"""


@query("match_columns", _match_sql())
def _match_columns(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations")
    matched = match_columns(asked, "text", MATCHED, ["order_total", "unit_tax"])
    return matched.select("conv_id", "turn", F.concat_ws(" ", "columns").alias("columns"))


@query(
    "metric_roles",
    each(
        ["vibration", "temperature", "rpm"],
        """SELECT 'MANUFACTURING' AS scenario, '{r}' AS role, '{c}' AS "column",
        count({c}) AS filled, avg({c}) AS mean FROM """ + MACHINES + " AS t",
        r=["critical", "health", "efficiency"],
    )
    + """ UNION ALL SELECT 'MANUFACTURING', 'unit', 'machine_id', count(machine_id), NULL FROM """
    + MACHINES
    + " AS t",
    mean=4,
)
def _metric_roles(spark, sf_dir):
    return metric_roles(machines(spark, sf_dir))
