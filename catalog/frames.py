"""The given tables, and a few frames derived from them, in Spark and in SQL.

The given tables have no missing values, so some frames make them from the data
itself: prices of pending orders, unspecified priorities, documents without a
label. Every frame keeps all rows of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a unit of its own per user and event type."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.concat_ws("-", "user_id", "event_type").alias("unit"),
        "event_type",
        "value",
    )


UNITS = """(SELECT event_id, ts, concat(user_id, '-', event_type) AS unit, event_type, value
    FROM events)"""


def machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events under the names of machine readings."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.concat_ws("-", "user_id", "event_type").alias("machine_id"),
        F.col("ts").alias("timestamp"),
        (F.col("value") * 0.5 + F.hour("ts")).alias("temperature"),
        (F.col("user_id") * 10 + F.hour("ts")).alias("rpm"),
        F.col("value").alias("vibration"),
    )


MACHINES = """(SELECT concat(user_id, '-', event_type) AS machine_id, ts AS "timestamp",
    value * 0.5 + hour(ts) AS temperature, user_id * 10 + hour(ts) AS rpm,
    value AS vibration FROM events)"""


def open_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with gaps: no price while pending, no unspecified priority, no date if low."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey",
        "o_orderstatus",
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("o_totalprice"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias(
            "o_orderpriority"
        ),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate")).alias("o_orderdate"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_custkey")).alias("o_custkey"),
    )


OPEN_ORDERS = """(SELECT o_orderkey, o_orderstatus,
    CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice,
    CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS o_orderpriority,
    CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END AS o_orderdate,
    CASE WHEN o_orderstatus <> 'F' THEN o_custkey END AS o_custkey
    FROM orders)"""


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the net price, which goes closely with the gross price."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        "l_orderkey",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        "l_returnflag",
        "l_shipdate",
    )


SALES = """(SELECT l_orderkey, l_quantity, l_extendedprice, l_discount, l_tax,
    l_extendedprice * (1 - l_discount) AS net, l_returnflag, l_shipdate FROM lineitem)"""
SALES_NUMBERS = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "net"]


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels; most documents have none."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return documents.join(table(spark, sf_dir, "labels"), "doc_id", "left")


LABELLED = """(SELECT d.doc_id, lang, source, n_chars, quality, toxic
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
LABELLED_COLUMNS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]
LABELLED_TYPES = ["bigint", "string", "string", "bigint", "int", "int"]


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_name", "p_brand", "p_type")


PART_NAMES = "(SELECT p_name, p_brand, p_type FROM part)"


def quiet_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without the value of errors: outliers and gaps in one column."""
    value = F.when(F.col("event_type") != "error", F.col("value"))
    return table(spark, sf_dir, "events").withColumn("value", value)


QUIET_EVENTS = """(SELECT event_id, ts, user_id, event_type,
    CASE WHEN event_type <> 'error' THEN value END AS value, props FROM events)"""


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the number held as text in their JSON, and the day as text."""
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id",
        "event_type",
        F.get_json_object("props", "$.k").alias("k"),
        F.to_date("ts").cast("string").alias("day"),
    )


EVENT_PROPS = """(SELECT event_id, event_type, json_extract_string(props, '$.k') AS k,
    CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events)"""


def fences(source: str, name: str) -> str:
    """SQL giving q1, q3, low and high of a column as one row."""
    return f"""(SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM (
        SELECT quantile_cont(CAST({name} AS DOUBLE), 0.25) AS q1,
               quantile_cont(CAST({name} AS DOUBLE), 0.75) AS q3 FROM {source} AS s) AS q)"""


def each(columns: list[str], template: str, **lists: list[str]) -> str:
    """One SELECT per column, put together with UNION ALL."""
    parts = []
    for i, name in enumerate(columns):
        more = {key: values[i] for key, values in lists.items()}
        parts.append(template.format(i=i, c=name, **more))
    return " UNION ALL ".join(parts)


def missing_sum(columns: list[str]) -> str:
    return "(" + " + ".join(f"count(*) - count({c})" for c in columns) + ")"
