"""Reading, narrowing, sampling, first rows and the message log."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.frames import (
    LABELLED,
    LABELLED_COLUMNS,
    OPEN_ORDERS,
    labelled,
    open_orders,
    table,
)
from catalog.registry import query
from tabgauge.session import scratch_path
from tabgauge.sources.messages import (
    append_messages,
    chat_export,
    clear_log,
    clear_messages,
    load_messages,
    message_count,
    read_messages,
)
from tabgauge.sources.sampling import missing_matrix, preview, sample_n
from tabgauge.sources.tables import narrow_types, read_csv, to_csv


@query(
    "narrow_types",
    """SELECT CAST(l_linenumber AS TINYINT) AS l_linenumber, CAST(l_quantity AS TINYINT) AS quantity,
    CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS SMALLINT) AS day,
    CAST(floor(l_extendedprice) AS INTEGER) AS price, l_tax, l_returnflag FROM lineitem""",
)
def _narrow_types(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return narrow_types(
        lines.select(
            "l_linenumber",
            F.col("l_quantity").cast("bigint").alias("quantity"),
            F.unix_date(F.to_date("l_shipdate")).alias("day"),
            F.floor("l_extendedprice").alias("price"),
            "l_tax",
            "l_returnflag",
        )
    )


@query(
    "sample_n",
    """SELECT * FROM orders
    ORDER BY md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '42')), o_orderkey LIMIT 5000""",
)
def _sample_n(spark, sf_dir):
    return sample_n(table(spark, sf_dir, "orders"), ["o_orderkey"])


@query(
    "narrow_floats",
    """SELECT doc_id, CAST(quality AS FLOAT) AS quality, CAST(toxic AS TINYINT) AS toxic
    FROM labels""",
)
def _narrow_floats(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.col("quality").cast("double").alias("quality"),
        "toxic",
    )
    return narrow_types(labels, floats=True).withColumn("doc_id", F.col("doc_id").cast("bigint"))


@query("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 15")
def _preview(spark, sf_dir):
    return preview(table(spark, sf_dir, "orders"), ["o_orderkey"])


@query(
    "missing_matrix",
    " UNION ALL ".join(
        f"""SELECT doc_id, '{c}' AS "column", CAST({c} IS NULL AS INTEGER) AS missing
        FROM {LABELLED} AS t"""
        for c in LABELLED_COLUMNS
    ),
)
def _missing_matrix(spark, sf_dir):
    return missing_matrix(labelled(spark, sf_dir), ["doc_id"])


def _busiest(log):
    """The conversation with the most messages, the smallest id on ties."""
    counted = log.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "conv_id").first()["conv_id"]


BUSIEST = """(SELECT conv_id FROM conversations GROUP BY conv_id
    ORDER BY count(*) DESC, conv_id LIMIT 1)"""


@query(
    "load_messages",
    f"""SELECT role, "text" AS content FROM conversations
    WHERE conv_id = {BUSIEST} ORDER BY turn""",
)
def _load_messages(spark, sf_dir):
    log = table(spark, sf_dir, "conversations")
    return load_messages(log, _busiest(log), "conv_id", "text", "turn")


@query(
    "load_messages_tied",
    f"""SELECT row_number() OVER (ORDER BY turn) AS place, role, "text" AS content
    FROM conversations WHERE conv_id = {BUSIEST}""",
)
def _load_messages_tied(spark, sf_dir):
    """All turns in one append, with one time; a user's messages keep their order."""
    path = scratch_path(spark)
    log = table(spark, sf_dir, "conversations")
    user = F.col("conv_id").cast("string").alias("user_email")
    rows = log.orderBy("conv_id", "turn").select(user, "role", F.col("text").alias("message"))
    append_messages(path, rows)
    return load_messages(read_messages(spark, path), str(_busiest(log)), place="place")


@query(
    "clear_log",
    f"""SELECT CAST(conv_id AS VARCHAR) AS user_email, role, "text" AS message
    FROM conversations WHERE conv_id <> {BUSIEST}""",
)
def _clear_log(spark, sf_dir):
    """The turns as a stored log, and one user's rows removed from it."""
    path = scratch_path(spark)
    log = table(spark, sf_dir, "conversations")
    user = F.col("conv_id").cast("string").alias("user_email")
    append_messages(path, log.select(user, "role", F.col("text").alias("message")))
    clear_log(spark, path, str(_busiest(log)))
    return read_messages(spark, path).select("user_email", "role", "message")


@query("clear_messages", f"SELECT * FROM conversations WHERE conv_id <> {BUSIEST}")
def _clear_messages(spark, sf_dir):
    log = table(spark, sf_dir, "conversations")
    return clear_messages(log, _busiest(log), "conv_id")


@query(
    "chat_export",
    """SELECT conv_id, turn,
    CASE WHEN role = 'user' THEN 'asked' ELSE 'answered' END AS role,
    replace(replace(replace("text", '<', '&lt;'), '>', '&gt;'), chr(10), '<br>') AS content
    FROM conversations""",
)
def _chat_export(spark, sf_dir):
    return chat_export(table(spark, sf_dir, "conversations"), "text")


@query("message_count", "SELECT count(*) AS messages FROM conversations")
def _message_count(spark, sf_dir):
    return message_count(table(spark, sf_dir, "conversations"))


@query(
    "csv_round_trip",
    """SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey,
    o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders""",
)
def _csv_round_trip(spark, sf_dir):
    """Orders written as CSV and read back with inferred types."""
    path = scratch_path(spark)
    to_csv(table(spark, sf_dir, "orders"), path)
    read = read_csv(spark, path)
    return read.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@query(
    "csv_missing_texts",
    f"""SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, o_totalprice, o_orderpriority,
    CAST(o_custkey AS INTEGER) AS o_custkey FROM {OPEN_ORDERS} AS t""",
)
def _csv_missing_texts(spark, sf_dir):
    """Orders with gaps, written with the texts NA, NaN and null for them, read back."""
    path = scratch_path(spark)
    orders = open_orders(spark, sf_dir)
    gaps = {"o_totalprice": "NA", "o_orderpriority": "null", "o_custkey": "NaN"}
    texts = [F.coalesce(F.col(c).cast("string"), F.lit(t)).alias(c) for c, t in gaps.items()]
    to_csv(orders.select("o_orderkey", *texts), path)
    return read_csv(spark, path)


QUOTED_TEXTS = """'He said "' || "text" || '", then:' || chr(10) || '"yes", "no"'"""


@query(
    "csv_quoted_texts",
    f"""SELECT CAST(doc_id AS INTEGER) AS doc_id, sha256({QUOTED_TEXTS}) AS note_sha256,
    length({QUOTED_TEXTS}) AS note_chars, lang FROM documents""",
)
def _csv_quoted_texts(spark, sf_dir):
    """Documents with quotes, commas and line breaks, written as CSV and read back."""
    path = scratch_path(spark)
    docs = table(spark, sf_dir, "documents")
    note = F.concat(F.lit('He said "'), "text", F.lit('", then:\n"yes", "no"'))
    to_csv(docs.select("doc_id", note.alias("note"), "lang"), path)
    read = read_csv(spark, path)
    length = F.length("note").cast("bigint").alias("note_chars")
    return read.select("doc_id", F.sha2("note", 256).alias("note_sha256"), length, "lang")


@query(
    "append_messages",
    """SELECT CAST(conv_id AS VARCHAR) AS user_email, role, "text" AS message, true AS stamped
    FROM conversations""",
)
def _append_messages(spark, sf_dir):
    """User turns appended first, all others after them, then the whole log read."""
    path = scratch_path(spark)
    log = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("user_email"), "role", F.col("text").alias("message")
    )
    append_messages(path, log.where(F.col("role") == "user"))
    append_messages(path, log.where(F.col("role") != "user"))
    stamped = F.col("timestamp").isNotNull().alias("stamped")
    return read_messages(spark, path).select("user_email", "role", "message", stamped)
