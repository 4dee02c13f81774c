"""The message log: (user_email, role, message, timestamp), kept in folders of users.

Rows of one append share a time, so each also has the append's number and its place in it,
and a log always reads back in the order it was written. Users are dealt over ``BUCKETS``
folders by a hash; loading or clearing one user touches the files of one folder.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabgauge.functions.expr import col
from tabgauge.operators.ordering import with_row_number
from tabgauge.session import remove_path, scratch_path

MESSAGE = "user_email string, role string, message string, timestamp timestamp"
SCHEMA = f"{MESSAGE}, batch bigint, place bigint, bucket int"
BUCKETS = 64


def bucket_of(user: Column) -> Column:
    return F.pmod(F.xxhash64(user.cast("string")), F.lit(BUCKETS)).cast("int")


def append_messages(path: str, rows: DataFrame) -> None:
    """Append (user_email, role, message) rows in their order, stamped with the current time."""
    stamped = rows.select(
        "user_email",
        "role",
        "message",
        F.current_timestamp().alias("timestamp"),
        F.lit(time.time_ns()).alias("batch"),
        F.monotonically_increasing_id().alias("place"),
        bucket_of(F.col("user_email")).alias("bucket"),
    )
    stamped.write.mode("append").partitionBy("bucket").parquet(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def load_messages(
    log: DataFrame,
    user: object,
    user_column: str = "user_email",
    message: str = "message",
    time: str = "timestamp",
    place: str | None = None,
) -> DataFrame:
    """One user's messages in the order they were written, as (role, content).

    ``place`` names a column to number them in, from 1. Of a log read with
    ``read_messages`` only the user's folder is read.
    """
    rows = log.where(col(user_column) == F.lit(user))
    if "bucket" in log.columns:
        rows = rows.where(F.col("bucket") == bucket_of(F.lit(user)))
    order = [time, *[c for c in ("batch", "place") if c in log.columns]]
    if place is None:
        return rows.orderBy(*[col(c) for c in order]).select("role", col(message).alias("content"))
    numbered = with_row_number(
        rows.select(*[col(c).alias(f"__{i}") for i, c in enumerate(order)], "role", col(message).alias("content")),
        [f"__{i}" for i in range(len(order))],
        "__place",
    )
    return numbered.select("role", "content", (F.col("__place") + 1).alias(place))


def clear_messages(log: DataFrame, user: object, user_column: str = "user_email") -> DataFrame:
    """The log without one user's rows, as a frame."""
    return log.where(~col(user_column).eqNullSafe(F.lit(user)))


def clear_log(spark: SparkSession, path: str, user: str | None) -> None:
    """Remove one user's rows from a stored log, in place; other folders are not touched."""
    bucket = spark.range(1).select(bucket_of(F.lit(user)).alias("b")).first()["b"]
    rest = clear_messages(read_messages(spark, path).where(F.col("bucket") == bucket), user)
    aside = scratch_path(spark)
    rest.write.parquet(aside)
    kept = spark.read.schema(SCHEMA).parquet(aside)
    if kept.limit(1).count():
        writer = kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("bucket").parquet(path)
    else:
        remove_path(spark, f"{path}/bucket={bucket}")
    remove_path(spark, aside)


def message_count(log: DataFrame) -> DataFrame:
    return log.agg(F.count(F.lit(1)).alias("messages"))


def chat_export(log: DataFrame, message: str = "message") -> DataFrame:
    """Messages with a role label and markup-safe text; other columns unchanged."""
    text = col(message)
    for old, new in (("<", "&lt;"), (">", "&gt;"), ("\n", "<br>")):
        text = F.replace(text, F.lit(old), F.lit(new))
    label = F.when(col("role") == "user", "asked").otherwise("answered")
    kept = [col(c) for c in log.columns if c not in ("role", message)]
    return log.select(*kept, label.alias("role"), text.alias("content"))
