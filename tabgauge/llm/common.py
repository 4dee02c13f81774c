"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabgauge.functions.expr import col
from tabgauge.session import scratch_path

# White space of the text contracts, as a Java and Python character class.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
LAST_ID = 2**63 - 1
# Frames with at most this many rows may be broadcast, after counting them.
SMALL_ROWS = 100_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(name: str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def id_key(name: str) -> Column:
    """The id, with null sorted and grouped as the largest one."""
    return F.coalesce(col(name).cast("bigint"), F.lit(LAST_ID))


def saved_at(df: DataFrame) -> tuple[DataFrame, str]:
    """The frame written to the shared scratch folder and read back, and where it is.

    Cuts the lineage, and fixes generated ids, in a way that outlives executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def saved(df: DataFrame) -> DataFrame:
    """The frame written to the shared scratch folder and read back."""
    return saved_at(df)[0]


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Mark a frame of ``rows`` counted rows for broadcast if they are few."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def unit_hash(*columns: Column) -> Column:
    """A number from 0 up to 1 that depends on the columns only."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(2**53))
