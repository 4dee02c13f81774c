"""Deterministic samples and first rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgauge.functions.expr import col
from tabgauge.operators.quantiles import missing


def sample_n(df: DataFrame, key: Sequence[str], n: int = 5000, seed: int = 42) -> DataFrame:
    """Exactly n rows (all, if there are no more), the same ones on every run.

    Rows are ordered by a hash of key and seed; each task keeps its n smallest.
    """
    hashed = F.md5(F.concat_ws("|", *[col(k).cast("string") for k in key], F.lit(str(seed))))
    return (
        df.withColumn("__hash", hashed)
        .orderBy("__hash", *[col(k) for k in key])
        .limit(n)
        .drop("__hash")
    )


def preview(df: DataFrame, key: Sequence[str], n: int = 15) -> DataFrame:
    return df.orderBy(*[col(k) for k in key]).limit(n)


def missing_matrix(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key..., column, missing) of every cell, 1 where it is missing."""
    flags = F.array(
        *[
            F.struct(F.lit(c).alias("column"), missing(df, c).cast("int").alias("missing"))
            for c in df.columns
        ]
    )
    return df.select(*[col(k) for k in key], F.inline(flags))
