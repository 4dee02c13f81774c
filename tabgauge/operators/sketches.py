"""Mergeable quantile sketches of many columns from one aggregate.

Spark's KLL sketches name, for a share of the values, a value whose rank is right within a
known error. Here they bracket the ranks that exact operators are after; nothing is decided
by a sketch alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tabgauge.functions.expr import col

# Items kept per sketch level: an error of 0.13 % of the ranks, and about 90 KB a sketch.
SKETCH = 4096
# Tasks add up in this many groups before one task merges the groups.
GROUPS = 64


def error_of(k: int) -> float:
    """The share of all ranks that a sketch may be off by, with room to spare.

    The published error bound of these sketches, half as much again.
    """
    return 1.5 * 2.296 / k**0.9021


def gathered(
    data: DataFrame,
    columns: Sequence[str],
    sums: dict[str, Column] | None = None,
    k: int = SKETCH,
    groups: int = GROUPS,
) -> DataFrame:
    """One row over the whole frame: a sketch of each column (``s:``) and the number of its
    values (``n:``), missing and NaN left out, and sums by name (``n:``)."""
    size, sums = F.lit(k), sums or {}
    first = data.groupBy((F.spark_partition_id() % groups).alias("group")).agg(
        *[c.alias(f"n:{name}") for name, c in sums.items()],
        *[F.kll_sketch_agg_double(col(c), size).alias(f"s:{c}") for c in columns],
    )
    merged = first.agg(
        *[F.sum(col(f"n:{name}")).alias(f"n:{name}") for name in sums],
        *[F.kll_merge_agg_double(col(f"s:{c}"), size).alias(f"s:{c}") for c in columns],
    )
    counts = [F.kll_sketch_get_n_double(col(f"s:{c}")).alias(f"n:{c}") for c in columns]
    return merged.select("*", *counts)


def quantiles_of(
    spark: SparkSession, wanted: Sequence[tuple[bytes, Sequence[float]]]
) -> list[list[float]]:
    """Values at shares of the ranks, per filled sketch; no job is needed for this."""
    if not wanted:
        return []
    # As text, since a literal for each share would take a call each.
    lists = [", ".join(f"{min(max(s, 0.0), 1.0)!r}D" for s in shares) for _, shares in wanted]
    found = [
        F.kll_sketch_get_quantile_double(F.lit(bytes(sketch)), F.expr(f"array({shares})")).alias(str(i))
        for i, ((sketch, _), shares) in enumerate(zip(wanted, lists))
    ]
    row: Row = spark.sql("SELECT 1").select(*found).first()
    return [list(values) for values in row]
