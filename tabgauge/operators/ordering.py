"""Global row numbers and running windows without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabgauge.functions.expr import col
from tabgauge.session import ensure_checkpoint_dir

# Rows per task of a running window over row numbers.
RUN_LENGTH = 1_000_000


def with_row_number(df: DataFrame, order: Sequence[str], name: str = "row_number") -> DataFrame:
    """Number the rows 0, 1, ... in the given order.

    Rows are range-partitioned and written once to the checkpoint folder, which fixes
    which row sits in which range; each range is numbered alone and shifted by the rows
    before it.
    """
    keys = [col(c) for c in order]
    ensure_checkpoint_dir(df.sparkSession)
    placed = (
        df.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()).checkpoint()
    )
    # One row per range.
    before = (
        placed.groupBy("__range")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn(
            "__before",
            F.sum("__n").over(Window.orderBy("__range")) - F.col("__n"),
        )
        .drop("__n")
    )
    local = F.row_number().over(Window.partitionBy("__range").orderBy(*keys)) - 1
    return (
        placed.withColumn("__local", local)
        .join(F.broadcast(before), "__range")
        .withColumn(name, F.col("__before") + F.col("__local"))
        .drop("__range", "__local", "__before")
    )


def over_previous(
    numbered: DataFrame,
    rows: int,
    make: dict[str, Column],
    number: str = "row_number",
    run_length: int = RUN_LENGTH,
) -> DataFrame:
    """Aggregates over each row and the ``rows - 1`` before it, by row number.

    Rows are cut into runs; a row is also handed to every later run that has a window
    reaching back to it, so that each window is complete inside its run.
    """
    run = F.floor(F.col(number) / run_length)
    last = F.floor((F.col(number) + (rows - 1)) / run_length)
    window = (
        Window.partitionBy("__run").orderBy(number).rowsBetween(-(rows - 1), 0)
    )
    spread = numbered.withColumn("__run", F.explode(F.sequence(run, last)))
    return (
        spread.withColumns({name: agg.over(window) for name, agg in make.items()})
        .where(F.col("__run") == run)
        .drop("__run")
    )
