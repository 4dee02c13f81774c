"""Small column and frame helpers used across operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.FloatType,
    T.DoubleType,
    T.DecimalType,
)
DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def col(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col(sql_name(name))


def sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_double(value: float) -> str:
    return f"double('{value!r}')"


def percent(part: Column, whole: Column) -> Column:
    """Null, not an error, when the whole is zero."""
    return F.try_divide(part * F.lit(100.0), whole)


def grade(value: Column, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first limit the value is below."""
    result = F.lit(None).cast("string")
    chain = None
    for limit, label in steps:
        test = value < F.lit(limit)
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    assert chain is not None
    return F.when(value.isNull(), result).otherwise(chain.otherwise(otherwise))


def grade_above(value: Column, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first limit the value is above."""
    chain = None
    for limit, label in steps:
        test = value > F.lit(limit)
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    assert chain is not None
    return F.when(value.isNull(), F.lit(None).cast("string")).otherwise(
        chain.otherwise(otherwise)
    )


def merge_rows(*frames: DataFrame) -> DataFrame:
    """Put one-row frames with different columns side by side, without a join."""
    if len(frames) == 1:
        return frames[0]
    stacked = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), frames
    )
    return stacked.agg(*[F.max(col(c)).alias(c) for c in stacked.columns])


def one_row_per_column(
    df: DataFrame,
    columns: Sequence[str],
    measures: dict[str, Callable[[str], Column]],
    labels: dict[str, Callable[[str], Column]] | None = None,
) -> DataFrame:
    """One wide aggregate over the table, then one row per profiled column.

    All measures of all columns share a single scan and a single partial/final
    aggregation; only one row leaves it, and that row is unfolded.
    """
    wide = df.agg(
        *[
            make(name).alias(f"{position}_{measure}")
            for position, name in enumerate(columns)
            for measure, make in measures.items()
        ]
    )
    rows = [
        F.struct(
            F.lit(position).alias("position"),
            F.lit(name).alias("column"),
            *[make(name).alias(label) for label, make in (labels or {}).items()],
            *[F.col(f"{position}_{measure}").alias(measure) for measure in measures],
        )
        for position, name in enumerate(columns)
    ]
    return wide.select(F.inline(F.array(*rows)))


def unfold(df: DataFrame, cells: Sequence[Column], position: str = "position") -> DataFrame:
    """(position, value) for every row and cell; one narrow row each."""
    names = [str(i) for i in range(len(cells))]
    wide = df.select(*[cell.alias(name) for cell, name in zip(cells, names)])
    if len(names) == 1:
        return wide.select(F.lit(0).alias(position), F.col("0").alias("value"))
    long = wide.unpivot([], names, position, "value")
    return long.withColumn(position, F.col(position).cast("int"))


def value_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every filled cell as (position, value text), ready to be counted."""
    return unfold(df, [as_text(df, c) for c in columns]).where(F.col("value").isNotNull())


def as_text(df: DataFrame, name: str) -> Column:
    """Cell as text; complex values as JSON so that equal cells give equal text."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(col(name))
    if isinstance(kind, T.BinaryType):
        return F.hex(col(name))
    return col(name).cast("string")


def value_counts_by_column(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(position, value, n) for every distinct cell of every column."""
    return (
        value_rows(df, columns)
        .groupBy("position", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def compact(df: DataFrame, name: str, keep: int = 64) -> Column:
    """A stand-in for a cell when only equality matters: long text by its digest.

    The stand-in is longer than any text kept as it is, so the two never mix.
    """
    if not isinstance(df.schema[name].dataType, T.StringType):
        return col(name)
    digest = F.concat(F.lit("#"), F.sha2(col(name), 256))
    return F.when(F.length(col(name)) <= keep, col(name)).otherwise(digest)


def stand_in(df: DataFrame, name: str) -> Column:
    """What tells cells apart and can be ordered: the cell, or a digest of it."""
    if isinstance(df.schema[name].dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.sha2(as_text(df, name), 256)
    return compact(df, name)
