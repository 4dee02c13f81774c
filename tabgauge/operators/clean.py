"""Cleaning: duplicates, gaps, outliers, types, names and keyed edits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgauge.functions.expr import col, value_counts_by_column
from tabgauge.operators.ordering import with_row_number
from tabgauge.operators.quantiles import (
    above,
    find_fences,
    missing,
    number,
    outside,
    within_fences,
)
from tabgauge.operators.roles import numeric_columns, parsed_time, text_columns
from tabgauge.operators.survival import sequential_fences


def remove_duplicates(df: DataFrame) -> DataFrame:
    """One copy of each row; missing equals missing."""
    return df.dropDuplicates()


def drop_missing_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def find_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent text of each column, the smallest on ties; all-null absent."""
    if not columns:
        return {}
    best = (
        value_counts_by_column(df, columns)
        .groupBy("position")
        .agg(F.min(F.struct((-F.col("n")).alias("n"), "value"))["value"].alias("value"))
    )
    return {columns[r["position"]]: r["value"] for r in best.collect()}


def _fill(df: DataFrame, fills: dict[str, object]) -> DataFrame:
    """Whole-number columns filled with a mean become double."""
    texts = text_columns(df)

    def filled(name: str) -> Column:
        value = fills.get(name)
        if value is None:
            return col(name)
        known = col(name).cast("string") if name in texts else number(df, name)
        return F.coalesce(known, F.lit(value)).alias(name)

    return df.select(*[filled(c) for c in df.columns])


def fill_missing(df: DataFrame) -> DataFrame:
    """Numbers take the column mean, text the mode; other types stay as they are.

    Only columns with gaps are looked at: means in one aggregate, modes from
    counts merged before the shuffle.
    """
    numbers, texts = numeric_columns(df), text_columns(df)
    if not numbers and not texts:
        return df
    facts = df.agg(
        *[F.count_if(missing(df, c)).alias(f"n_{c}") for c in numbers + texts],
        *[F.avg(number(df, c)).alias(f"m_{c}") for c in numbers],
    ).first()
    fills: dict[str, object] = {c: facts[f"m_{c}"] for c in numbers if facts[f"n_{c}"]}
    fills.update(find_modes(df, [c for c in texts if facts[f"n_{c}"]]))
    return _fill(df, fills)


def filled_cells(df: DataFrame) -> DataFrame:
    """How many cells ``fill_missing`` fills."""
    total = F.lit(0).cast("bigint")
    for name in numeric_columns(df) + text_columns(df):
        gap = missing(df, name)
        total = total + F.when(F.count_if(~gap) > 0, F.count_if(gap)).otherwise(0)
    return df.agg(total.alias("filled"))


def fill_mean(df: DataFrame, name: str) -> DataFrame:
    mean = df.agg(F.avg(number(df, name)).alias("mean")).first()["mean"]
    filled = number(df, name)
    if mean is not None:
        filled = F.coalesce(filled, F.lit(mean))
    return df.withColumn(name, filled)


def fill_mode(df: DataFrame, name: str) -> DataFrame:
    counted = df.where(~missing(df, name)).groupBy(col(name).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    best = counted.agg(F.min(F.struct((-F.col("n")).alias("n"), "value"))["value"].alias("value"))
    kind = df.schema[name].dataType
    fill = F.lit(best.first()["value"]).cast(kind)
    return df.withColumn(name, F.when(missing(df, name), fill).otherwise(col(name)))


def remove_outliers(df: DataFrame, name: str, **options) -> DataFrame:
    """Rows inside the fences of one column; rows missing the value stay."""
    return within_fences(df, list(find_fences(df, [name], **options).items()))


def remove_all_outliers(df: DataFrame, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """Column after column, fences taken from the rows still there.

    All fences are found together, in scans that do not grow with the columns. They are
    literals, so what is left is one filter on the source scan.
    """
    return within_fences(df, sequential_fences(df, columns or numeric_columns(df), **options))


def rows_outlier(df: DataFrame, name: str) -> DataFrame:
    return df.where(outside(df, name, find_fences(df, [name])[name]))


def rows_above_threshold(df: DataFrame, name: str) -> DataFrame:
    return df.where(above(df, name, find_fences(df, [name])[name]))


def rows_missing(df: DataFrame, name: str) -> DataFrame:
    return df.where(missing(df, name))


def rows_duplicated(df: DataFrame, chunk: int = 1_000_000) -> DataFrame:
    """Every copy of every row that occurs more than once.

    Copies are counted, merged before the shuffle, and written out again from
    the counts. A row with very many copies is written by many tasks, each
    taking a chunk of them, so no group has to fit in one place.
    """
    copies = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__copies"))
    repeated = copies.where(F.col("__copies") > 1)
    chunks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__copies") - 1) / chunk))
    split = repeated.withColumn("__chunk", F.explode(chunks))
    # A fixed number of tasks: the chunks are few bytes now but many rows later,
    # so they must not be packed together by their present size.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = split.repartition(tasks, "__chunk", *[col(c) for c in df.columns])
    size = F.least(F.lit(chunk).cast("bigint"), F.col("__copies") - F.col("__chunk") * chunk)
    return spread.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), size))).select(
        *[col(c) for c in df.columns]
    )


def filter_category(df: DataFrame, name: str, value: object) -> DataFrame:
    """Rows of one category; of those missing it for None."""
    return df.where(col(name).eqNullSafe(F.lit(value)))


def require_rows(df: DataFrame, least: int = 10) -> DataFrame:
    """The table; an error when it has fewer rows."""
    rows = df.limit(least).count()
    if rows < least:
        raise ValueError(f"only {rows} rows; at least {least} are needed")
    return df


def filter_values(df: DataFrame, name: str) -> DataFrame:
    return (
        df.where(~missing(df, name)).select(col(name).alias("value")).distinct().orderBy("value")
    )


def label_codes(df: DataFrame, name: str) -> DataFrame:
    """(value, code): distinct values in order, numbered from 0."""
    values = df.where(~missing(df, name)).select(col(name).alias("value")).distinct()
    return with_row_number(values, ["value"], "code")


def encode_labels(df: DataFrame, name: str, code: str = "code") -> DataFrame:
    """The table with the code of each value; missing values get none."""
    codes = label_codes(df, name)
    named = codes.select(F.col("value").alias("__value"), F.col("code").cast("bigint").alias(code))
    return df.join(named, col(name) == F.col("__value"), "left").drop("__value")


def convert_type(df: DataFrame, name: str, to: str) -> DataFrame:
    """numeric, string, datetime or category; values that do not fit become null."""
    if to == "numeric":
        text = F.trim(col(name).cast("string"))
        return df.withColumn(name, text.try_cast("double"))
    if to == "string":
        return df.withColumn(name, col(name).cast("string"))
    if to == "datetime":
        return df.withColumn(name, parsed_time(df, name))
    if to == "category":
        return encode_labels(df, name, f"{name}_code")
    raise ValueError(f"cannot convert to {to!r}")


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    if not new or new in df.columns:
        raise ValueError(f"column {new!r} exists already" if new else "no new name given")
    return df.withColumnRenamed(old, new)


def drop_column(df: DataFrame, name: str) -> DataFrame:
    return df.drop(col(name))


def dedupe_column_names(df: DataFrame) -> DataFrame:
    """Keep the first of same-named columns."""
    places = {}
    for i, name in enumerate(df.columns):
        places.setdefault(name, i)
    numbered = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return numbered.select(*[F.col(f"_{i}").alias(name) for name, i in places.items()])


def apply_edits(
    df: DataFrame, edits: DataFrame, key: Sequence[str], order: str | None = None
) -> DataFrame:
    """Keyed cell updates, added rows and deleted rows, by one full outer join.

    ``edits`` holds the key, new values (null leaves a cell alone) and may hold
    ``deleted`` (boolean) and ``cleared`` (array of columns to set to null). Keys not in
    the table are added, unless deleted. A null key is a key like any other. Of several
    edits of one key the one with the largest ``order`` counts as a whole; without an
    order column they are an error.
    """
    edited = [c for c in edits.columns if c in df.columns and c not in key]
    none = F.array().cast("array<string>")
    deleted = F.coalesce(col("deleted"), F.lit(False)) if "deleted" in edits.columns else F.lit(False)
    cleared = F.coalesce(col("cleared"), none) if "cleared" in edits.columns else none
    change = F.struct(
        deleted.alias("deleted"), cleared.alias("cleared"),
        *[col(c).alias(f"new_{i}") for i, c in enumerate(edited)],
    )
    keys = [f"__key_{i}" for i in range(len(key))]
    grouped = edits.groupBy(*[col(k).alias(name) for k, name in zip(key, keys)])
    if order is not None:
        changes = grouped.agg(F.max_by(change, col(order)).alias("__edit"))
    else:
        twice = F.raise_error(F.lit("a key is edited more than once; name an order column"))
        one = F.when(F.count(F.lit(1)) > 1, twice.cast(edits.select(change).schema[0].dataType))
        changes = grouped.agg(one.otherwise(F.first(change)).alias("__edit"))
    same = F.lit(True)
    for k, name in zip(key, keys):
        same = same & col(k).eqNullSafe(F.col(name))
    joined = df.withColumn("__here", F.lit(True)).join(changes, same, "full")
    edit = F.col("__edit")
    kept = joined.where(edit.isNull() | ~edit["deleted"])
    here = F.col("__here").isNotNull()

    def cell(name: str) -> Column:
        kind = df.schema[name].dataType
        if name in key:
            return F.when(here, col(name)).otherwise(F.col(keys[list(key).index(name)]).cast(kind))
        if name not in edited:
            return col(name)
        new = edit[f"new_{edited.index(name)}"].cast(kind)
        changed = F.coalesce(new, col(name))
        wiped = F.coalesce(F.array_contains(edit["cleared"], F.lit(name)), F.lit(False))
        return F.when(~wiped | ~here, changed)

    return kept.select(*[cell(c).alias(c) for c in df.columns])
