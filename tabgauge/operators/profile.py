"""Column and table profiles: aggregates over whole columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabgauge.functions.expr import (
    as_text,
    col,
    compact,
    grade,
    one_row_per_column,
    percent,
    stand_in,
    unfold,
    value_counts_by_column,
)
from tabgauge.functions.rules import Z_LIMIT
from tabgauge.operators.quantiles import (
    FLOATING,
    WHOLE_TYPES,
    Fences,
    exact_quantiles,
    find_fences,
    inside,
    missing,
    number,
    outside,
)
from tabgauge.operators.roles import numeric_columns, text_columns, type_name

QUALITY_STEPS = [(5.0, "Good")]


# Values that one bitmap of ``bitmap_construct_agg`` tells apart.
BITMAP = 32768


def _as_whole(df: DataFrame, name: str) -> Column | None:
    """A whole number that stands for the cell; null for cells that are not whole."""
    kind = df.schema[name].dataType
    if isinstance(kind, WHOLE_TYPES):
        return col(name).cast("bigint")
    if isinstance(kind, T.DateType):
        return F.unix_date(col(name)).cast("bigint")
    if isinstance(kind, FLOATING):
        value = number(df, name)
        return F.when(value == F.floor(value), F.floor(value))
    return None


def _narrow_columns(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """The smallest value of each column of whole values that span less than a bitmap."""
    whole = {c: v for c in columns if (v := _as_whole(df, c)) is not None}
    if not whole:
        return {}
    facts = df.agg(
        *[
            f.alias(f"{t}{i}")
            for i, (c, v) in enumerate(whole.items())
            for t, f in (
                ("a", F.min(v)),
                ("b", F.max(v)),
                ("n", F.count_if(~missing(df, c) & v.isNull())),
            )
        ]
    ).first()
    found = {}
    for i, name in enumerate(whole):
        low, high = facts[f"a{i}"], facts[f"b{i}"]
        if low is not None and not facts[f"n{i}"] and high - low < BITMAP:
            found[name] = low
    return found


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(position, unique), missing cells not counted.

    One aggregate over the columns of numbers finds those whose values are whole and close
    together; a bitmap each counts them, all in one more aggregate. Each of the others is
    counted from its own column alone, its equal cells merging before the shuffle, so no
    cells are unfolded into rows and no distinct value set sits in one buffer. Long text
    travels as a digest.
    """
    columns = list(columns)
    narrow = _narrow_columns(df, columns)
    counted = []
    if narrow:
        bits = [
            F.bitmap_count(
                F.bitmap_construct_agg(F.bitmap_bit_position(_as_whole(df, c) - F.lit(low) + 1))
            ).alias(c)
            for c, low in narrow.items()
        ]
        places = [F.struct(F.lit(columns.index(c)).alias("position"), col(c).alias("unique")) for c in narrow]
        counted.append(df.agg(*bits).select(F.inline(F.array(*places))))
    for position, name in enumerate(columns):
        if name in narrow:
            continue
        cell = F.when(~missing(df, name), stand_in(df, name)).alias("value")
        place = F.lit(position).alias("position")
        counted.append(df.select(cell).distinct().agg(place, F.count("value").alias("unique")))
    return reduce(DataFrame.union, counted)


def column_facts(
    df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True
) -> DataFrame:
    """position, column, type, rows, missing, mean, unique for each column."""
    columns = list(columns or df.columns)
    numbers = set(numeric_columns(df))

    def mean(name: str) -> Column:
        return F.avg(number(df, name) if name in numbers else F.lit(None).cast("double"))

    measures = {
        "rows": lambda c: F.count(F.lit(1)),
        "missing": lambda c: F.count_if(missing(df, c)),
        "mean": mean,
    }
    if not exact:
        measures["unique"] = lambda c: F.approx_count_distinct(F.when(~missing(df, c), col(c)))
    facts = one_row_per_column(
        df, columns, measures, {"type": lambda c: F.lit(type_name(df, c))}
    )
    if not exact:
        return facts
    return facts.join(distinct_counts(df, columns), "position", "left").withColumn(
        "unique", F.coalesce(F.col("unique"), F.lit(0).cast("bigint"))
    )


def column_summary(df: DataFrame, exact: bool = True) -> DataFrame:
    return column_facts(df, exact=exact).select("column", "type", "missing", "unique", "mean")


def _counted(df: DataFrame, name: str) -> DataFrame:
    value = F.when(~missing(df, name), col(name))
    return df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def _most_frequent() -> Column:
    """The most frequent value, the smallest one on ties: (minus count, value)."""
    filled = F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("n"), "value"))
    return F.min(filled)


def column_metrics(df: DataFrame, name: str) -> DataFrame:
    """Type, missing, unique, and the mean (numeric) or the mode (others)."""
    is_number = name in numeric_columns(df)
    value = F.col("value").cast("double")
    mean = F.try_divide(F.sum(value * F.col("n")), F.sum(F.when(F.col("value").isNotNull(), F.col("n"))))
    summed = _counted(df, name).agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0).cast("bigint")).alias("missing"),
        F.count("value").alias("unique"),
        (mean if is_number else F.max(F.lit(None).cast("double"))).alias("mean"),
        _most_frequent()["value"].cast("string").alias("mode"),
    )
    return summed.select(
        F.lit(name).alias("column"),
        F.lit(type_name(df, name)).alias("type"),
        "missing",
        percent(F.col("missing"), F.col("rows")).alias("missing_pct"),
        "unique",
        "mean",
        (F.lit(None).cast("string") if is_number else F.col("mode")).alias("mode"),
    )


def describe(df: DataFrame, name: str, accuracy: int | None = None) -> DataFrame:
    """count, mean, sample std, min, quartiles and max, as one row."""
    quartiles = exact_quantiles(df, [name], (0.25, 0.5, 0.75), accuracy=accuracy)[name]
    value = number(df, name)
    return df.agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ).select(
        "count",
        "mean",
        "std",
        "min",
        *[
            F.lit(q).cast("double").alias(label)
            for q, label in zip(quartiles, ("q25", "q50", "q75"))
        ],
        "max",
    )


def skew_of(value: Column) -> Column:
    """Bias-corrected skewness; 0 for a constant column of three or more."""
    n = F.count(value).cast("double")
    raw = F.coalesce(F.skewness(value), F.lit(0.0))
    return F.when(n >= 3, raw * F.sqrt(n * (n - 1)) / F.greatest(n - 2, F.lit(1.0)))


def kurtosis_of(value: Column) -> Column:
    """Bias-corrected excess kurtosis; 0 for a constant column of four or more."""
    n = F.count(value).cast("double")
    raw = F.kurtosis(value)
    scale = (n - 1) / F.greatest((n - 2) * (n - 3), F.lit(1.0))
    return F.when(
        n >= 4, F.coalesce(scale * ((n + 1) * raw + 6), F.lit(0.0))
    )


def shape(df: DataFrame, name: str) -> DataFrame:
    value = number(df, name)
    return df.agg(skew_of(value).alias("skew"), kurtosis_of(value).alias("kurtosis"))


def categorical_stats(df: DataFrame, name: str) -> DataFrame:
    """Total, unique, missing, mode, its count and its share of all rows."""
    best = _most_frequent()
    zero = F.lit(0).cast("bigint")
    return (
        _counted(df, name)
        .agg(
            F.coalesce(F.sum("n"), zero).alias("total"),
            F.count("value").alias("unique"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), zero).alias("missing"),
            best["value"].cast("string").alias("mode"),
            F.coalesce(-best["n"], zero).alias("mode_count"),
        )
        .withColumn("mode_pct", percent(F.col("mode_count"), F.col("total")))
    )


def value_counts(df: DataFrame, name: str, n: int | None = 20) -> DataFrame:
    """Most frequent values first; ties in value order. ``n=None`` lists all."""
    counted = (
        df.where(~missing(df, name))
        .groupBy(col(name).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "value")
    )
    return counted if n is None else counted.limit(n)


def missing_of(df: DataFrame) -> Column:
    """Missing cells of all columns, as one aggregate expression."""
    total = F.lit(0).cast("bigint")
    for name in df.columns:
        total = total + F.count_if(missing(df, name))
    return total


def missing_cells(df: DataFrame) -> DataFrame:
    counted = df.agg(
        (F.count(F.lit(1)) * len(df.columns)).alias("cells"),
        missing_of(df).alias("missing"),
    )
    share = percent(F.col("missing"), F.col("cells"))
    return counted.select(
        "cells",
        "missing",
        share.alias("missing_pct"),
        F.coalesce(
            percent(F.col("cells") - F.col("missing"), F.col("cells")), F.lit(100.0)
        ).alias("completeness"),
    )


def missing_by_column(df: DataFrame) -> DataFrame:
    return one_row_per_column(
        df,
        df.columns,
        {
            "rows": lambda c: F.count(F.lit(1)),
            "missing": lambda c: F.count_if(missing(df, c)),
        },
    ).withColumn("missing_pct", percent(F.col("missing"), F.col("rows")))


def problem_columns(df: DataFrame, limit: float = 0.1) -> DataFrame:
    """Columns with more than a tenth of their rows missing."""
    return (
        missing_by_column(df)
        .where(F.col("missing") > F.col("rows") * limit)
        .select("column", "missing", "missing_pct")
    )


def complete_columns(df: DataFrame) -> DataFrame:
    return missing_by_column(df).agg(
        F.count_if(F.col("missing") == 0).alias("complete"),
        F.count(F.lit(1)).alias("columns"),
    )


def duplicate_stats(df: DataFrame) -> DataFrame:
    """Rows beyond the first copy of each row.

    Copies are merged before the shuffle; long text travels as a digest.
    """
    zero = F.lit(0).cast("bigint")
    return (
        df.groupBy(*[compact(df, c).alias(c) for c in df.columns])
        .agg(F.count(F.lit(1)).alias("__copies"))
        .agg(
            F.coalesce(F.sum("__copies"), zero).alias("rows"),
            F.coalesce(F.sum(F.col("__copies") - 1), zero).alias("duplicates"),
        )
        .withColumn("duplicate_pct", percent(F.col("duplicates"), F.col("rows")))
    )


def outliers_of(df: DataFrame, fences: dict[str, Fences]) -> Column:
    """Outlier cells over the given columns, as one aggregate expression."""
    total = F.lit(0).cast("bigint")
    for name, limits in fences.items():
        total = total + F.count_if(outside(df, name, limits))
    return total


def outlier_cells(df: DataFrame, fences: dict[str, Fences] | None = None) -> DataFrame:
    fences = fences if fences is not None else find_fences(df, numeric_columns(df))
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"), outliers_of(df, fences).alias("outliers")
    )
    return counted.withColumn("outlier_pct", percent(F.col("outliers"), F.col("rows")))


def column_outliers(df: DataFrame) -> DataFrame:
    """Fences and outlier count of each numeric column."""
    names = numeric_columns(df)
    fences = find_fences(df, names)
    return one_row_per_column(
        df,
        names,
        {"outliers": lambda c: F.count_if(outside(df, c, fences[c]))},
        {
            "low": lambda c: F.lit(fences[c].low).cast("double"),
            "high": lambda c: F.lit(fences[c].high).cast("double"),
        },
    )


def iqr_fences(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = list(columns or numeric_columns(df))
    rows = [
        (c, f.q1, f.q3, f.iqr, f.low, f.high) for c, f in find_fences(df, names).items()
    ]
    return df.sparkSession.createDataFrame(
        rows, "column string, q1 double, q3 double, iqr double, low double, high double"
    )


def box_stats(df: DataFrame, name: str) -> DataFrame:
    """Quartiles, fences, and the extreme values inside the fences."""
    q1, q2, q3 = exact_quantiles(df, [name], (0.25, 0.5, 0.75))[name]
    fences = Fences(q1, q3)
    value = number(df, name)
    kept = F.when(inside(df, name, fences), value)
    return df.agg(
        F.min(kept).alias("whisker_low"),
        F.max(kept).alias("whisker_high"),
        F.count_if(outside(df, name, fences)).alias("outliers"),
    ).select(
        *[
            F.lit(v).cast("double").alias(label)
            for label, v in (
                ("q1", q1),
                ("median", q2),
                ("q3", q3),
                ("low", fences.low),
                ("high", fences.high),
            )
        ],
        "whisker_low",
        "whisker_high",
        "outliers",
    )


def histogram(df: DataFrame, name: str, bins: int = 30) -> DataFrame:
    """Counts in equal-width bins, the last one closed, empty bins included."""
    value = number(df, name)
    edge = df.agg(F.min(value).alias("low"), F.max(value).alias("high")).first()
    schema = "bin int, low double, high double, n bigint"
    if edge["low"] is None:
        return df.sparkSession.createDataFrame([], schema)
    low, high = edge["low"], edge["high"]
    width = (high - low) / bins
    if width == 0:
        place = F.lit(0).cast("bigint")
    else:
        place = F.least(
            F.floor((value - F.lit(low)) / F.lit(width)), F.lit(bins - 1).cast("bigint")
        )
    counted = (
        df.where(value.isNotNull())
        .groupBy(place.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    empty = df.sparkSession.range(bins).select(
        F.col("id").alias("bin"), F.lit(0).cast("bigint").alias("n")
    )
    return (
        counted.unionByName(empty)
        .groupBy("bin")
        .agg(F.sum("n").alias("n"))
        .select(
            F.col("bin").cast("int").alias("bin"),
            (F.lit(low) + F.col("bin") * F.lit(width)).alias("low"),
            (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("high"),
            "n",
        )
    )


def histograms(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 30) -> DataFrame:
    """(column, bin, low, high, n) of each numeric column, all from two scans.

    What to show of a table without a date. Equal-width bins, the last one closed, empty
    ones included; a column without a value has none.
    """
    names = list(columns or numeric_columns(df))
    schema = "column string, bin int, low double, high double, n bigint"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    values = [number(df, c) for c in names]
    edges = df.agg(
        *[f(v).alias(f"{t}{i}") for i, v in enumerate(values) for t, f in (("a", F.min), ("b", F.max))]
    ).first()
    places, rows = [], []
    for i, (name, value) in enumerate(zip(names, values)):
        low, high = edges[f"a{i}"], edges[f"b{i}"]
        width = 0.0 if low is None else (high - low) / bins
        at = F.lit(0.0) if not width else F.floor((value - F.lit(low)) / F.lit(width))
        place = F.least(at.cast("int"), F.lit(bins - 1))
        places.append(F.when(value.isNotNull(), place))
        if low is not None:
            rows += [(i, name, b, low + b * width, low + (b + 1) * width) for b in range(bins)]
    # One row per column and bin.
    empty = df.sparkSession.createDataFrame(
        rows, "position int, column string, bin int, low double, high double"
    )
    counted = (
        unfold(df, places)
        .where(F.col("value").isNotNull())
        .groupBy("position", F.col("value").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return empty.join(counted, ["position", "bin"], "left").select(
        "column", "bin", "low", "high", F.coalesce("n", F.lit(0).cast("bigint")).alias("n")
    )


def quality_label(missing_pct: Column) -> Column:
    return F.when(missing_pct == 0, "Excellent").otherwise(
        grade(missing_pct, QUALITY_STEPS, "Poor")
    )


# First rows that are looked at for the first values of all columns together.
FIRST_ROWS = 64


def first_values(df: DataFrame, key: Sequence[str], n: int = 3) -> DataFrame:
    """(position, sample): the first ``n`` values of each column in key order.

    One scan takes the first rows of the table, each task keeping its own first few, and
    most columns have their values there. A column with more gaps than that is read by
    itself in the same way, with its gaps left out in the scan. The key is taken to be
    unique.
    """
    order = [col(k) for k in key]
    names = [f"v{i}" for i in range(len(df.columns))]
    cells = [
        F.when(~missing(df, c), as_text(df, c)).alias(v) for c, v in zip(df.columns, names)
    ]
    rows = df.orderBy(*order).limit(FIRST_ROWS).select(*cells).collect()
    found = [[r[v] for r in rows if r[v] is not None][:n] for v in names]
    if len(rows) == FIRST_ROWS:
        short = [i for i, values in enumerate(found) if len(values) < n]
        parts = [
            df.where(~missing(df, df.columns[i]))
            .orderBy(*order)
            .limit(n)
            .select(F.lit(i).alias("position"), as_text(df, df.columns[i]).alias("value"))
            for i in short
        ]
        for i in short:
            found[i] = []
        for row in reduce(DataFrame.union, parts).collect() if parts else ():
            found[row["position"]].append(row["value"])
    # One row per column of the table.
    samples = [(i, ", ".join(values)) for i, values in enumerate(found) if values]
    return df.sparkSession.createDataFrame(samples, "position int, sample string")


def profile_report(df: DataFrame, key: Sequence[str] | None = None) -> DataFrame:
    """Type, missing, unique and quality per column; a sample when a key is given."""
    facts = column_facts(df)
    share = percent(F.col("missing"), F.col("rows"))
    report = facts.select(
        "position",
        "column",
        "type",
        "missing",
        share.alias("missing_pct"),
        "unique",
        quality_label(share).alias("quality"),
    )
    if key is None:
        return report.drop("position")
    return report.join(first_values(df, key), "position", "left").drop("position")


def cardinality(df: DataFrame) -> DataFrame:
    """How many different values a column has, and what that makes it."""
    facts = column_facts(df)
    unique, rows = F.col("unique"), F.col("rows")
    share = percent(unique, rows)
    kind = (
        F.when(unique == 1, "Constant")
        .when(unique == rows, "Unique ID")
        .when(share > 95, "High Cardinality")
        .when(share < 5, "Low Cardinality")
        .otherwise("Medium")
    )
    return facts.select("column", "unique", share.alias("unique_pct"), kind.alias("category"))


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with one value, gaps aside: their smallest value is their largest."""

    def still(name: str) -> Column:
        cell = F.when(~missing(df, name), stand_in(df, name))
        return F.coalesce(F.min(cell) == F.max(cell), F.lit(False))

    facts = one_row_per_column(df, df.columns, {"still": still})
    return facts.where("still").select("position", "column")


def find_moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple]:
    """(mean, sample std) per column, from one aggregate."""
    if not columns:
        return {}
    row = df.agg(
        *[F.avg(number(df, c)).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_samp(number(df, c)).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}


def zscore_outliers(df: DataFrame) -> DataFrame:
    """Cells more than three sample deviations from their column mean."""
    total = F.lit(0).cast("bigint")
    for name, (mean, std) in find_moments(df, numeric_columns(df)).items():
        if std:
            far = F.abs((number(df, name) - F.lit(mean)) / F.lit(std)) > Z_LIMIT
            total = total + F.count_if(F.coalesce(far, F.lit(False)))
    return df.agg(F.count(F.lit(1)).alias("rows"), total.alias("z_outliers")).select("z_outliers")


def numeric_insights(df: DataFrame) -> DataFrame:
    return one_row_per_column(
        df,
        numeric_columns(df),
        {
            "mean": lambda c: F.avg(number(df, c)),
            "max": lambda c: F.max(number(df, c)),
            "min": lambda c: F.min(number(df, c)),
            "std": lambda c: F.stddev_samp(number(df, c)),
        },
    )


def category_insights(df: DataFrame, top: int = 5) -> DataFrame:
    """The most frequent values of each text column."""
    names = text_columns(df)
    order = Window.partitionBy("position").orderBy(F.desc("n"), "value")
    label = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("position") + 1)
    return (
        value_counts_by_column(df, names)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .select("position", label.alias("column"), "rank", "value", "n")
    )
