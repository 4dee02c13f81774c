"""Facts and rows that answer a question about a table."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabgauge.functions.expr import DATE_TYPES, col
from tabgauge.functions.rules import DATE_PHRASES
from tabgauge.operators.correlation import strong_corr
from tabgauge.operators.profile import category_insights, numeric_insights
from tabgauge.operators.roles import (
    context_date_name,
    matching_names,
    numeric_columns,
    text_columns,
)


def insights(df: DataFrame) -> DataFrame:
    """Everything known up front, as (section, place, key, stat, value).

    Sections: columns (place in the table, kind), summary, correlation,
    categories and total.
    """
    date = context_date_name(df.columns)
    kinds = (
        [(c, "numeric") for c in numeric_columns(df)]
        + [(c, "categorical") for c in text_columns(df)]
        + ([(date, "date")] if date else [])
    )
    # One row per column of the table.
    columns = df.sparkSession.createDataFrame(
        [("columns", df.columns.index(c), c, kind, None) for c, kind in kinds],
        "section string, place int, key string, stat string, value double",
    )
    stats = ("mean", "max", "min", "std")
    summary = numeric_insights(df).select(
        F.lit("summary").alias("section"),
        F.col("position").alias("place"),
        F.col("column").alias("key"),
        F.inline(
            F.array(
                *[F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in stats]
            )
        ),
    )
    linked = strong_corr(df).select(
        F.lit("correlation").alias("section"),
        (F.col("i") * len(df.columns) + F.col("j")).alias("place"),
        F.col("col1").alias("key"),
        F.col("col2").alias("stat"),
        F.col("r").alias("value"),
    )
    parts = [columns, summary, linked]
    if text_columns(df):
        parts.append(
            category_insights(df).select(
                F.lit("categories").alias("section"),
                (F.col("position") * 10 + F.col("rank")).alias("place"),
                F.col("column").alias("key"),
                F.col("value").alias("stat"),
                F.col("n").cast("double").alias("value"),
            )
        )
    parts.append(
        df.agg(F.count(F.lit(1)).cast("double").alias("value")).select(
            F.lit("total").alias("section"),
            F.lit(0).alias("place"),
            F.lit("rows").alias("key"),
            F.lit("count").alias("stat"),
            "value",
        )
    )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def asked_day(question: str) -> str | None:
    """Month and day of the first known date phrase in the question."""
    lowered = question.lower()
    return next((day for phrase, day in DATE_PHRASES if phrase in lowered), None)


# What a stored text date looks like if its order is that of the days; nothing may follow
# the time of day.
ISO_TEXT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9:.]*)?$"
MOST_YEARS = 400


def day_ranges(first: int, last: int, day: str) -> list[tuple[str, str | None]]:
    """Start and end, the end left out, of the stretches of days whose text contains the
    month and day: that day of every year, and in a year that ends in the digits of the month
    the whole month numbered as the day."""
    month, number = int(day[:2]), int(day[3:])
    found = []
    for year in range(first, last + 1):
        try:
            start = datetime.date(year, month, number)
        except ValueError:
            start = None
        if start == datetime.date.max:
            found.append((start, None))
        elif start:
            found.append((start, start + datetime.timedelta(1)))
        if year % 100 == month and 1 <= number <= 12:
            after = datetime.date(year + number // 12, number % 12 + 1, 1)
            found.append((datetime.date(year, number, 1), after))
    return [(str(a), None if b is None else str(b)) for a, b in found]


def date_text_filter(df: DataFrame, date: str, question: str) -> DataFrame:
    """Rows whose date, as text, contains the asked month and day.

    The first and last year of the column turn the question into ranges of days, which the
    scan can use to skip row groups; only dates that are not in the order of their text are
    searched as text.
    """
    day = asked_day(question)
    if not day:
        return df
    text = col(date).cast("string").contains(day)
    kind = df.schema[date].dataType
    if isinstance(kind, DATE_TYPES):
        ends, ordered = (F.year(F.min(col(date))), F.year(F.max(col(date)))), F.lit(True)
    elif isinstance(kind, T.StringType):
        ends = (F.left(f(col(date)), F.lit(4)).try_cast("int") for f in (F.min, F.max))
        ordered = F.coalesce(F.bool_and(col(date).rlike(ISO_TEXT)), F.lit(True))
    else:
        return df.where(text)
    first, last, ordered = df.agg(*ends, ordered).first()
    if first is None and ordered:
        return df.where(F.lit(False))
    if not ordered or first < 1 or last > 9999 or last - first > MOST_YEARS:
        return df.where(text)
    wanted = F.lit(False)
    for start, end in day_ranges(first, last, day):
        inside = col(date) >= F.lit(start).cast(kind)
        wanted = wanted | (inside if end is None else inside & (col(date) < F.lit(end).cast(kind)))
    return df.where(wanted)


def shown_columns(columns: Sequence[str], date: str | None) -> list[str]:
    """The asked columns and the date, each once."""
    return list(dict.fromkeys([*columns, *([date] if date else [])]))


def project_relevant(
    df: DataFrame, columns: Sequence[str], date: str | None, key: Sequence[str]
) -> DataFrame:
    """The asked columns and the date of every row, in key order."""
    ordered = df.orderBy(*[col(k) for k in key])
    return ordered.select(*[col(c) for c in shown_columns(columns, date)])


def asked_columns(df: DataFrame, question: str) -> tuple[list[str], str | None]:
    columns = matching_names(question, df.columns, numeric_columns(df))
    return columns, context_date_name(df.columns)


def question_context(df: DataFrame, question: str, key: Sequence[str]) -> DataFrame:
    """The rows that bear on a question: its columns, its day, in key order."""
    columns, date = asked_columns(df, question)
    rows = date_text_filter(df, date, question) if date else df
    return project_relevant(rows, columns, date, key)


def context_text(df: DataFrame, question: str, key: Sequence[str]) -> DataFrame:
    """(part, place, line): the question, the columns, all facts and all rows that bear
    on it, one line of text each.

    Read in the order of part and place, they are the text to answer from. A row's
    place is its key; other places are numbers, as text.
    """
    numbers, texts = numeric_columns(df), text_columns(df)
    columns, date = asked_columns(df, question)
    shown = shown_columns(columns, date)
    section, key_, stat, value = (F.col(c) for c in ("section", "key", "stat", "value"))
    # A handful of lines made from names.
    head = df.sparkSession.createDataFrame(
        [
            (1, "0", f"question: {question}"),
            (2, "0", "numeric: " + ", ".join(numbers)),
            (2, "1", "categorical: " + ", ".join(texts)),
            (2, "2", "shown: " + ",".join(shown)),
        ],
        "part int, place string, line string",
    )
    figure = F.round(value, 2).cast("decimal(38,2)").cast("string")
    facts = (
        insights(df)
        .where(section.isin("total", "summary", "correlation"))
        .select(
            F.lit(3).alias("part"),
            F.concat_ws(
                "/",
                F.when(section == "total", "1").when(section == "summary", "2").otherwise("3"),
                F.col("place").cast("string"),
                stat,
            ).alias("place"),
            F.when(section == "total", F.concat(F.lit("rows: "), value.cast("bigint")))
            .when(section == "summary", F.concat_ws(" ", key_, stat, figure))
            .otherwise(F.concat_ws(" ", key_, F.lit("~"), stat, figure))
            .alias("line"),
        )
    )
    rows = date_text_filter(df, date, question) if date else df
    cells = [F.coalesce(col(c).cast("string"), F.lit("")) for c in shown]
    lines = rows.select(
        F.lit(4).alias("part"),
        F.concat_ws("/", *[col(k).cast("string") for k in key]).alias("place"),
        F.concat_ws(",", *cells).alias("line"),
    )
    return head.unionByName(facts).unionByName(lines)
