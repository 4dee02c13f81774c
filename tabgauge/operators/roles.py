"""Column roles: which columns are numbers, text or dates, and what they mean."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabgauge.functions.expr import DATE_TYPES, NUMERIC_TYPES, col, one_row_per_column
from tabgauge.functions.rules import (
    CONTEXT_DATE_NAME_PARTS,
    DATE_NAME_PARTS,
    GENERIC,
    ROLE_PARTS,
    SCENARIO_PARTS,
)


def normalize(df: DataFrame) -> DataFrame:
    """Read floating NaN as missing, once, on entry."""
    floating = {
        f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    }
    if not floating:
        return df
    return df.select(
        *[
            F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floating else col(c)
            for c in df.columns
        ]
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC_TYPES)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def stored_date_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, DATE_TYPES)]


def type_name(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def parsed_time(df: DataFrame, name: str) -> Column:
    """The column as a timestamp; null where the text is not a date."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return col(name)
    if isinstance(kind, T.DateType):
        return col(name).cast("timestamp_ntz")
    return F.trim(col(name).cast("string")).try_cast("timestamp_ntz")


def classify_columns(df: DataFrame) -> DataFrame:
    """One row per column with its type and numeric/text/date flags.

    Text is a date column when every value parses and some value has a dash or
    a slash; one aggregate decides it for all text columns.
    """
    texts = set(text_columns(df))
    numbers = set(numeric_columns(df))
    dates = set(stored_date_columns(df))

    def parses(name: str) -> Column:
        if name not in texts:
            return F.max(F.lit(name in dates))
        good = F.bool_and(col(name).isNull() | parsed_time(df, name).isNotNull())
        marked = F.bool_or(col(name).rlike("[-/]"))
        return F.coalesce(good & marked, F.lit(False))

    flagged = one_row_per_column(
        df,
        df.columns,
        {"is_date": parses},
        {
            "type": lambda c: F.lit(type_name(df, c)),
            "is_numeric": lambda c: F.lit(c in numbers),
            "is_text": lambda c: F.lit(c in texts),
        },
    )
    return flagged.select("position", "column", "type", "is_numeric", "is_text", "is_date")


def named_like(name: str | Column, parts: Sequence[str]):
    """Whether a column name contains one of the fragments, case ignored."""
    if isinstance(name, str):
        return any(part in name.lower() for part in parts)
    lowered = F.lower(name)
    test = F.lit(False)
    for part in parts:
        test = test | lowered.contains(part)
    return test


def date_names(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if named_like(c, DATE_NAME_PARTS)]


def context_date_name(columns: Sequence[str]) -> str | None:
    return next((c for c in columns if named_like(c, CONTEXT_DATE_NAME_PARTS)), None)


def date_columns_by_name(df: DataFrame) -> DataFrame:
    """Columns whose name speaks of time, with how many values read as dates."""
    return _date_report(df, date_names(df.columns))


def context_date_column(df: DataFrame) -> DataFrame:
    """The one date column used when answering questions."""
    chosen = context_date_name(df.columns)
    return _date_report(df, [chosen] if chosen else [])


def _date_report(df: DataFrame, names: list[str]) -> DataFrame:
    if not names:
        empty = "position int, column string, filled bigint, parsed bigint"
        return df.sparkSession.createDataFrame([], empty)
    report = one_row_per_column(
        df,
        names,
        {
            "filled": lambda c: F.count(col(c)),
            "parsed": lambda c: F.count(parsed_time(df, c)),
        },
    )
    place = {c: i for i, c in enumerate(df.columns)}
    position = F.create_map(*[F.lit(x) for c in names for x in (c, place[c])])
    return report.select(
        position[F.col("column")].alias("position"), "column", "filled", "parsed"
    )


@dataclass
class Scenario:
    """What the table seems to be about and which column plays which part."""

    name: str
    critical: str | None = None
    health: str | None = None
    efficiency: str | None = None
    unit: str | None = None
    numeric: list[str] = field(default_factory=list)

    def rows(self) -> list[tuple[str, str | None]]:
        return [
            ("critical", self.critical),
            ("health", self.health),
            ("efficiency", self.efficiency),
            ("unit", self.unit),
        ]


def scenario_name(columns: Sequence[str]) -> str:
    joined = " ".join(columns)
    for name, parts in SCENARIO_PARTS.items():
        if named_like(joined, parts):
            return name
    return GENERIC


def detect_scenario(
    df: DataFrame,
    critical: str | None = None,
    health: str | None = None,
    efficiency: str | None = None,
    unit: str | None = None,
) -> Scenario:
    """Scenario and metric roles from the column names; arguments override."""
    numeric, text = numeric_columns(df), text_columns(df)
    name = scenario_name(df.columns)
    found = {}
    for role, (kind, parts) in ROLE_PARTS[name].items():
        pool = numeric if kind == "numeric" else text
        found[role] = next((c for c in pool if named_like(c, parts)), None)
    chosen = Scenario(
        name,
        critical or found.get("critical"),
        health or found.get("health"),
        efficiency or found.get("efficiency"),
        unit or found.get("unit"),
        numeric,
    )
    if not chosen.critical and numeric:
        chosen.critical = numeric[-1]
    if not chosen.health and len(numeric) > 1:
        chosen.health = numeric[0]
    return chosen


def metric_roles(df: DataFrame, scenario: Scenario | None = None) -> DataFrame:
    """(scenario, role, column, filled, mean) for the roles that are taken."""
    scenario = scenario or detect_scenario(df)
    taken = [(role, c) for role, c in scenario.rows() if c]
    numbers = set(scenario.numeric)
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(col(c)).alias(f"{role}_n") for role, c in taken],
        *[F.avg(col(c)).alias(f"{role}_m") for role, c in taken if c in numbers],
    )
    rows = [
        F.struct(
            F.lit(scenario.name).alias("scenario"),
            F.lit(role).alias("role"),
            F.lit(c).alias("column"),
            F.col(f"{role}_n").alias("filled"),
            (F.col(f"{role}_m") if c in numbers else F.lit(None).cast("double")).alias("mean"),
        )
        for role, c in taken
    ]
    return wide.select(F.inline(F.array(*rows)))


def classify_catalog(catalog: DataFrame) -> DataFrame:
    """Name rules over a frame of (table, position, column, dtype), in one job.

    Adds the date flags per column and the scenario per table, for as many
    tables as the catalog lists.
    """
    from pyspark.sql import Window

    whole = Window.partitionBy("table")
    scenario = None
    for name, parts in SCENARIO_PARTS.items():
        test = F.bool_or(named_like(F.col("column"), parts)).over(whole)
        scenario = F.when(test, name) if scenario is None else scenario.when(test, name)
    by_context = named_like(F.col("column"), CONTEXT_DATE_NAME_PARTS)
    first = F.min(F.when(by_context, F.col("position"))).over(whole)
    return catalog.select(
        "table",
        "position",
        "column",
        named_like(F.col("column"), DATE_NAME_PARTS).alias("date_name"),
        F.coalesce(F.col("position") == first, F.lit(False)).alias("context_date"),
        scenario.otherwise(GENERIC).alias("scenario"),
    )


def type_distribution(df: DataFrame) -> DataFrame:
    """Columns and filled cells per type."""
    rows = one_row_per_column(
        df,
        df.columns,
        {"filled": lambda c: F.count(col(c))},
        {"type": lambda c: F.lit(type_name(df, c))},
    )
    return rows.groupBy("type").agg(
        F.count(F.lit(1)).alias("columns"), F.sum("filled").alias("filled")
    )


def text_looks_numeric(df: DataFrame) -> DataFrame:
    """Text columns holding digits only in more than 80% of all rows."""
    counted = one_row_per_column(
        df,
        text_columns(df),
        {
            "rows": lambda c: F.count(F.lit(1)),
            "numeric_like": lambda c: F.count_if(col(c).rlike(r"^\p{N}+$")),
        },
    )
    return counted.select(
        "column",
        "numeric_like",
        (F.col("numeric_like") > F.col("rows") * 0.8).alias("looks_numeric"),
    )


def forecastable_columns(df: DataFrame, most: int = 5) -> DataFrame:
    """Numeric columns, and text columns with at most five distinct values."""
    from tabgauge.operators.profile import column_facts

    facts = column_facts(df, numeric_columns(df) + text_columns(df))
    numbers = numeric_columns(df)
    is_number = F.col("column").isin(numbers) if numbers else F.lit(False)
    return facts.where(is_number | (F.col("unique") <= most)).select(
        "column", F.when(is_number, "numeric").otherwise("category").alias("kind"), "unique"
    )


def match_columns(
    questions: DataFrame, text: str, columns: Sequence[str], fallback: Sequence[str]
) -> DataFrame:
    """Columns each question asks about; the fallback columns where none match."""
    lowered = F.lower(F.coalesce(col(text), F.lit("")))
    hits = []
    for name in columns:
        words = [w for w in name.lower().replace("_", " ").split() if len(w) > 2]
        test = F.lit(False)
        for word in words:
            test = test | lowered.contains(word)
        hits.append(F.when(test, F.lit(name)))
    found = F.array_compact(F.array(*hits))
    default = F.array(*[F.lit(c) for c in fallback])
    return questions.withColumn(
        "columns", F.when(F.size(found) > 0, found).otherwise(default)
    )


def matching_names(question: str, columns: Sequence[str], fallback: Sequence[str]) -> list[str]:
    """The same rule for one question over one table's column names."""
    lowered = question.lower()
    hits = [
        c
        for c in columns
        if any(len(w) > 2 and w in lowered for w in c.lower().replace("_", " ").split())
    ]
    return hits or list(fallback)
