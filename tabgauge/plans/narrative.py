"""The facts and wording of the written summary of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgauge.functions.expr import grade, grade_above, merge_rows, percent
from tabgauge.functions.rules import R_STRONG
from tabgauge.operators.correlation import strongest_pair
from tabgauge.operators.profile import (
    categorical_stats,
    missing_of,
    skew_of,
)
from tabgauge.operators.quantiles import Fences, exact_quantiles, number, outside
from tabgauge.operators.roles import numeric_columns, text_columns
from tabgauge.operators.series import growth

LINKED = [("strength", "double"), ("col1", "string"), ("col2", "string"), ("r", "double")]


def narrative_facts(
    df: DataFrame, date: str | None = None, key: Sequence[str] = ()
) -> DataFrame:
    """One row of everything the summary mentions.

    The first numeric column is the metric, the first text column the segment.
    """
    metric = next(iter(numeric_columns(df)), None)
    segment = next(iter(text_columns(df)), None)
    facts = [F.count(F.lit(1)).alias("rows"), missing_of(df).alias("missing")]
    median = None
    if metric:
        value = number(df, metric)
        q1, median, q3 = exact_quantiles(df, [metric], (0.25, 0.5, 0.75))[metric]
        facts += [
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("std"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
            skew_of(value).alias("skew"),
            F.count_if(outside(df, metric, Fences(q1, q3))).alias("outliers"),
        ]
    frames = [df.agg(*facts)]
    if segment:
        frames.append(
            categorical_stats(df, segment).select(
                F.col("mode").alias("top_value"), F.col("mode_pct").alias("top_pct")
            )
        )
    if date and metric:
        frames.append(growth(df, date, metric, key).select("has_time", "growth"))
    if len(numeric_columns(df)) > 1:
        frames.append(strongest_pair(df).select("col1", "col2", "r", "strength"))
    merged = merge_rows(*frames)
    have = set(merged.columns)

    def fact(name: str, kind: str, default: object = None) -> Column:
        return (F.col(name) if name in have else F.lit(default).cast(kind)).alias(name)

    mean, std = fact("mean", "double", 0.0), fact("std", "double", 0.0)
    cv = F.when(mean != 0, F.try_divide(std * 100.0, mean)).otherwise(0.0)
    return merged.select(
        "rows",
        F.lit(len(df.columns)).alias("columns"),
        "missing",
        percent(F.col("missing"), F.col("rows") * len(df.columns)).alias("missing_pct"),
        F.lit(metric).cast("string").alias("metric"),
        mean,
        std,
        fact("min", "double", 0.0),
        fact("max", "double", 0.0),
        F.lit(median).cast("double").alias("median"),
        (fact("max", "double", 0.0) - fact("min", "double", 0.0)).alias("spread"),
        cv.alias("cv"),
        fact("skew", "double", 0.0),
        fact("outliers", "bigint", 0),
        F.lit(segment).cast("string").alias("segment"),
        fact("top_value", "string", "N/A"),
        fact("top_pct", "double", 0.0),
        fact("has_time", "boolean", False),
        fact("growth", "double", 0.0),
        *[fact(name, kind, 0.0 if kind == "double" else None) for name, kind in LINKED],
    )


def volatility_label(cv: Column) -> Column:
    return grade(cv, [(20.0, "stable"), (50.0, "moderate")], "volatile")


def growth_label(change: Column) -> Column:
    up = grade_above(change, [(20.0, "rising fast"), (5.0, "rising")], "")
    down = grade(change, [(-20.0, "falling fast"), (-5.0, "falling")], "level")
    return F.when(up != "", up).otherwise(down)


def concentration_label(share: Column) -> Column:
    return grade_above(
        share, [(60.0, "in one place"), (40.0, "uneven")], "spread out"
    )


def variability_label(std: Column, mean: Column) -> Column:
    return (
        F.when(std < mean * 0.3, "steady")
        .when(std < mean * 0.6, "varied")
        .otherwise("scattered")
    )


def spread_label(spread: Column, mean: Column) -> Column:
    return F.when(spread > mean, "wide").otherwise("manageable")


def narrative_labels(facts: DataFrame) -> DataFrame:
    """The words chosen for the facts, one row."""
    return facts.select(
        volatility_label(F.col("cv")).alias("volatility"),
        growth_label(F.col("growth")).alias("growth"),
        concentration_label(F.col("top_pct")).alias("concentration"),
        variability_label(F.col("std"), F.col("mean")).alias("variability"),
        spread_label(F.col("spread"), F.col("mean")).alias("spread"),
    )


def _outlier_pct() -> Column:
    return F.coalesce(percent(F.col("outliers"), F.col("rows")), F.lit(0.0))


def risk_cards(facts: DataFrame) -> DataFrame:
    """(card, name, value, level, advice) for completeness, outliers and skew."""

    def card(number: int, name: str, value: Column, steps: tuple, advice: tuple) -> Column:
        def pick(words: Sequence[str]) -> Column:
            return grade(value, list(zip(steps, words[:2])), words[2])

        return F.struct(
            F.lit(number).alias("card"),
            F.lit(name).alias("name"),
            value.alias("value"),
            pick(("low", "medium", "high")).alias("level"),
            pick(advice).alias("advice"),
        )

    skew = F.abs(F.col("skew"))
    return facts.select(
        F.inline(
            F.array(
                card(1, "Data Completeness", F.col("missing_pct"), (1.0, 5.0),
                     ("reliable", "fill minor gaps", "clean first")),
                card(2, "Outlier Risk", _outlier_pct(), (1.0, 5.0),
                     ("stable", "investigate unusual values", "use the median")),
                card(3, "Distribution Balance", skew, (0.5, 1.0),
                     ("mean is accurate", "consider the median", "report the median")),
            )
        )
    )


def overall_verdict(facts: DataFrame) -> DataFrame:
    clean = (F.col("missing_pct") < 2) & (F.col("outliers") < F.col("rows") * 0.02)
    return facts.select(
        F.when(clean, "excellent")
        .when(F.col("missing_pct") < 10, "acceptable")
        .otherwise("needs work")
        .alias("verdict")
    )


def action_list(facts: DataFrame) -> DataFrame:
    """(days, step, action, subject, amount): the 7-day and the 30-day list."""

    def action(days: int, step: int, name: str, subject: Column, amount: Column) -> Column:
        return F.struct(
            F.lit(days).alias("days"),
            F.lit(step).alias("step"),
            F.lit(name).alias("action"),
            subject.cast("string").alias("subject"),
            amount.cast("double").alias("amount"),
        )

    nothing = F.lit(None)
    week = F.array_compact(
        F.array(
            F.when(F.col("missing_pct") > 1,
                   action(7, 1, "fix data gaps", nothing, F.col("missing_pct"))),
            F.when(F.col("outliers") > 0,
                   action(7, 2, "investigate extreme values", F.col("metric"), F.col("outliers"))),
            F.when(F.col("top_pct") > 60,
                   action(7, 3, "plan for concentration", F.col("top_value"), F.col("top_pct"))),
        )
    )
    clean = F.array(action(7, 4, "data is clean", nothing, nothing))
    pair = F.concat_ws(" + ", "col1", "col2")
    month = F.array(
        F.when(F.col("strength") > R_STRONG,
               action(30, 1, "monitor the strongest pair", pair, F.col("strength")))
        .otherwise(action(30, 1, "run weekly summaries", nothing, nothing)),
        action(30, 2, "forecast the target", F.col("metric"), nothing),
        action(30, 3, "ask which unit needs attention", nothing, nothing),
        action(30, 4, "share the report", nothing, nothing),
    )
    return facts.select(
        F.inline(F.concat(F.when(F.size(week) > 0, week).otherwise(clean), month))
    )
