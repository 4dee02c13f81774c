"""The report: one frame per section, written side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgauge.functions.expr import merge_rows
from tabgauge.operators.correlation import corr_matrix, report_relationship
from tabgauge.operators.groups import first_groups, trend
from tabgauge.operators.profile import complete_columns, describe, histogram, profile_report
from tabgauge.operators.quantiles import number
from tabgauge.operators.roles import date_names, numeric_columns, text_columns
from tabgauge.operators.series import trend_direction
from tabgauge.plans.health import quality_report, report_health_score, report_recommendations
from tabgauge.plans.narrative import variability_label
from tabgauge.sources.messages import chat_export
from tabgauge.sources.sampling import preview
from tabgauge.sources.tables import write_text

SECTIONS = ("preview", "dashboard", "inspector", "forecast", "narration", "chat")


def report_story(df: DataFrame) -> DataFrame:
    """Mean, range and variability of the first numeric column."""
    metric = numeric_columns(df)[0]
    return describe(df, metric).select(
        F.lit(metric).alias("metric"),
        "mean",
        "min",
        "max",
        "std",
        variability_label(F.col("std"), F.col("mean")).alias("variability"),
    )


def report_forecast(df: DataFrame, date: str, metric: str) -> DataFrame:
    """Current average and projected direction of a metric."""
    average = df.agg(F.avg(number(df, metric)).alias("current_average"))
    return merge_rows(average, trend_direction(df, date, metric).select("direction"))


def report_sections(
    df: DataFrame,
    key: Sequence[str],
    messages: DataFrame | None = None,
    sections: Sequence[str] = SECTIONS,
    date: str | None = None,
) -> dict[str, DataFrame]:
    """The frames of the chosen sections, by name; each is computed on writing."""
    unknown = set(sections) - set(SECTIONS)
    if unknown:
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    numbers, texts = numeric_columns(df), text_columns(df)
    dates = [date] if date else date_names(df.columns)
    frames = {"summary": report_health_score(df)}
    if "preview" in sections:
        frames["preview_rows"] = preview(df, key)
        frames["preview_columns"] = profile_report(df)
    if "dashboard" in sections and numbers:
        frames["dashboard_metric"] = describe(df, numbers[0])
        frames["dashboard_distribution"] = histogram(df, numbers[0])
        if texts:
            frames["dashboard_groups"] = first_groups(df, texts[0], numbers[0])
        if len(numbers) > 1:
            frames["dashboard_correlation"] = corr_matrix(df)
    if "inspector" in sections:
        frames["inspector_columns"] = profile_report(df)
        frames["inspector_complete"] = complete_columns(df)
    if "forecast" in sections and dates and numbers:
        frames["forecast_trend"] = trend(df, dates[0], numbers[0])
        frames["forecast_direction"] = report_forecast(df, dates[0], numbers[0])
    if "narration" in sections:
        if numbers:
            frames["narration_story"] = report_story(df)
        if len(numbers) > 1:
            frames["narration_relationship"] = report_relationship(df)
        frames["narration_steps"] = report_recommendations(df)
    if "chat" in sections and messages is not None:
        frames["chat"] = chat_export(messages)
    return frames


def export_report(frames: dict[str, DataFrame], path: str, format: str = "parquet") -> None:
    """Write every frame to its own folder under the path."""
    for name, frame in frames.items():
        frame.write.mode("overwrite").format(format).save(f"{path}/{name}")


def export_quality_report(df: DataFrame, path: str) -> None:
    write_text(quality_report(df), path)
