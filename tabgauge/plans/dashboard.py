"""The monitoring view of a table: roles, key figures, alerts and their cause."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgauge.functions.expr import col, merge_rows, percent
from tabgauge.functions.rules import DEFAULT_EFFICIENCY
from tabgauge.operators.correlation import root_cause
from tabgauge.operators.groups import alerts
from tabgauge.operators.profile import missing_of
from tabgauge.operators.quantiles import number
from tabgauge.operators.roles import Scenario, detect_scenario, numeric_columns
from tabgauge.plans.health import integrity_of


def kpi(df: DataFrame, scenario: Scenario | None = None) -> DataFrame:
    """Active units, efficiency, number of alerts and data integrity, one row."""
    scenario = scenario or detect_scenario(df)
    if scenario.efficiency in numeric_columns(df):
        value = number(df, scenario.efficiency)
        efficiency = F.when(
            F.max(value) > 0, F.avg(value) / F.nullif(F.max(value), F.lit(0.0)) * 100
        ).otherwise(DEFAULT_EFFICIENCY)
    else:
        efficiency = F.max(F.lit(DEFAULT_EFFICIENCY))
    base = df.agg(
        F.count(F.lit(1)).alias("rows"),
        efficiency.alias("efficiency"),
        percent(missing_of(df), F.count(F.lit(1)) * len(df.columns)).alias("missing_pct"),
    )
    raised = alerts(df, scenario.unit, scenario.critical).agg(
        F.count(F.lit(1)).alias("alerts")
    )
    frames = [base, raised]
    if scenario.unit:
        # Distinct first, so that a unit with most of the rows costs no more.
        units = df.select(col(scenario.unit).alias("u")).where(F.col("u").isNotNull()).distinct()
        frames.append(units.agg(F.count(F.lit(1)).alias("units")))
    merged = merge_rows(*frames)
    score, status = integrity_of(F.col("missing_pct"))
    return merged.select(
        F.lit(scenario.name).alias("scenario"),
        (F.col("units") if scenario.unit else F.col("rows")).alias("active_units"),
        "efficiency",
        "alerts",
        score.alias("integrity"),
        status.alias("integrity_status"),
    )


def diagnosed_alerts(df: DataFrame, scenario: Scenario | None = None) -> DataFrame:
    """Alerts with the likely cause of each, where one is found."""
    scenario = scenario or detect_scenario(df)
    raised = alerts(df, scenario.unit, scenario.critical)
    if len(numeric_columns(df)) < 2:
        return raised.where(F.lit(False)).select(
            F.col("unit").alias("alert"),
            F.col("metric").alias("symptom"),
            F.col("metric").alias("likely_cause"),
            F.col("avg_value").alias("correlation"),
            F.col("severity").alias("recommendation"),
        )
    return root_cause(df, raised, scenario.critical)
