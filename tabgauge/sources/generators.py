"""Made-up tables for trying things out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def synth_basic(spark: SparkSession, n: int = 1000, seed: int = 7) -> DataFrame:
    """Daily rows from 2023-01-01 with a category, a value and a 0/1 target."""
    kinds = F.array(F.lit("A"), F.lit("B"), F.lit("C"))
    return spark.range(n).select(
        F.timestamp_add("DAY", F.col("id").cast("int"), F.lit("2023-01-01").cast("timestamp_ntz")).alias("Date"),
        F.element_at(kinds, (F.floor(F.rand(seed) * 3) + 1).cast("int")).alias("Category"),
        (F.randn(seed + 1) * 100).alias("Value"),
        F.floor(F.rand(seed + 2) * 2).cast("int").alias("Target"),
    )


def synth_machine(spark: SparkSession, n: int = 500, seed: int = 42) -> DataFrame:
    """Hourly readings of five machines; defective when hot and shaking."""
    readings = spark.range(n).select(
        F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("timestamp"),
        (F.floor(F.rand(seed) * 5) + 1).cast("string").alias("machine_id"),
        (F.randn(seed + 1) * 5 + 70).alias("temp_C"),
        F.abs(F.randn(seed + 2) * 0.4 + 1.2).alias("vibration"),
        (F.randn(seed + 3) * 3 + 30).alias("pressure"),
        (F.floor(F.rand(seed + 4) * 70) + 80).cast("int").alias("units_produced"),
    )
    return readings.withColumn(
        "defective", ((F.col("vibration") > 1.6) & (F.col("temp_C") > 74)).cast("int")
    )
