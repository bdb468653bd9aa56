"""Readings beyond a limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartline.layout import PATIENTS, Layout, limits_table
from chartline.operators.select import known, readings_long


def threshold_breaches(
    readings: DataFrame, limits: dict | None = None, layout: Layout = PATIENTS
) -> DataFrame:
    """Readings strictly below their low or above their high limit, and by which side.

    ``limits`` maps a signal to ``(low, high)``; a missing limit is not applied. The limits are one
    row per signal column, so they are always broadcast.
    """
    table = F.broadcast(limits_table(readings.sparkSession, limits))
    value, low, high = F.col("value"), F.col("low"), F.col("high")
    return (
        readings_long(known(readings, layout), layout=layout)
        .join(table, "signal")
        .where((value < low) | (value > high))
        .select(
            layout.entity, layout.time, "signal", "value",
            F.when(value < low, "low").otherwise("high").alias("side"),
        )
    )


def breach_counts(
    readings: DataFrame, limits: dict | None = None, layout: Layout = PATIENTS
) -> DataFrame:
    """Breaches per entity, signal and side."""
    return (
        threshold_breaches(readings, limits, layout)
        .groupBy(layout.entity, "signal", "side")
        .agg(F.count(F.lit(1)).alias("breaches"))
    )
