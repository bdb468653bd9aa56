"""Filters, projections and small look-ups over readings and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartline.functions.times import calendar_bounds, ntz
from chartline.layout import PATIENTS, Layout


def filter_patient(df: DataFrame, patient, layout: Layout = PATIENTS) -> DataFrame:
    """Rows of one entity. A plain equality, so it reaches the file scan."""
    return df.where(F.col(layout.entity) == F.lit(patient))


def filter_time_range(df: DataFrame, start, end, layout: Layout = PATIENTS) -> DataFrame:
    """Rows within ``[start, end]``, both ends included.

    Readings are filtered on their time, events on the time they happened (intervals on their start).
    """
    first, last = ntz(start), ntz(end)
    names = [layout.time] if layout.time in df.columns else [layout.event_time, layout.event_start]
    columns = [F.col(c) for c in names if c in df.columns]
    if not columns:
        raise ValueError(f"no time column to filter on: none of {', '.join(names)} in {', '.join(df.columns)}")
    within = columns[0].between(first, last)
    if len(columns) == 2:
        # Spelled out rather than with coalesce, so that it reaches the scan.
        within = within | (columns[0].isNull() & columns[1].between(first, last))
    return df.where(within)


def filter_calendar_days(df: DataFrame, first, last=None, layout: Layout = PATIENTS) -> DataFrame:
    """Rows on whole calendar days from ``first`` to ``last``; one date means that day."""
    return filter_time_range(df, *calendar_bounds(first, last), layout=layout)


def known(readings: DataFrame, layout: Layout = PATIENTS) -> DataFrame:
    """Rows that say whose and when; the others belong to no entity's timeline."""
    return readings.where(F.col(layout.entity).isNotNull() & F.col(layout.time).isNotNull())


def turned_long(df: DataFrame, keys: list[str], signals: list[str]) -> DataFrame:
    """One row per key row and signal with a value: keys, signal, value."""
    pairs = [part for s in signals for part in (F.lit(s), F.col(s))]
    # stack rather than unpivot: a plan that uses the result twice then computes it once.
    long = df.select(*keys, F.stack(F.lit(len(signals)), *pairs).alias("signal", "value"))
    return long.where(F.col("value").isNotNull())


def readings_long(readings: DataFrame, signals=None, layout: Layout = PATIENTS) -> DataFrame:
    """One row per reading that has a value: entity, time, signal, value."""
    return turned_long(readings, [layout.entity, layout.time], layout.present(readings, signals))


def with_event_time(events: DataFrame, layout: Layout = PATIENTS) -> DataFrame:
    """Events with their time resolved: own time, else interval start."""
    return events.withColumn(layout.event_time, layout.event_time_of(events))


def valid_intervals(events: DataFrame, layout: Layout = PATIENTS) -> DataFrame:
    """Events flagged as intervals that have both ends."""
    if layout.interval_flag not in events.columns:
        return events.limit(0)
    return events.where(
        F.col(layout.interval_flag)
        & F.col(layout.event_start).isNotNull()
        & F.col(layout.event_end).isNotNull()
    )


def patient_list(readings: DataFrame, layout: Layout = PATIENTS) -> DataFrame:
    """Distinct entities in order."""
    return (
        readings.select(layout.entity)
        .where(F.col(layout.entity).isNotNull())
        .distinct()
        .orderBy(layout.entity)
    )


def patient_date_bounds(readings: DataFrame, layout: Layout = PATIENTS) -> DataFrame:
    """First and last calendar date per entity."""
    return readings.where(F.col(layout.entity).isNotNull()).groupBy(layout.entity).agg(
        F.to_date(F.min(layout.time)).alias("first_date"),
        F.to_date(F.max(layout.time)).alias("last_date"),
    )


def available_signals(readings: DataFrame, layout: Layout = PATIENTS) -> DataFrame:
    """Per entity and signal: does it have any value at all?"""
    present = layout.present(readings)
    counts = readings.where(F.col(layout.entity).isNotNull()).groupBy(layout.entity).agg(*(F.count(s).alias(s) for s in present))
    return counts.unpivot([layout.entity], present, "signal", "n").select(
        layout.entity, "signal", (F.col("n") > 0).alias("available")
    )


def time_extent(df: DataFrame, layout: Layout = PATIENTS) -> DataFrame:
    """First and last time over the whole frame, one row."""
    when = F.col(layout.time) if layout.time in df.columns else layout.event_time_of(df)
    return df.agg(F.min(when).alias("first_time"), F.max(when).alias("last_time"))
