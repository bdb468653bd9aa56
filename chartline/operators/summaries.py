"""Event rates, type counts and per-entity summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartline.functions.times import ntz, seconds_between
from chartline.layout import PATIENTS, Layout
from chartline.operators.profile import signal_stats


def event_rates(
    events: DataFrame,
    start=None,
    end=None,
    patients: DataFrame | None = None,
    layout: Layout = PATIENTS,
) -> DataFrame:
    """Total events and events per hour and day, per entity.

    The span is the range given, else first to last event, and at least one hour. Entities of
    ``patients`` without events get zeros.
    """
    key = layout.entity
    seen = events.select(key, layout.event_time_of(events).alias("_at"), F.lit(1).alias("_n"))
    if patients is not None:
        seen = seen.unionByName(patients.select(key, F.lit(0).alias("_n")), allowMissingColumns=True)
    totals = (
        seen.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.sum("_n").alias("total_count"),
            F.min("_at").alias("_first"),
            F.max("_at").alias("_final"),
        )
    )
    if start is not None:
        span = seconds_between(ntz(start), ntz(end))
    else:
        span = F.coalesce(seconds_between(F.col("_first"), F.col("_final")), F.lit(0.0))
    hours = F.greatest(F.lit(1.0), span / 3600)
    return totals.select(
        key,
        "total_count",
        (F.col("total_count") / hours).alias("per_hour"),
        (F.col("total_count") / (hours / 24)).alias("per_day"),
    )


def event_type_counts(events: DataFrame, layout: Layout = PATIENTS) -> DataFrame:
    """Events per entity and type, missing types skipped, most frequent first."""
    return _type_counts(events, layout).orderBy(layout.entity, F.desc("count"), layout.event_type)


def _type_counts(events: DataFrame, layout: Layout) -> DataFrame:
    if layout.event_type not in events.columns:
        events = events.withColumn(layout.event_type, F.lit(None).cast("string"))
    return (
        events.where(F.col(layout.entity).isNotNull() & F.col(layout.event_type).isNotNull())
        .groupBy(layout.entity, layout.event_type)
        .agg(F.count(F.lit(1)).alias("count"))
    )


def event_type_ranks(events: DataFrame, layout: Layout = PATIENTS) -> DataFrame:
    """Events per entity and type with the place of each type, 1 for the most frequent; ties go by name.

    The order is in the rows, so it outlives shuffles and files.
    """
    order = Window.partitionBy(layout.entity).orderBy(F.desc("count"), layout.event_type)
    return _type_counts(events, layout).withColumn("rank", F.row_number().over(order))


def event_type_map(events: DataFrame, layout: Layout = PATIENTS) -> DataFrame:
    """One row per entity with events of known type: a map of type to count, most frequent first."""
    ordered = Window.partitionBy(layout.entity).orderBy(F.desc("count"), layout.event_type)
    entry = F.struct(F.col(layout.event_type), F.col("count"))
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    listed = _type_counts(events, layout).select(
        layout.entity, F.collect_list(entry).over(whole).alias("_entries"), F.row_number().over(ordered).alias("_rank")
    )
    return listed.where(F.col("_rank") == 1).select(layout.entity, F.map_from_entries("_entries").alias("type_counts"))


def patient_summary(
    readings: DataFrame, events: DataFrame, layout: Layout = PATIENTS
) -> DataFrame:
    """Rows, first and last time and number of events for every entity that has readings."""
    key = layout.entity
    rows = readings.where(F.col(key).isNotNull()).select(
        key, F.col(layout.time).alias("_at"), F.lit(1).alias("_row"), F.lit(0).alias("_event")
    )
    happened = events.where(F.col(key).isNotNull()).select(
        key, F.lit(0).alias("_row"), F.lit(1).alias("_event")
    )
    return (
        rows.unionByName(happened, allowMissingColumns=True)
        .groupBy(key)
        .agg(
            F.sum("_row").alias("total_records"),
            F.min("_at").alias("first_time"),
            F.max("_at").alias("last_time"),
            F.sum("_event").alias("event_count"),
        )
        .where(F.col("total_records") > 0)
    )


def dataset_totals(readings: DataFrame, events: DataFrame, layout: Layout = PATIENTS) -> DataFrame:
    """One row: reading rows, events and distinct entities with readings."""
    per_entity = (
        readings.select(layout.entity, F.lit(1).alias("_row"), F.lit(0).alias("_event"))
        .unionByName(events.select(layout.entity, F.lit(0).alias("_row"), F.lit(1).alias("_event")))
        .groupBy(layout.entity)
        .agg(F.sum("_row").alias("_rows"), F.sum("_event").alias("_events"))
    )
    with_rows = F.col(layout.entity).isNotNull() & (F.col("_rows") > 0)
    return per_entity.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("reading_rows"),
        F.coalesce(F.sum("_events"), F.lit(0)).alias("events"),
        F.count_if(with_rows).alias("patients"),
    )


def _shown(value: Column, digits: int) -> Column:
    """Rounded for display. Nine digits first, so the order values were added in cannot tip a tie."""
    return F.round(F.round(value, 9), digits)


def summary_cards(
    readings: DataFrame,
    events: DataFrame,
    start=None,
    end=None,
    signals=None,
    layout: Layout = PATIENTS,
) -> DataFrame:
    """Rounded mean, min and max per signal next to the entity's event total and daily rate.

    An entity with readings or events has a card for each signal; without readings only its events are on it.
    """
    key = layout.entity
    # Entities that only have events join the readings as rows without a value.
    axis = events.select(key, ntz("1970-01-01 00:00:00").alias(layout.time))
    stats = signal_stats(readings.unionByName(axis, allowMissingColumns=True), signals, layout=layout)
    rates = event_rates(events, start, end, layout=layout)
    return stats.join(rates, key, "left").select(
        key,
        "signal",
        *(_shown(F.col(name), 1).alias(name) for name in ("mean", "min", "max")),
        F.coalesce("total_count", F.lit(0).cast("bigint")).alias("total_count"),
        _shown(F.coalesce("per_day", F.lit(0.0)), 2).alias("per_day"),
    )
