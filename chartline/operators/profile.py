"""How signals are sampled and how they are distributed, per entity and signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartline.functions.text import interval_label
from chartline.functions.times import seconds_between, time_bin
from chartline.layout import PATIENTS, Layout
from chartline.operators.quantiles import group_quantiles
from chartline.operators.select import known, readings_long

NO_INTERVAL = "Insufficient data"


def per_signal(
    readings: DataFrame, measures: dict, signals=None, layout: Layout = PATIENTS, by: tuple[str, ...] = ()
) -> DataFrame:
    """One row per entity and signal with ``measures`` (name to a function of the signal's name).

    All signals are aggregated in one pass over the wide rows; only the result is turned long, so a
    signal without any value keeps its row. ``by`` names further columns to group by.
    """
    present = layout.present(readings, signals)
    wide = readings.groupBy(layout.entity, *by).agg(
        *(
            F.struct(*(measure(s).alias(name) for name, measure in measures.items())).alias(s)
            for s in present
        )
    )
    entries = F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).alias("m")) for s in present))
    return wide.select(layout.entity, *by, F.explode(entries).alias("_e")).select(
        layout.entity, *by, "_e.signal", "_e.m.*"
    )


def _at(signal: str, layout: Layout) -> Column:
    return F.when(F.col(signal).isNotNull(), F.col(layout.time))


def _chunk_extents(readings: DataFrame, signals, layout: Layout, chunk_seconds: int) -> DataFrame:
    """Count, first and last time per entity, signal and time chunk; a signal without values has count 0."""
    rows = known(readings, layout).withColumn("_chunk", time_bin(F.col(layout.time), chunk_seconds))
    return per_signal(
        rows,
        {
            "_count": F.count,
            "_first": lambda s: F.min(_at(s, layout)),
            "_final": lambda s: F.max(_at(s, layout)),
        },
        signals, layout, ("_chunk",),
    )


def reading_gaps(
    readings: DataFrame, signals=None, layout: Layout = PATIENTS, chunk_seconds: int = 3600
) -> DataFrame:
    """Seconds from each non-null reading back to the previous one of the same entity and signal.

    Gaps are taken inside time chunks, and across chunks from one summary row per chunk, so no task
    has to order a whole series.
    """
    keys = [layout.entity, "signal"]
    when = F.col(layout.time)
    long = (
        readings_long(known(readings, layout), signals, layout)
        .select(*keys, when)
        .withColumn("_chunk", time_bin(when, chunk_seconds))
    )
    previous = F.lag(layout.time).over(Window.partitionBy(*keys, "_chunk").orderBy(layout.time))
    inside = long.select(*keys, when, previous.alias("_previous"))
    edges = _chunk_extents(readings, signals, layout, chunk_seconds).where(F.col("_count") > 0)
    before = F.lag("_final").over(Window.partitionBy(*keys).orderBy("_chunk"))
    across = edges.select(*keys, F.col("_first").alias(layout.time), before.alias("_previous"))
    return (
        inside.unionByName(across)
        .where(F.col("_previous").isNotNull())
        .select(*keys, layout.time, seconds_between(F.col("_previous"), when).alias("gap_seconds"))
    )


def sampling_profile(
    readings: DataFrame, signals=None, approx: bool = False, layout: Layout = PATIENTS, chunk_seconds: int = 3600
) -> DataFrame:
    """Median interval, its label, reading count and coverage percent per entity and signal.

    Coverage compares the count with the span divided by the median interval, capped at 100. With
    fewer than two readings there is no interval and coverage is 0. Counts and spans are summed from
    the chunk summaries that the gaps need anyway, so both come from one scan and shuffle.
    """
    keys = [layout.entity, "signal"]
    counts = _chunk_extents(readings, signals, layout, chunk_seconds).groupBy(*keys).agg(
        F.sum("_count").alias("count"), F.min("_first").alias("_first"), F.max("_final").alias("_final"),
    )
    medians = group_quantiles(
        reading_gaps(readings, signals, layout, chunk_seconds), keys, "gap_seconds",
        {"median_interval_seconds": 0.5}, approx,
    )
    median = F.col("median_interval_seconds")
    span = seconds_between(F.col("_first"), F.col("_final"))
    coverage = F.when(
        (median > 0) & (span > 0), F.least(F.lit(100.0), F.col("count") / (span / median) * 100)
    ).otherwise(F.lit(0.0))
    return counts.join(medians, keys, "left").select(
        *keys,
        median,
        F.coalesce(interval_label(median), F.lit(NO_INTERVAL)).alias("frequency_label"),
        "count",
        coverage.alias("coverage_pct"),
    )


def signal_stats(
    readings: DataFrame, signals=None, approx: bool = False, layout: Layout = PATIENTS
) -> DataFrame:
    """Min, max, mean, median, sample deviation and count per entity and signal.

    A signal without values has count 0 and nulls; with one value its deviation is 0.
    """
    keys = [layout.entity, "signal"]
    rows = known(readings, layout)
    basic = per_signal(
        rows,
        {
            "min": F.min,
            "max": F.max,
            "mean": F.avg,
            "std": lambda s: F.coalesce(F.stddev_samp(s), F.when(F.count(s) == 1, F.lit(0.0))),
            "count": F.count,
        },
        signals, layout,
    )
    medians = group_quantiles(
        readings_long(rows, signals, layout), keys, "value", {"median": 0.5}, approx
    )
    return basic.join(medians, keys, "left").select(
        *keys, "min", "max", "mean", "median", "std", "count"
    )


def signal_coverage(readings: DataFrame, signals=None, layout: Layout = PATIENTS) -> DataFrame:
    """Count, first and last time per entity and signal, for signals with at least one value."""

    return per_signal(
        known(readings, layout),
        {
            "count": F.count,
            "first_time": lambda s: F.min(_at(s, layout)),
            "last_time": lambda s: F.max(_at(s, layout)),
        },
        signals, layout,
    ).where(F.col("count") > 0)
