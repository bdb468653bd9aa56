"""What the signals were doing in a time window around each event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartline.functions.text import context_title, with_unit
from chartline.functions.times import MICROS, add_micros, seconds_between, time_bin
from chartline.layout import PATIENTS, SIGNAL_METADATA, Layout
from chartline.operators.select import known
from chartline.sizing import rows_in

STATS = ("mean", "min", "max", "count")


def event_moments(events: DataFrame, layout: Layout = PATIENTS) -> DataFrame:
    """Distinct entity and event time; events that share both share their context."""
    return (
        events.select(layout.entity, layout.event_time_of(events).alias("event_time"))
        .where(F.col(layout.entity).isNotNull() & F.col("event_time").isNotNull())
        .distinct()
    )


# How the parts of a window are put together: aggregate names and the function that merges them.
_MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
_TAKE = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def _parts(functions: dict, columns: dict[str, str], window=None) -> Column:
    """Struct of the four aggregates; ``columns`` names the input of each."""
    taken = {name: f(columns[name]) for name, f in functions.items()}
    return F.struct(
        *((c if window is None else c.over(window)).alias(name) for name, c in taken.items())
    )


def _joined(a: Column, b: Column) -> Column:
    """The four aggregates of two parts of one window; least and greatest pass over nulls."""
    zero = F.lit(0)
    return F.struct(
        (F.coalesce(a["sum"], zero) + F.coalesce(b["sum"], zero)).alias("sum"),
        (F.coalesce(a["count"], zero) + F.coalesce(b["count"], zero)).alias("count"),
        F.least(a["min"], b["min"]).alias("min"),
        F.greatest(a["max"], b["max"]).alias("max"),
    )


def context_wide(
    readings: DataFrame,
    events: DataFrame,
    window_minutes: float = 5,
    signals=None,
    layout: Layout = PATIENTS,
    chunk_seconds: int = 3600,
) -> DataFrame:
    """Mean, min, max and count of each signal within the closed window around each event moment.

    Time is cut into cells as wide as the window, so a window always ends in the cell after the one
    it starts in. What it covers is then the tail of one cell and the head of the next, and both are
    running aggregates over the cell's readings. Cost grows with readings plus events: no reading is
    ever paired with each event near it. Cells wider than ``chunk_seconds`` are cut into chunks that
    are run through separately, and what the chunks before or after add comes from one row per chunk.
    """
    key = layout.entity
    signals = layout.present(readings, signals)
    half = round(window_minutes * 60 * MICROS)
    if half <= 0:
        raise ValueError("window_minutes must be positive")
    cell, chunk = [key, "_cell"], [key, "_cell", "_chunk"]
    moment = F.col("event_time")
    ends = F.array(
        F.struct(F.lit(False).alias("head"), add_micros(moment, -half).alias("at")),
        F.struct(F.lit(True).alias("head"), add_micros(moment, half).alias("at")),
    )
    cell_seconds = 2 * half / MICROS
    probes = (
        event_moments(events, layout)
        .select(key, "event_time", F.explode(ends).alias("_end"))
        .select(
            key, "event_time", F.col("_end.at").alias("_at"), F.col("_end.head").alias("_head"),
            F.lit(1).alias("_probe"), time_bin(F.col("_end.at"), cell_seconds).alias("_cell"),
        )
    )
    # Only cells that some window touches matter; the rest of the readings go no further.
    points = known(readings, layout).select(
        key, F.col(layout.time).alias("_at"), *signals,
        F.lit(0).alias("_probe"), time_bin(F.col(layout.time), cell_seconds).alias("_cell"),
    )
    near = rows_in(points, probes, cell)
    line = near.unionByName(probes, allowMissingColumns=True)
    chunked = 2 * half > chunk_seconds * MICROS
    if chunked:
        line = line.withColumn("_chunk", time_bin(F.col("_at"), chunk_seconds))
    group = chunk if chunked else cell

    # Readings at the very edge belong to the window, so they come before the probe both ways.
    upto = Window.unboundedPreceding, 0
    head = Window.partitionBy(*group).orderBy(F.asc("_at"), "_probe").rowsBetween(*upto)
    tail = Window.partitionBy(*group).orderBy(F.desc("_at"), "_probe").rowsBetween(*upto)

    def side(prefix: str, s: str) -> Column:
        return F.when(F.col("_head"), F.col(f"_head{prefix}_{s}")).otherwise(F.col(f"_tail{prefix}_{s}"))

    parts = line.select(
        *group, "event_time", "_head", "_probe",
        *(_parts(_TAKE, dict.fromkeys(_TAKE, s), head).alias(f"_head_{s}") for s in signals),
        *(_parts(_TAKE, dict.fromkeys(_TAKE, s), tail).alias(f"_tail_{s}") for s in signals),
    ).where(F.col("_probe") == 1)
    if chunked:
        sums = line.groupBy(*chunk).agg(
            F.max("_probe").alias("_probe"),
            *(_parts(_TAKE, dict.fromkeys(_TAKE, s)).alias(s) for s in signals),
        )
        others = Window.unboundedPreceding, -1
        before = Window.partitionBy(*cell).orderBy("_chunk").rowsBetween(*others)
        after = Window.partitionBy(*cell).orderBy(F.desc("_chunk")).rowsBetween(*others)
        fields = {s: {name: f"{s}.{name}" for name in _MERGE} for s in signals}
        entering = sums.select(
            *chunk, "_probe",
            *(_parts(_MERGE, fields[s], before).alias(f"_head_chunks_{s}") for s in signals),
            *(_parts(_MERGE, fields[s], after).alias(f"_tail_chunks_{s}") for s in signals),
        ).where(F.col("_probe") == 1).drop("_probe")
        pieces = parts.join(entering, chunk).select(
            key, "event_time", *(_joined(side("", s), side("_chunks", s)).alias(s) for s in signals)
        )
    else:
        pieces = parts.select(key, "event_time", *(side("", s).alias(s) for s in signals))

    totals = pieces.groupBy(key, "event_time").agg(
        *(_parts(_MERGE, {name: f"{s}.{name}" for name in _MERGE}).alias(s) for s in signals)
    )
    columns = []
    for s in signals:
        # try_divide: an empty window has no mean.
        columns += [
            F.try_divide(F.col(f"{s}.sum"), F.col(f"{s}.count")).alias(f"{s}_mean"),
            F.col(f"{s}.min").alias(f"{s}_min"),
            F.col(f"{s}.max").alias(f"{s}_max"),
            F.col(f"{s}.count").alias(f"{s}_count"),
        ]
    return totals.select(key, "event_time", *columns)


def event_context(
    readings: DataFrame,
    events: DataFrame,
    window_minutes: float = 5,
    signals=None,
    layout: Layout = PATIENTS,
) -> DataFrame:
    """One row per event moment and signal: mean, min, max and count in the window around it.

    A signal without readings in the window has count 0 and nulls.
    """
    signals = layout.present(readings, signals)
    wide = context_wide(readings, events, window_minutes, signals, layout)
    entries = F.array(
        *(
            F.struct(F.lit(s).alias("signal"), *(F.col(f"{s}_{stat}").alias(stat) for stat in STATS))
            for s in signals
        )
    )
    return wide.select(layout.entity, "event_time", F.explode(entries).alias("_e")).select(
        layout.entity, "event_time", "_e.*"
    )


def event_table(
    events: DataFrame,
    readings: DataFrame,
    window_minutes: float = 5,
    layout: Layout = PATIENTS,
) -> DataFrame:
    """Every event with its end, duration, type, severity and the mean of each signal around it.

    The duration is end minus start, cut to whole seconds, when there is an end, else the event's own
    duration. Columns are fixed; what an event lacks is null. All other event columns are kept.
    """
    def given(name: str, kind: str) -> Column:
        return F.col(name) if name in events.columns else F.lit(None).cast(kind)

    signals = layout.present(readings)
    context = context_wide(readings, events, window_minutes, signals, layout).select(
        layout.entity, "event_time", *(f"{s}_mean" for s in signals)
    )
    end = given(layout.event_end, "timestamp_ntz")
    start = given(layout.event_start, "timestamp_ntz")
    named = (layout.event_time, layout.event_start, layout.event_end, layout.event_type,
             layout.severity, layout.duration, layout.interval_flag)
    rows = events.select(
        *(c for c in events.columns if c not in named),
        layout.event_time_of(events).alias("event_time"),
        end.alias("end_time"),
        F.when(end.isNotNull(), seconds_between(start, end).cast("bigint"))
        .otherwise(given(layout.duration, "int").cast("bigint"))
        .alias("duration_s"),
        given(layout.event_type, "string").alias("type"),
        given(layout.severity, "string").alias("severity"),
    )
    return rows.join(context, [layout.entity, "event_time"], "left")


def display_event_table(
    table: DataFrame, window_minutes: int = 5, layout: Layout = PATIENTS
) -> DataFrame:
    """The event table with reader-friendly titles and one-decimal text with units."""
    cells = []
    for s in layout.signals:
        if f"{s}_mean" in table.columns:
            meta = SIGNAL_METADATA.get(s, {"name": s, "unit": ""})
            cells.append(
                with_unit(F.col(f"{s}_mean"), meta["unit"]).alias(context_title(meta["name"], window_minutes))
            )
    return table.select(
        F.col(layout.entity),
        F.col("event_time").alias("Event Time"),
        F.col("end_time").alias("End Time"),
        F.col("duration_s").alias("Duration (s)"),
        F.col("type").alias("Type"),
        F.col("severity").alias("Severity"),
        *cells,
    )
