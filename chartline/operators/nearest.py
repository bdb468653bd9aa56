"""The reading closest in time to each event, on either side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartline.functions.times import MICROS, add_micros, micros_between, time_bin
from chartline.layout import PATIENTS, Layout
from chartline.operators.context import event_moments
from chartline.operators.select import known
from chartline.sizing import rows_in


def _nearest_wide(
    readings: DataFrame, events: DataFrame, signals: list[str], layout: Layout, chunk_seconds: int
) -> DataFrame:
    """Per event moment and signal a struct of time, value and distance of the nearest value.

    Each entity is cut into time chunks. Inside a chunk with events, running windows give the last
    value before and the first after each event. Where a chunk holds none, one summary row per chunk
    tells what came before and comes after it. Every task handles one chunk, never a whole series.
    """
    key = layout.entity
    chunk = [key, "_chunk"]
    probes = event_moments(events, layout).select(
        key, F.col("event_time").alias("_at"), F.lit(1).alias("_probe"),
        time_bin(F.col("event_time"), chunk_seconds).alias("_chunk"),
    ).where(F.col("_chunk").isNotNull())  # never null; said here, all uses below have one plan and share its shuffle
    points = known(readings, layout).select(
        key, F.col(layout.time).alias("_at"), *signals, time_bin(F.col(layout.time), chunk_seconds).alias("_chunk"),
    ).where(F.col("_chunk").isNotNull())
    # Readings are scanned once. In a chunk without events they end as one row before the shuffle, the row of no time:
    # the first and last value of each signal, and when. Elsewhere each time keeps a row.
    marked = points.join(probes.select(*chunk, F.lit(1).alias("_asked")).distinct(), chunk, "left")
    times = ", ".join(
        f"min(CASE WHEN `{s}` IS NOT NULL THEN _at END) AS `_first_at_{s}`, min_by(`{s}`, CASE WHEN `{s}` IS NOT NULL THEN _at END) AS `_first_{s}`, "
        f"max(CASE WHEN `{s}` IS NOT NULL THEN _at END) AS `_last_at_{s}`, max_by(`{s}`, CASE WHEN `{s}` IS NOT NULL THEN _at END) AS `_last_{s}`"
        for s in signals
    )
    kept = points.sparkSession.sql(f"""
        SELECT `{key}`, _chunk, _point AS _at, 0 AS _probe, {times}
        FROM (SELECT *, CASE WHEN _asked = 1 THEN _at END AS _point FROM {{marked}}) GROUP BY `{key}`, _chunk, _point
    """, marked=marked)
    line = kept.unionByName(probes, allowMissingColumns=True).repartition(*chunk)

    # What enters an event's chunk from either side, from one row per chunk.
    ends = [
        text for s in signals for text in (
            f"min(`_first_at_{s}`) AS `_first_at_{s}`", f"min_by(`_first_{s}`, `_first_at_{s}`) AS `_first_{s}`",
            f"max(`_last_at_{s}`) AS `_last_at_{s}`", f"max_by(`_last_{s}`, `_last_at_{s}`) AS `_last_{s}`",
        )
    ]
    earlier = f"PARTITION BY `{key}` ORDER BY _chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    later = f"PARTITION BY `{key}` ORDER BY _chunk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    # Only chunks with events have rows to put in order. There a row has one time, and its first value is its last.
    # Both uses of the line name the same columns, so that they share its exchange.
    back = f"PARTITION BY `{key}`, _chunk ORDER BY _at, _probe ROWS UNBOUNDED PRECEDING"
    ahead = f"PARTITION BY `{key}`, _chunk ORDER BY _at DESC, _probe ROWS UNBOUNDED PRECEDING"
    carried, near = [], []
    for s in signals:
        for name, source, window, out in (
            (f"_last_at_{s}", carried, earlier, f"_before_at_{s}"), (f"_last_{s}", carried, earlier, f"_before_{s}"),
            (f"_first_at_{s}", carried, later, f"_after_at_{s}"), (f"_first_{s}", carried, later, f"_after_{s}"),
            (f"_last_at_{s}", near, back, f"_back_at_{s}"), (f"_last_{s}", near, back, f"_back_{s}"),
            (f"_first_at_{s}", near, ahead, f"_ahead_at_{s}"), (f"_first_{s}", near, ahead, f"_ahead_{s}"),
        ):
            source.append(f"last(`{name}`, true) OVER ({window}) AS `{out}`")
    ended = line.groupBy(*chunk).agg(F.expr("max(CASE WHEN _at IS NOT NULL THEN _probe END) AS _asked"), *map(F.expr, ends))
    entering = ended.selectExpr(f"`{key}`", "_chunk", "_asked", *carried).where("_asked = 1").drop("_asked")
    local = line.selectExpr(f"`{key}`", "_chunk", "_at", "_probe", *near).where("_probe = 1").join(entering, chunk)

    columns = []
    for s in signals:
        before_at = F.coalesce(F.col(f"_back_at_{s}"), F.col(f"_before_at_{s}"))
        before = F.coalesce(F.col(f"_back_{s}"), F.col(f"_before_{s}"))
        after_at = F.coalesce(F.col(f"_ahead_at_{s}"), F.col(f"_after_at_{s}"))
        after = F.coalesce(F.col(f"_ahead_{s}"), F.col(f"_after_{s}"))
        gap_before = micros_between(before_at, F.col("_at"))
        gap_after = micros_between(F.col("_at"), after_at)
        # At equal distance the earlier reading wins.
        earlier_wins = after_at.isNull() | (gap_before <= gap_after)
        columns.append(
            F.struct(
                F.when(earlier_wins, before_at).otherwise(after_at).alias("nearest_time"),
                F.when(earlier_wins, before).otherwise(after).alias("value"),
                (F.when(earlier_wins, gap_before).otherwise(gap_after) / float(MICROS)).alias(
                    "distance_seconds"
                ),
            ).alias(s)
        )
    return local.select(key, F.col("_at").alias("event_time"), *columns)


def nearest_reading(
    readings: DataFrame,
    events: DataFrame,
    signals=None,
    layout: Layout = PATIENTS,
    chunk_seconds: int = 3600,
    order_by: str | None = None,
) -> DataFrame:
    """Nearest non-null reading of each signal to each event moment, at any distance.

    At equal distance the earlier reading is taken. A signal the entity never has gives nulls. The
    readings may be raw or resampled rows, one per entity and time; where several rows share both, ``order_by`` names
    the column by which the first value of a signal wins.
    """
    signals = layout.present(readings, signals)
    if order_by is not None:
        readings = known(readings, layout).groupBy(layout.entity, layout.time).agg(
            *(F.min_by(s, F.when(F.col(s).isNotNull(), F.col(order_by))).alias(s) for s in signals)
        )
    wide = _nearest_wide(readings, events, signals, layout, chunk_seconds)
    entries = F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).alias("near")) for s in signals))
    return wide.select(layout.entity, "event_time", F.explode(entries).alias("_e")).select(
        layout.entity, "event_time", "_e.signal", "_e.near.*"
    )


def flag_event_rows(
    readings: DataFrame,
    events: DataFrame,
    tolerance_seconds: float = 60,
    flag: str = "seizure",
    layout: Layout = PATIENTS,
) -> DataFrame:
    """Readings with 1 on the row nearest to an event, if strictly within the tolerance, else 0.

    Any row counts, even one without a single value.
    """
    keys = [layout.entity, layout.time]
    # Only chunks within reach of an event can hold a hit, so other rows are not looked at.
    chunk, chunk_seconds = [layout.entity, "_chunk"], max(3600, tolerance_seconds)
    reach = round(tolerance_seconds * MICROS)
    moment = F.col("event_time")
    reached = (
        event_moments(events, layout)
        .select(
            layout.entity,
            F.explode(F.array(add_micros(moment, -reach), moment, add_micros(moment, reach))).alias("_at"),
        )
        .withColumn("_chunk", time_bin(F.col("_at"), chunk_seconds))
    )
    present = known(readings, layout).select(*keys, F.lit(1).alias("_row"))
    near = rows_in(
        present.withColumn("_chunk", time_bin(F.col(layout.time), chunk_seconds)), reached, chunk
    )
    hits = (
        _nearest_wide(near, events, ["_row"], layout, chunk_seconds)
        .where(F.col("_row.distance_seconds") < tolerance_seconds)
        .select(layout.entity, F.col("_row.nearest_time").alias(layout.time))
        .distinct()
        .withColumn(flag, F.lit(1))
    )
    return readings.drop(flag).join(hits, keys, "left").withColumn(
        flag, F.coalesce(F.col(flag), F.lit(0))
    )
