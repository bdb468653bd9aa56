"""Event counts per time bin on a full, zero-filled axis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartline.functions.times import DENSITY_BIN_SECONDS, MICROS, epoch_micros, floor_micros, ntz, time_bin
from chartline.layout import PATIENTS, Layout
from chartline.operators.bins import empty_bins


def event_density(
    events: DataFrame,
    bin_size: str = "hour",
    start=None,
    end=None,
    patients: DataFrame | None = None,
    layout: Layout = PATIENTS,
) -> DataFrame:
    """Events per hour or day bin and entity, with zeros for empty bins.

    With ``start`` and ``end`` the axis covers that range for every entity of ``patients`` (default:
    those with events); events outside it, or of other entities, drop. Otherwise it runs from an entity's first event to
    its last. The axis starts at the bin that holds the start.
    """
    if bin_size not in DENSITY_BIN_SECONDS:
        raise ValueError(f"unknown bin {bin_size!r}: use hour or day")
    seconds = DENSITY_BIN_SECONDS[bin_size]
    key = layout.entity
    happened = events.select(key, layout.event_time_of(events).alias("_at")).where(
        F.col(key).isNotNull() & F.col("_at").isNotNull()
    )
    if start is not None:
        shown = (events if patients is None else patients).select(key).where(F.col(key).isNotNull())
        axis = shown.distinct().select(key, ntz(start).alias("_first"), ntz(end).alias("_final"))
        happened = happened.where(F.col("_at").between(ntz(start), ntz(end)))
        if patients is not None:
            happened = happened.join(shown.distinct(), key, "left_semi")
    else:
        axis = happened.groupBy(key).agg(F.min("_at").alias("_first"), F.max("_at").alias("_final"))
    width = F.lit(seconds * MICROS).cast("bigint")
    axis = axis.select(key, "_first", "_final", ntz("1970-01-01 00:00:00").alias("_origin"), width.alias("_width"))
    binned = happened.select(key, time_bin(F.col("_at"), seconds).alias("time_bin"))
    index = F.call_function("div", floor_micros(epoch_micros(F.col("time_bin")), width), width)
    empty = empty_bins(binned.select(key, index.alias("_index")), axis, key, "time_bin")
    counted = binned.groupBy(key, "time_bin").agg(F.count(F.lit(1)).alias("count"))
    return counted.unionByName(empty.withColumn("count", F.lit(0).cast("bigint"))).withColumn(
        "density_per_hour", F.col("count") / F.lit(seconds / 3600)
    )
