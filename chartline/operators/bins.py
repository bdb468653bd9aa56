"""Time bins: dense grids, resampling with bands and forward fill, adaptive widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartline.functions.times import (
    GRANULARITY_SECONDS,
    MICROS,
    add_micros,
    day_start,
    divides_day,
    epoch_micros,
    floor_micros,
    micros_between,
    ntz,
    seconds_between,
    time_bin,
    width_seconds,
)
from chartline.layout import PATIENTS, Layout
from chartline.operators.quantiles import group_quantiles, quantile_parts
from chartline.operators.select import known, turned_long
from chartline.sizing import task_count

# Readings above which the raw report warns, and points aimed at by auto mode.
MAX_RAW_POINTS = 200_000
DOWNSAMPLE_TARGET = 10_000
# Auto mode takes the width in the second place while span / target is below the first.
AUTO_LADDER = ((60, "1s"), (300, "1min"), (900, "5min"), (3600, "15min"), (21_600, "1h"), (86_400, "6h"))
AUTO_WIDEST = "1D"
AUTO_NO_SPAN = "1min"

BAND = {"p10": 0.1, "p90": 0.9}

# Bins generated by one task step, and bins per forward-fill chunk.
GRID_BLOCK = 4096
# Bins whose rows are told by the bits of one whole number.
WORD = 64


def bin_grid(
    spans: DataFrame, keys: list[str], start: str, end: str, width_micros: Column, out: str
) -> DataFrame:
    """Every bin from ``start`` up to the last one beginning at or before ``end``, per row of ``spans``.

    Bins are laid out in blocks that are spread over tasks before they are filled in, so one entity
    with a very long span is not generated by a single task.
    """
    width = F.col("_width")
    last_bin = F.call_function(
        "div", floor_micros(micros_between(F.col("_from"), F.col(end)), width), width
    )
    block = F.lit(GRID_BLOCK).cast("bigint")
    blocks = (
        spans.select(*keys, F.col(start).alias("_from"), end, width_micros.cast("bigint").alias("_width"))
        .where(F.col("_from") <= F.col(end))
        .select(*keys, "_from", "_width", last_bin.alias("_last"))
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.call_function("div", F.col("_last"), block))))
        .repartition(task_count(spans), *keys, "_block")
    )
    first = F.col("_block") * block
    index = F.explode(F.sequence(first, F.least(first + block - 1, F.col("_last"))))
    return blocks.select(*keys, "_from", "_width", index.alias("_index")).select(
        *keys, add_micros(F.col("_from"), F.col("_index") * width).alias(out)
    )


def empty_bins(held: DataFrame, spans: DataFrame, key: str, out: str) -> DataFrame:
    """The bins between the first and the last one of an entity that hold none of the rows ``held``.

    ``held`` has the key and ``_index``, a bin's number from ``_origin``; ``spans`` has ``_first``, ``_final``, ``_origin`` and
    ``_width`` per entity, and covers all that is held. Which bins have rows is one bit each of a number per run of 64 bins.
    Only these runs are shuffled and kept by a task; bins without rows are laid out behind that and hashed nowhere.
    """
    size = F.lit(WORD).cast("bigint")
    bit = F.expr(f"shiftleft(1L, cast(pmod(_index, {WORD}) AS int))")
    bits = held.groupBy(key, _div(F.col("_index"), WORD).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    inside = _div(F.col("_block") * GRID_BLOCK, WORD)
    words = F.sequence(F.greatest(inside, _div(F.col("_low"), WORD)), F.least(inside + (GRID_BLOCK // WORD - 1), _div(F.col("_high"), WORD)))
    runs = _numbered_blocks(spans, key).withColumn("_word", F.explode(words)).select(
        key, "_word", "_origin", "_width",
        F.greatest("_low", F.col("_word") * size).alias("_from"), F.least("_high", F.col("_word") * size + (WORD - 1)).alias("_to"),
    )
    # Runs are few, so re-planning would deal them to few tasks; a fixed number keeps their bins spread.
    met = runs.unionByName(bits, allowMissingColumns=True).repartition(task_count(spans), key, "_word").groupBy(key, "_word").agg(
        F.coalesce(F.bit_or("_bits"), F.lit(0).cast("bigint")).alias("_bits"), *(F.max(c).alias(c) for c in ("_from", "_to", "_origin", "_width")),
    )
    laid = met.select(key, "_bits", "_origin", "_width", F.explode(F.sequence("_from", "_to")).alias("_index"))
    return laid.where(f"bit_get(_bits, cast(pmod(_index, {WORD}) AS int)) = 0").select(
        key, add_micros(F.col("_origin"), F.col("_index") * F.col("_width")).alias(out)
    )


def auto_width(span_seconds: Column) -> Column:
    """Bin width in seconds for a span, by the ladder. The widths are not a cap on the point count."""
    target = span_seconds / DOWNSAMPLE_TARGET
    width = F.when(span_seconds == 0, F.lit(GRANULARITY_SECONDS[AUTO_NO_SPAN]))
    for below, name in AUTO_LADDER:
        width = width.when(target < below, F.lit(GRANULARITY_SECONDS[name]))
    return width.otherwise(F.lit(GRANULARITY_SECONDS[AUTO_WIDEST])).cast("bigint")


def _spans(readings: DataFrame, signals: list[str], layout: Layout) -> DataFrame:
    points = sum((F.count(s) for s in signals), F.lit(0).cast("bigint"))
    return readings.groupBy(layout.entity).agg(
        F.min(layout.time).alias("_first"),
        F.max(layout.time).alias("_final"),
        points.alias("_points"),
    )


def auto_granularity(readings: DataFrame, layout: Layout = PATIENTS) -> DataFrame:
    """Per entity: covered span in seconds and the bin width auto mode picks for it."""
    spans = _spans(known(readings, layout), [], layout)
    span = seconds_between(F.col("_first"), F.col("_final"))
    return spans.select(
        layout.entity, span.alias("span_seconds"), auto_width(span).alias("width_seconds")
    )


def raw_guard(
    readings: DataFrame, signals=None, limit: int = MAX_RAW_POINTS, layout: Layout = PATIENTS
) -> DataFrame:
    """Per entity: number of non-null readings and whether they are over the limit.

    A report only: raw output returns every row whatever it says; the caller chooses raw or auto by it.
    """
    spans = _spans(known(readings, layout), layout.present(readings, signals), layout)
    return spans.select(
        layout.entity, F.col("_points").alias("points"), (F.col("_points") > limit).alias("over_limit")
    )


def resample(
    readings: DataFrame,
    granularity: str = "auto",
    aggregation: str = "mean",
    show_band: bool = False,
    ffill: bool = False,
    signals=None,
    dense: bool = True,
    approx: bool = False,
    layout: Layout = PATIENTS,
) -> DataFrame:
    """Readings brought to regular time bins, per entity.

    ``granularity`` is ``raw``, ``auto`` or a width such as ``5min``; ``aggregation`` is ``mean`` or
    ``median``. Bins are closed on the left, labelled by their start and counted from midnight of the
    entity's first day. Every bin between the first and last row is returned unless ``dense`` is off,
    and empty ones are null or, with ``ffill``, carry the last value. ``show_band`` adds the 10th and
    90th percentile per signal. Raw output is every row as it is, without bands, at any size.
    ``approx`` answers medians and bands from a bounded sketch.
    """
    if aggregation not in ("mean", "median"):
        raise ValueError(f"unknown aggregation {aggregation!r}: use mean or median")
    signals = layout.present(readings, signals)
    if not signals:
        return readings
    rows = known(readings, layout).select(layout.entity, layout.time, *signals)
    options = (signals, aggregation, show_band, ffill, dense, approx, layout)

    if granularity == "raw":
        return rows

    if granularity == "auto":
        spans = _spans(rows, [], layout)
        width = auto_width(seconds_between(F.col("_first"), F.col("_final")))
        return _resample_varying(rows, spans, width, *options)

    seconds = width_seconds(granularity)
    if not divides_day(seconds):
        spans = _spans(rows, [], layout)
        return _resample_varying(rows, spans, F.lit(seconds).cast("bigint"), *options)

    # Widths that divide a day need nothing from other rows: midnight bins are the same for all.
    binned = rows.withColumn("_bin", time_bin(F.col(layout.time), seconds))
    width = F.lit(seconds * MICROS).cast("bigint")
    spans = _spans(rows, [], layout).select(layout.entity, "_first", "_final", ntz("1970-01-01 00:00:00").alias("_origin"), width.alias("_width"))
    return _aggregate(binned.withColumn("_index", _index_of(epoch_micros(F.col("_bin")), width)), spans, *options)


def _index_of(micros: Column, width: Column) -> Column:
    """The number of the bin at a distance to the origin of all bins."""
    return F.call_function("div", floor_micros(micros, width), width)


def _resample_varying(rows, spans, width: Column, *options) -> DataFrame:
    """Resample with a start and width of its own for each entity.

    Rows meet their entity's width per day, so a large entity is dealt out over its days; the aggregate
    behind the join is keyed by bin and deals the rows out again.
    """
    layout = options[-1]
    plans = spans.select(
        layout.entity, "_first", "_final", (width * MICROS).alias("_width"),
        day_start(F.col("_first")).alias("_origin"),
    )
    offset = floor_micros(micros_between(F.col("_origin"), F.col(layout.time)), F.col("_width"))
    days = F.sequence(F.to_date("_first"), F.to_date("_final"))
    daily = plans.select(layout.entity, "_origin", "_width", F.explode(days).alias("_day"))
    binned = (
        rows.withColumn("_day", F.to_date(layout.time)).join(daily, [layout.entity, "_day"])
        .withColumn("_offset", offset).withColumns({
            "_bin": add_micros(F.col("_origin"), F.col("_offset")), "_index": _index_of(F.col("_offset"), F.col("_width")),
        }).drop("_day", "_offset")
    )
    return _aggregate(binned, plans, *options)


def _aggregate(binned, spans, signals, aggregation, show_band, ffill, dense, approx, layout) -> DataFrame:
    """Aggregate binned rows. Bins without rows are laid out beside or behind that, without a join."""
    keys = [layout.entity, "_bin"]
    quantiles = {"median": 0.5} if aggregation == "median" else {}
    if show_band:
        quantiles |= BAND
    main = "median" if aggregation == "median" else "mean"

    if not quantiles:
        out = binned.groupBy(*keys).agg(*(F.avg(s).alias(s) for s in signals))
        if dense:
            out = out.unionByName(empty_bins(binned.select(layout.entity, "_index"), spans, layout.entity, "_bin"), allowMissingColumns=True)
        out = out.withColumnRenamed("_bin", layout.time)
        return forward_fill(out, signals, layout) if ffill else out

    mean = None if aggregation == "median" else "mean"
    names = {s: main for s in signals} | {f"{s}_{q}": q for s in signals for q in quantiles if show_band and q != "median"}

    def of(column: str) -> Column:
        """The sum of what the rows of a signal hold, in the column of a quantile or, alike in all rows, the mean."""
        signal = column if column in signals else column.rsplit("_", 1)[0]
        held = F.when(F.col("signal") == signal, F.col(names[column]))
        return (F.max(held) if names[column] == mean else F.sum(held)).alias(column)

    key, blocked = layout.entity, [layout.entity, "_block", "_bin"]
    binned = binned.withColumn("_block", _div(F.col("_index"), GRID_BLOCK))
    long = turned_long(binned, blocked, signals)
    if approx:
        spread = group_quantiles(long, [*blocked, "signal"], "value", quantiles, True, mean)
    else:
        spread = quantile_parts(long.withColumnRenamed("value", "_value"), [*blocked, "signal"], quantiles, mean)
    if dense:
        # Rows and the blocks of the grid are dealt out by block together; bins are laid out, and filled, behind it.
        blocks = _grid_blocks(spans, key)
        dealt = spread.unionByName(blocks, allowMissingColumns=True).repartition(key, "_block")
        each = F.expr("CASE WHEN _from IS NULL THEN array(_bin) ELSE sequence(_from, _to, make_dt_interval(0, 0, 0, _width / 1000000)) END")
        laid = dealt.select(key, "_block", F.explode(each).alias("_bin"), "signal", *quantiles, *([mean] if mean else []))
    else:
        # Bins whose rows hold no value still belong to a result without a grid.
        laid = spread.unionByName(binned.select(*blocked), allowMissingColumns=True)
    out = laid.groupBy(*blocked).agg(*(of(c) for c in names)).withColumnRenamed("_bin", layout.time)
    if ffill and dense:
        out = _filled(out, [key, "_block"], list(names), layout)
    out = out.select(key, layout.time, *names)
    return forward_fill(out, list(names), layout) if ffill and not dense else out


def _numbered_blocks(spans: DataFrame, key: str) -> DataFrame:
    """One row per block of bins of each entity, with the numbers of the entity's first and last bin."""
    width = F.col("_width")
    low, high = (_index_of(micros_between(F.col("_origin"), F.col(time)), width).alias(name) for time, name in (("_first", "_low"), ("_final", "_high")))
    numbered = spans.where(F.col("_first") <= F.col("_final")).select(key, "_origin", "_width", low, high)
    return numbered.withColumn("_block", F.explode(F.sequence(_div(F.col("_low"), GRID_BLOCK), _div(F.col("_high"), GRID_BLOCK))))


def _grid_blocks(spans: DataFrame, key: str) -> DataFrame:
    """The blocks of bins of each entity: _from and _to, the first and last bin of the block that it covers, and _width."""
    low, high = F.col("_block") * GRID_BLOCK, F.col("_block") * GRID_BLOCK + (GRID_BLOCK - 1)
    return _numbered_blocks(spans, key).select(
        key, "_block", "_width",
        add_micros(F.col("_origin"), F.greatest("_low", low) * F.col("_width")).alias("_from"),
        add_micros(F.col("_origin"), F.least("_high", high) * F.col("_width")).alias("_to"),
    )


def _div(index: Column, size: int) -> Column:
    """Which run of ``size`` bins a bin is in."""
    return F.call_function("div", index - F.pmod(index, F.lit(size).cast("bigint")), F.lit(size).cast("bigint"))


def forward_fill(
    df: DataFrame, columns: list[str], layout: Layout = PATIENTS, chunk_seconds: int = 86_400
) -> DataFrame:
    """Replace nulls by the last value before them, per entity and without limit.

    Each entity is cut into time chunks, which are dealt out once. Values run forward inside a chunk; what
    enters a chunk comes from one summary row per earlier chunk. So a long series is filled by many tasks.
    """
    chunk = [layout.entity, "_chunk"]
    dealt = df.withColumn("_chunk", time_bin(F.col(layout.time), chunk_seconds)).repartition(*chunk)
    return _filled(dealt, chunk, columns, layout).select(*df.columns)


def _filled(dealt: DataFrame, chunk: list[str], columns: list[str], layout: Layout) -> DataFrame:
    """The same for rows that are dealt out by chunk already: their summary and their order need no further exchange."""
    last = ", ".join(f"`{c}`" for c in chunk)
    summaries = dealt.groupBy(*chunk).agg(
        *(F.expr(f"max_by(`{c}`, CASE WHEN `{c}` IS NOT NULL THEN `{layout.time}` END) AS `{c}`") for c in columns)
    )
    earlier = f"PARTITION BY `{chunk[0]}` ORDER BY `{chunk[1]}` ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    entering = summaries.selectExpr(*(f"`{c}`" for c in chunk), *(f"last(`{c}`, true) OVER ({earlier}) AS `_before_{c}`" for c in columns))
    inside = f"PARTITION BY {last} ORDER BY `{layout.time}` ROWS UNBOUNDED PRECEDING"
    others = [f"`{c}`" for c in dealt.columns if c not in columns]
    filled = dealt.selectExpr(*others, *(f"last(`{c}`, true) OVER ({inside}) AS `{c}`" for c in columns))
    return filled.join(entering, chunk, "left").selectExpr(*others, *(f"coalesce(`{c}`, `_before_{c}`) AS `{c}`" for c in columns))
