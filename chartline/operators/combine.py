"""Putting feeds and tables together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartline.layout import PATIENTS, Layout


# Rows of one key above which the rows of its largest feed are spread over several tasks, for so many keys at most:
# these are the largest, so any other key holds at most one part in HOT_KEYS of all rows.
HOT_ROWS = 100_000
HOT_KEYS = 10_000


def combine_feeds(
    feeds: list[DataFrame], unique_keys: bool = False, layout: Layout = PATIENTS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Single-signal feeds joined into wide rows on entity and time, keeping every row of each feed.

    Rows that share entity and time multiply, as a full join does; a row without entity or time matches no other.
    All feeds go through one exchange: the rows of a key meet as one list per feed, and the lists are crossed. A key
    of more than ``hot_rows`` rows is dealt out: its largest feed in parts, the other feeds copied to each.
    When each feed has at most one row per entity and time, ``unique_keys=True`` gives the same rows without lists.
    """
    keys = [layout.entity, layout.time]
    if unique_keys:
        union = union_patients(feeds)
        signals = [c for c in union.columns if c not in keys]
        return union.groupBy(*keys).agg(*(F.max(s).alias(s) for s in signals))

    columns = [[c for c in feed.columns if c not in keys] for feed in feeds]
    rows = union_patients([
        feed.select(*keys, F.lit(i).alias("_feed"), F.struct(*columns[i]).alias(f"_row{i}") if columns[i] else F.struct(F.lit(1)).alias(f"_row{i}"))
        for i, feed in enumerate(feeds)
    ])
    full = rows.where(F.col(layout.entity).isNotNull() & F.col(layout.time).isNotNull())
    places = range(len(feeds))

    counts = full.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(F.col("_feed") == i).alias(f"_n{i}") for i in places))
    most = F.greatest(*(F.col(f"_n{i}") for i in places)) if len(feeds) > 1 else F.col("_n0")
    largest = F.coalesce(*(F.when(F.col(f"_n{i}") == most, F.lit(i)) for i in places))
    hot = (
        counts.where(F.col("_n") > hot_rows).orderBy(F.desc("_n")).limit(HOT_KEYS)
        .select(*keys, largest.alias("_largest"), F.ceil(most / hot_rows).cast("int").alias("_parts"))
    )
    part = F.pmod(F.monotonically_increasing_id(), F.col("_parts")).cast("int")
    parts = (
        F.when(F.col("_parts").isNull(), F.array(F.lit(0))).when(F.col("_feed") == F.col("_largest"), F.array(F.col("_part")))
        .otherwise(F.sequence(F.lit(0), F.col("_parts") - 1))
    )
    dealt = full.join(F.broadcast(hot), keys, "left").withColumn("_part", part).withColumn("_part", F.explode(parts))

    whole = Window.partitionBy(*keys, "_part")
    met = dealt.select(
        *keys, "_largest", F.row_number().over(whole.orderBy("_feed")).alias("_first"),
        *(F.collect_list(f"_row{i}").over(whole).alias(f"_rows{i}") for i in places),
    ).where(F.col("_first") == 1)
    # A part without a row of the largest feed holds only copies.
    for i in places:
        met = met.where(F.col("_largest").isNull() | (F.col("_largest") != i) | (F.size(f"_rows{i}") > 0))
    for i in places:
        met = met.select(*(c for c in met.columns if c != f"_rows{i}"), F.explode_outer(f"_rows{i}").alias(f"_row{i}"))
    lone = rows.where(F.col(layout.entity).isNull() | F.col(layout.time).isNull())
    names = [F.col(f"_row{i}.{c}").alias(c) for i in places for c in columns[i]]
    return met.select(*keys, *names).unionByName(lone.select(*keys, *names))


def union_patients(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames by column name; a column a frame lacks is null there."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), frames)


def dedupe_readings(df: DataFrame, order_by: list, layout: Layout = PATIENTS) -> DataFrame:
    """First row per entity and time in the order given.

    The rank filter is applied before the shuffle too, so many copies of one row never meet in one task.
    """
    first = Window.partitionBy(layout.entity, layout.time).orderBy(*order_by)
    return (
        df.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") == 1).drop("_rank")
    )


def order_of(df: DataFrame, ties: tuple[str, ...] = (), layout: Layout = PATIENTS) -> list[Column]:
    """Entity, then time (an interval event without a time of its own by its start), then the columns that break ties."""
    when = F.col(layout.time) if layout.time in df.columns else layout.event_time_of(df)
    return [F.col(layout.entity), when, *(F.col(c) for c in ties)]


def sorted_readings(df: DataFrame, layout: Layout = PATIENTS, ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows ordered by entity, then time, then ``ties``. To keep the order in the rows, see ``sinks.numbered``."""
    return df.orderBy(*order_of(df, ties, layout))
