"""Every operator applied to the ``events`` table, one query per operator.

Users stand in for patients, the four event types other than ``error`` for signals, and ``error``
rows for the events. Every query reads the whole table; a query narrows it only where a filter is what
it shows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartline.functions.text import interval_label, parse_timestamp
from chartline.functions.times import MICROS, add_micros, epoch_micros, floor_time, ntz
from chartline.layout import Layout
from chartline.operators import bins, combine, context, density, limits, nearest, profile, select, summaries
from chartline.sources import ingest, sinks

SIGNALS = ("click", "view", "purchase", "signup")
USERS = Layout(entity="user_id", time="ts", signals=SIGNALS)
# Uploads name their time column "timestamp".
UPLOAD = Layout(signals=SIGNALS)

RANGE = (dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 25, 23, 59, 59, 999999))
# All that the table covers.
MONTH = (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31, 23, 59, 59, 999999))
LIMITS = {"click": (5, 50), "view": (None, 60), "purchase": (10, None), "signup": (2, 80)}
WINDOW_MINUTES = 360
RAW_LIMIT = 50

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def signal_value(name: str) -> Column:
    return F.when(F.col("event_type") == name, F.col("value"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide rows: a row holds the value of the one signal it reports."""
    return (
        table(spark, sf_dir)
        .where(F.col("event_type") != "error")
        .select("user_id", "ts", *(signal_value(s).alias(s) for s in SIGNALS))
    )


def happened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events: some intervals, some of them ending before they start, the others points."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    is_interval = k % 2 == 0
    seconds = F.when(k % 10 == 0, -k).otherwise(k)
    end = add_micros(F.col("ts"), seconds.cast("bigint") * MICROS)
    return (
        table(spark, sf_dir)
        .where(F.col("event_type") == "error")
        .select(
            "event_id",
            "user_id",
            F.when(~is_interval, F.col("ts")).alias("seizure_time"),
            F.when(is_interval, F.col("ts")).alias("seizure_start"),
            F.when(is_interval, end).alias("seizure_end"),
            F.concat(F.lit("type_"), (k % 5).cast("string")).alias("seizure_type"),
            F.concat(F.lit("severity_"), (k % 3).cast("string")).alias("severity"),
            F.when(~is_interval, k).alias("duration_seconds"),
            is_interval.alias("is_interval"),
        )
    )


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """All doubles rounded, so that engines adding in another order still agree."""
    return df.select(
        *(
            F.round(f.name, special.get(f.name, digits)).alias(f.name)
            if f.dataType.typeName() == "double"
            else F.col(f.name)
            for f in df.schema.fields
        )
    )


# Ingest. The text columns are made from the table, damaged in known places.


def time_text() -> Column:
    micros = epoch_micros(F.col("ts"))
    kind = F.col("event_id") % 6
    return (
        F.when(kind == 0, F.col("ts").cast("string"))
        .when(kind == 1, F.replace(F.col("ts").cast("string"), F.lit(" "), F.lit("T")))
        .when(kind == 2, F.call_function("div", micros, F.lit(MICROS)).cast("string"))
        .when(kind == 3, F.call_function("div", micros, F.lit(1000)).cast("string"))
        .when(kind == 4, F.lit("x"))
        .otherwise(F.lit(" "))
    )


def value_text(value: Column) -> Column:
    text = value.cast("string")
    kind = F.col("event_id") % 7
    return (
        F.when(kind == 0, F.lit("abc"))
        .when(kind == 1, F.concat(text, F.lit("d")))
        .when(kind == 2, F.concat(F.lit(" "), text, F.lit(" ")))
        .when(kind == 3, F.lit("nan"))
        .otherwise(text)
    )


def flag_text() -> Column:
    kind = F.col("event_id") % 9
    flags = ("1", "2", "-1", "0.5", "TRUE", "0", "", "no")
    chosen = F.lit(None).cast("string")
    for i, flag in enumerate(flags):
        chosen = F.when(kind == i, F.lit(flag)).otherwise(chosen)
    return chosen


def upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upload with hourly times, so that many rows of a user share one."""
    hour = floor_time(F.col("ts"), 3600)
    return table(spark, sf_dir).withColumn("ts", hour).select(
        F.col("event_id").alias(ingest.ORDINAL),
        F.col("user_id").cast("string").alias("patient_id"),
        time_text().alias("timestamp"),
        *(value_text(signal_value(s)).alias(s) for s in SIGNALS),
        flag_text().alias("seizure"),
    )


@query
def ingest_readings(spark, sf_dir):
    rows = ingest.clean_upload(ingest.parse_upload(upload(spark, sf_dir), UPLOAD), layout=UPLOAD)
    return ingest.extract_readings(rows, UPLOAD)


@query
def ingest_default_id(spark, sf_dir):
    """The same upload without its id column: all rows belong to the default id."""
    raw = upload(spark, sf_dir).drop("patient_id")
    rows = ingest.clean_upload(ingest.parse_upload(raw, UPLOAD), layout=UPLOAD)
    return ingest.extract_readings(rows, UPLOAD)


@query
def event_dispatch(spark, sf_dir):
    """Events by the columns given: interval ends beside a flag, a flag alone, one interval end alone."""
    given = F.col("event_type") == "error"
    end = add_micros(F.col("ts"), 90 * MICROS).cast("string")
    raw = table(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("patient_id"),
        F.col("ts").alias("timestamp"),
        flag_text().alias("seizure"),
        F.when(given, F.col("ts").cast("string")).alias("seizure_start"),
        F.when(given & (F.col("event_id") % 3 > 0), end).alias("seizure_end"),
    )
    shapes = {
        "ends": raw,
        "flag": raw.drop("seizure_start", "seizure_end").withColumnRenamed("seizure", "seizure_event"),
        "start": raw.drop("seizure", "seizure_end"),
    }
    columns = ("patient_id", "seizure_time", "seizure_start", "seizure_end", "is_interval")
    return combine.union_patients(
        [ingest.extract_events(df).select(F.lit(name).alias("given"), *columns) for name, df in shapes.items()]
    )


@query
def parse_timestamps(spark, sf_dir):
    return table(spark, sf_dir).select("event_id", parse_timestamp(time_text()).alias("parsed"))


@query
def dedupe_readings(spark, sf_dir):
    hourly = table(spark, sf_dir).select(
        "event_id", "user_id", floor_time(F.col("ts"), 3600).alias("ts"), "event_type", "value"
    )
    return combine.dedupe_readings(hourly, ["event_id"], USERS)


@query
def extract_readings(spark, sf_dir):
    raw = table(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("patient_id"),
        F.col("ts").alias("timestamp"),
        *(value_text(signal_value(s)).alias(s) for s in SIGNALS),
    )
    return ingest.extract_readings(raw, UPLOAD)


@query
def extract_point_events(spark, sf_dir):
    raw = table(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("patient_id"),
        F.col("ts").alias("timestamp"),
        flag_text().alias("seizure"),
    )
    return ingest.extract_point_events(raw, "seizure").select(
        "patient_id", "seizure_time", "seizure_type", "severity"
    )


@query
def extract_interval_events(spark, sf_dir):
    given = F.col("event_type") == "error"
    end = add_micros(F.col("ts"), 90 * MICROS).cast("string")
    raw = table(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("patient_id"),
        F.when(given, F.col("ts").cast("string")).alias("seizure_start"),
        F.when(given & (F.col("event_id") % 3 > 0), end).alias("seizure_end"),
    )
    return ingest.extract_interval_events(raw).select(
        "patient_id", "seizure_time", "seizure_start", "seizure_end", "is_interval"
    )


@query
def ingest_report(spark, sf_dir):
    return ingest.ingest_report(ingest.parse_upload(upload(spark, sf_dir), UPLOAD), UPLOAD)


# Filters and projections.


@query
def filter_patient(spark, sf_dir):
    return select.filter_patient(readings(spark, sf_dir), 3, USERS)


@query
def filter_time_range(spark, sf_dir):
    return select.filter_time_range(happened(spark, sf_dir), *RANGE, layout=USERS).select(
        "event_id", "user_id", "seizure_type"
    )


@query
def filter_calendar_days(spark, sf_dir):
    return select.filter_calendar_days(
        readings(spark, sf_dir), dt.date(2024, 1, 5), dt.date(2024, 1, 9), USERS
    )


@query
def readings_long(spark, sf_dir):
    return select.readings_long(readings(spark, sf_dir), layout=USERS)


@query
def event_time(spark, sf_dir):
    return select.with_event_time(happened(spark, sf_dir), USERS).select(
        "event_id", "user_id", "seizure_time"
    )


@query
def valid_intervals(spark, sf_dir):
    return select.valid_intervals(happened(spark, sf_dir), USERS).select(
        "event_id", "user_id", "seizure_start", "seizure_end"
    )


# Aggregations.


@query
def patient_list(spark, sf_dir):
    return select.patient_list(readings(spark, sf_dir), USERS)


@query
def patient_date_bounds(spark, sf_dir):
    return select.patient_date_bounds(readings(spark, sf_dir), USERS).select(
        "user_id", F.col("first_date").cast("string"), F.col("last_date").cast("string")
    )


@query
def available_signals(spark, sf_dir):
    return select.available_signals(readings(spark, sf_dir), USERS)


@query
def time_extent(spark, sf_dir):
    return select.time_extent(readings(spark, sf_dir), USERS)


@query
def signal_stats(spark, sf_dir):
    return rounded(profile.signal_stats(readings(spark, sf_dir), layout=USERS))


@query
def event_rates(spark, sf_dir):
    return rounded(
        summaries.event_rates(
            happened(spark, sf_dir), patients=table(spark, sf_dir).select("user_id"), layout=USERS
        )
    )


@query
def event_rates_in_range(spark, sf_dir):
    own = select.filter_time_range(happened(spark, sf_dir), *RANGE, layout=USERS)
    return rounded(
        summaries.event_rates(own, *RANGE, table(spark, sf_dir).select("user_id"), USERS)
    )


@query
def event_type_counts(spark, sf_dir):
    return summaries.event_type_counts(happened(spark, sf_dir), USERS)


@query
def event_type_ranks(spark, sf_dir):
    return summaries.event_type_ranks(happened(spark, sf_dir), USERS)


@query
def event_type_map(spark, sf_dir):
    """The map as text, in its own order."""
    found = summaries.event_type_map(happened(spark, sf_dir), USERS)
    return found.select("user_id", F.to_json("type_counts").alias("type_counts"))


@query
def cards_of_all(spark, sf_dir):
    """Readings of the users with a high click only, so that the others have nothing but events."""
    rows = readings(spark, sf_dir)
    clicked = rows.where("click > 150").select("user_id").distinct()
    return summaries.summary_cards(rows.join(clicked, "user_id", "left_semi"), happened(spark, sf_dir), *MONTH, layout=USERS)


@query
def patient_summary(spark, sf_dir):
    return summaries.patient_summary(readings(spark, sf_dir), happened(spark, sf_dir), USERS)


@query
def signal_coverage(spark, sf_dir):
    return profile.signal_coverage(readings(spark, sf_dir), layout=USERS)


@query
def dataset_totals(spark, sf_dir):
    return summaries.dataset_totals(readings(spark, sf_dir), happened(spark, sf_dir), USERS)


@query
def summary_cards(spark, sf_dir):
    return summaries.summary_cards(readings(spark, sf_dir), happened(spark, sf_dir), *MONTH, layout=USERS)


# Time bins.


@query
def resample_mean(spark, sf_dir):
    return rounded(bins.resample(readings(spark, sf_dir), "1h", layout=USERS))


@query
def resample_median(spark, sf_dir):
    return rounded(bins.resample(readings(spark, sf_dir), "6h", "median", layout=USERS))


@query
def resample_band(spark, sf_dir):
    return rounded(bins.resample(readings(spark, sf_dir), "1D", show_band=True, layout=USERS))


@query
def resample_ffill(spark, sf_dir):
    return rounded(
        bins.resample(
            readings(spark, sf_dir), "6h", "median", show_band=True, ffill=True, layout=USERS,
        )
    )


@query
def resample_two_signals(spark, sf_dir):
    return rounded(bins.resample(readings(spark, sf_dir), "6h", signals=("click", "view"), layout=USERS))


@query
def resample_custom_width(spark, sf_dir):
    return rounded(bins.resample(readings(spark, sf_dir), "5h", layout=USERS))


@query
def resample_auto(spark, sf_dir):
    return rounded(bins.resample(readings(spark, sf_dir), "auto", dense=False, layout=USERS))


@query
def resample_raw(spark, sf_dir):
    return rounded(bins.resample(readings(spark, sf_dir), "raw", "median", layout=USERS))


@query
def bin_grid(spark, sf_dir):
    spans = readings(spark, sf_dir).groupBy("user_id").agg(
        floor_time(F.min("ts"), 21_600).alias("first"), F.max("ts").alias("final")
    )
    return bins.bin_grid(spans, ["user_id"], "first", "final", F.lit(21_600 * MICROS), "bin")


@query
def raw_guard(spark, sf_dir):
    return bins.raw_guard(readings(spark, sf_dir), limit=RAW_LIMIT, layout=USERS)


@query
def auto_granularity(spark, sf_dir):
    return rounded(bins.auto_granularity(readings(spark, sf_dir), USERS))


@query
def event_density_hour(spark, sf_dir):
    return rounded(
        density.event_density(
            happened(spark, sf_dir), "hour", *MONTH, table(spark, sf_dir).select("user_id"), USERS
        )
    )


@query
def event_density_some(spark, sf_dir):
    """An axis for the users with clicks only; events of others do not show."""
    clicked = table(spark, sf_dir).where("event_type = 'click'").select("user_id")
    return rounded(density.event_density(happened(spark, sf_dir), "day", *MONTH, clicked, USERS))


@query
def event_density_day(spark, sf_dir):
    return rounded(density.event_density(happened(spark, sf_dir), "day", layout=USERS))


@query
def event_density_empty(spark, sf_dir):
    none = happened(spark, sf_dir).where(F.lit(False))
    return density.event_density(none, "day", *RANGE, table(spark, sf_dir).select("user_id"), USERS)


# Sampling.


@query
def reading_gaps(spark, sf_dir):
    return rounded(profile.reading_gaps(readings(spark, sf_dir), layout=USERS))


@query
def sampling_profile(spark, sf_dir):
    return rounded(
        profile.sampling_profile(readings(spark, sf_dir), layout=USERS), median_interval_seconds=3
    )


@query
def interval_labels(spark, sf_dir):
    gaps = profile.reading_gaps(readings(spark, sf_dir), layout=USERS)
    return gaps.select("user_id", "signal", "ts", interval_label(F.col("gap_seconds")).alias("label"))


# Joins.


def feeds(spark, sf_dir) -> list[DataFrame]:
    events = table(spark, sf_dir)
    return [
        events.where(F.col("event_type") == s).select("user_id", "ts", F.col("value").alias(s))
        for s in SIGNALS
    ]


@query
def combine_feeds(spark, sf_dir):
    return combine.combine_feeds(feeds(spark, sf_dir), layout=USERS)


@query
def combine_unique_feeds(spark, sf_dir):
    return combine.combine_feeds(feeds(spark, sf_dir), unique_keys=True, layout=USERS)


@query
def combine_feeds_hourly(spark, sf_dir):
    """Feeds of one row per user and hour, so that their keys meet."""
    hourly = [
        feed.groupBy("user_id", floor_time(F.col("ts"), 3600).alias("ts")).agg(F.max(s).alias(s))
        for s, feed in zip(SIGNALS, feeds(spark, sf_dir), strict=True)
    ]
    return combine.combine_feeds(hourly, layout=USERS)


@query
def union_patients(spark, sf_dir):
    return combine.union_patients(feeds(spark, sf_dir))


@query
def sorted_readings(spark, sf_dir):
    return combine.sorted_readings(readings(spark, sf_dir), USERS)


@query
def numbered_readings(spark, sf_dir):
    return sinks.numbered(readings(spark, sf_dir), layout=USERS)


@query
def combine_feeds_repeated(spark, sf_dir):
    """Feeds by user and day: all rows of a user and day multiply."""
    daily = [feed.withColumn("ts", floor_time(F.col("ts"), 86_400)) for feed in feeds(spark, sf_dir)]
    return combine.combine_feeds(daily[:2], layout=USERS, hot_rows=2)


@query
def parse_time_forms(spark, sf_dir):
    """Texts without a date, with parts of a time of day, with offsets in several forms."""
    day, clock = F.col("ts").cast("string").substr(1, 10), F.date_format("ts", "HH:mm")
    kind = F.col("event_id") % 7
    text = (
        F.when(kind == 0, F.concat(clock, F.lit(":00Z"))).when(kind == 1, F.concat(F.lit("T"), clock, F.lit(":00Z")))
        .when(kind == 2, F.concat_ws(" ", day, F.concat(clock, F.lit("+05")))).when(kind == 3, F.concat(day, F.lit("T"), F.substring(clock, 1, 2), F.lit("+05:00")))
        .when(kind == 4, F.concat(day, F.lit("T"), F.substring(clock, 1, 2))).when(kind == 5, day).otherwise(F.concat(day, F.lit("T"), clock, F.lit(":00EST")))
    )
    return table(spark, sf_dir).select("event_id", parse_timestamp(text).alias("parsed"))


@query
def event_context(spark, sf_dir):
    return rounded(
        context.event_context(
            readings(spark, sf_dir), happened(spark, sf_dir), WINDOW_MINUTES, layout=USERS
        )
    )


@query
def event_table(spark, sf_dir):
    return rounded(
        context.event_table(happened(spark, sf_dir), readings(spark, sf_dir), WINDOW_MINUTES, USERS)
    )


@query
def nearest_reading(spark, sf_dir):
    return rounded(
        nearest.nearest_reading(readings(spark, sf_dir), happened(spark, sf_dir), layout=USERS)
    )


@query
def flag_event_rows(spark, sf_dir):
    return nearest.flag_event_rows(
        readings(spark, sf_dir), happened(spark, sf_dir), 3600, layout=USERS
    )


@query
def threshold_breaches(spark, sf_dir):
    return limits.threshold_breaches(readings(spark, sf_dir), LIMITS, USERS)


@query
def breach_counts(spark, sf_dir):
    return limits.breach_counts(readings(spark, sf_dir), LIMITS, USERS)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly mean of every signal per user, on a dense grid."""
    return rounded(bins.resample(readings(spark, sf_dir), "1h", layout=USERS))
