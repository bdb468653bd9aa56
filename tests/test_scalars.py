import datetime as dt

import pytest
from pyspark.sql import functions as F

from chartline.functions import text, times
from conftest import at


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()[0]


@pytest.mark.parametrize(
    "seconds, label",
    [(0.0, "~1 second"), (1.9, "~1 second"), (2.0, "~2 seconds"), (60.0, "~60 seconds"),
     (119.9, "~119 seconds"), (120.0, "~2 minutes"), (3599.0, "~59 minutes"), (3600.0, "~1 hour"),
     (7200.0, "~2 hours"), (86400.0, "~1 day"), (172800.0, "~2 days")],
)
def test_interval_label(spark, seconds, label):
    assert one(spark, text.interval_label(F.lit(seconds))) == label


@pytest.mark.parametrize(
    "given, value",
    [("97", 97.0), (" 98 ", 98.0), ("1e2", 100.0), ("-.5", -0.5), ("9,8", None), ("abc", None),
     ("0x10", None), ("nan", None), ("True", None), ("", None), ("1d", None), ("1f", None)],
)
def test_number(spark, given, value):
    assert one(spark, text.number(F.lit(given))) == value


@pytest.mark.parametrize(
    "given, value",
    [("2", True), ("-1", True), ("0.5", True), ("0", False), ("", False), (None, False),
     ("true", True), ("TRUE", True), ("false", False), ("yes", False), ("no", False),
     ("inf", True), ("nan", False)],
)
def test_truthy(spark, given, value):
    assert one(spark, text.truthy(F.lit(given).cast("string"))) is value


@pytest.mark.parametrize(
    "given, value",
    [("2024-01-15T10:00:00", at("2024-01-15 10:00:00")),
     ("2024-01-15 10:00:00.000001", at("2024-01-15 10:00:00.000001")),
     ("1705312200", at("2024-01-15 09:50:00")),
     ("1705312200000", at("2024-01-15 09:50:00")),
     ("1705312200.25", at("2024-01-15 09:50:00.250000")),
     ("1.7053122E9", at("2024-01-15 09:50:00")),
     ("-1", at("1969-12-31 23:59:59")),
     ("1e30", None), ("x", None), ("", None), (None, None)],
)
def test_parse_timestamp(spark, given, value):
    assert one(spark, text.parse_timestamp(F.lit(given).cast("string"))) == value


def test_calendar_bounds():
    day = dt.date(2024, 1, 5)
    assert times.calendar_bounds(day) == (at("2024-01-05 00:00:00"), at("2024-01-05 23:59:59.999999"))


@pytest.mark.parametrize("granularity, width", [("1s", 1), ("15min", 900), ("1D", 86400), ("7min", 420), ("2h", 7200)])
def test_width(granularity, width):
    assert times.width_seconds(granularity) == width


@pytest.mark.parametrize("granularity", ["", "0s", "1W", "1M", "minute", "-5min"])
def test_unknown_width_raises(granularity):
    with pytest.raises(ValueError):
        times.width_seconds(granularity)


def test_display_text(spark):
    assert one(spark, text.with_unit(F.lit(36.64), "°C")) == "36.6 °C"
    assert one(spark, text.with_unit(F.lit(None).cast("double"), "%")) is None
    assert text.context_title("SpO2", 5) == "SpO2 (±5min)"


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_time_arithmetic_ignores_the_session_zone(spark, zone):
    # 02:30 on this day does not exist in New York.
    kept = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        skipped = times.ntz("2024-03-10 02:30:00.5")
        row = spark.range(1).select(
            times.epoch_micros(skipped).alias("micros"),
            times.from_epoch_micros(times.epoch_micros(skipped)).alias("back"),
            times.floor_time(skipped, 3600).alias("hour"),
            times.day_start(times.ntz("1969-12-31 23:00:00")).alias("day"),
            times.seconds_between(times.ntz("2024-03-10 01:30:00"), skipped).alias("gap"),
        ).head()
    finally:
        spark.conf.set("spark.sql.session.timeZone", kept)
    assert row.micros == 1710037800500000
    assert row.back == at("2024-03-10 02:30:00.500000")
    assert row.hour == at("2024-03-10 02:00:00")
    assert row.day == at("1969-12-31 00:00:00")
    assert row.gap == 3600.5
