import datetime as dt

import pytest

from chartline.layout import EVENTS_SCHEMA, PATIENTS, limits_table, metadata_table
from chartline.operators import combine, limits, select
from conftest import ONE, at, rows


@pytest.fixture(scope="module")
def data(hr):
    return hr(
        ("a", "2024-01-05 00:00:00", 1), ("a", "2024-01-05 23:59:59.999999", 2),
        ("a", "2024-01-06 00:00:00", None), ("b", "2024-01-05 12:00:00", 4),
        (None, "2024-01-05 12:00:00", 5),
    )


def test_patient_filter_never_matches_a_missing_id(data):
    assert rows(select.filter_patient(data, "b"), "hr") == [(4.0,)]
    assert select.filter_patient(data, None).count() == 0


def test_calendar_days_are_inclusive(data):
    out = select.filter_calendar_days(data, dt.date(2024, 1, 5))
    assert rows(out, "hr") == [(1.0,), (2.0,), (4.0,), (5.0,)]
    assert select.filter_calendar_days(data, dt.date(2024, 1, 5), dt.date(2024, 1, 6)).count() == 5


def test_events_are_filtered_by_time_or_start(spark):
    events = spark.createDataFrame(
        [("p", at("10:00:00"), None, None, None, None, None, False),
         ("p", None, at("09:59:00"), at("11:00:00"), None, None, None, True),
         ("p", None, at("10:30:00"), None, None, None, None, True)],
        EVENTS_SCHEMA,
    )
    out = select.filter_time_range(events, at("10:00:00"), at("10:30:00"))
    assert out.count() == 2
    assert {r[0] for r in rows(select.with_event_time(events), "seizure_time")} == {
        at("09:59:00"), at("10:00:00"), at("10:30:00"),
    }
    assert rows(select.valid_intervals(events), "seizure_start") == [(at("09:59:00"),)]


def test_intervals_of_point_events_only(events_at):
    assert select.valid_intervals(events_at("10:00:00")).count() == 0


def test_lists_and_bounds(data):
    assert [r[0] for r in select.patient_list(data).collect()] == ["a", "b"]
    bounds = select.patient_date_bounds(select.filter_patient(data, "a"))
    assert rows(bounds, "first_date", "last_date") == [(dt.date(2024, 1, 5), dt.date(2024, 1, 6))]
    extent = select.time_extent(data, ONE).head()
    assert tuple(extent) == (at("2024-01-05 00:00:00"), at("2024-01-06 00:00:00"))


def test_available_signals(spark):
    df = spark.createDataFrame(
        [("a", at("10:00:00"), 1.0, None)], "patient_id string, timestamp timestamp_ntz, spo2 double, heart_rate double"
    )
    assert rows(select.available_signals(df), "signal", "available") == [
        ("heart_rate", False), ("spo2", True),
    ]


def test_long_form_skips_missing_values(data):
    assert select.readings_long(data, layout=ONE).count() == 4


def test_limits(hr):
    data = hr(("10:00:00", 139), ("10:01:00", 140), ("10:02:00", 141), ("10:03:00", 9), ("10:04:00", None))
    out = limits.threshold_breaches(data, {"hr": (10, 140)}, ONE)
    assert rows(out, "value", "side") == [(141.0, "high"), (9.0, "low")]
    assert rows(limits.threshold_breaches(data, {"hr": (None, 140)}, ONE), "value") == [(141.0,)]
    assert rows(limits.breach_counts(data, {"hr": (10, 100)}, ONE), "side", "breaches") == [
        ("high", 3), ("low", 1),
    ]


def test_fixed_tables(spark):
    assert rows(limits_table(spark), "signal", "low", "high") == [
        ("blood_glucose", 70.0, 180.0), ("heart_rate", None, 140.0),
        ("spo2", 92.0, None), ("temperature", None, 38.0),
    ]
    units = dict(rows(metadata_table(spark), "signal", "unit"))
    assert units == {"spo2": "%", "heart_rate": "bpm", "temperature": "°C", "blood_glucose": "mg/dL"}
    assert PATIENTS.signals == ("spo2", "heart_rate", "temperature", "blood_glucose")


def feed(spark, name, *pairs):
    return spark.createDataFrame(
        [("p", at(t), float(v)) for t, v in pairs], f"patient_id string, timestamp timestamp_ntz, {name} double"
    )


def test_feeds_keep_every_row(spark):
    a = feed(spark, "a", ("10:00:00", 1), ("10:01:00", 2))
    b = feed(spark, "b", ("10:01:00", 3), ("10:02:00", 4))
    c = feed(spark, "c", ("10:02:00", 5))
    expected = [
        (at("10:00:00"), 1.0, None, None), (at("10:01:00"), 2.0, 3.0, None), (at("10:02:00"), None, 4.0, 5.0),
    ]
    for unique in (False, True):
        out = combine.combine_feeds([a, b, c], unique_keys=unique)
        assert rows(out, "timestamp", "a", "b", "c") == expected


def test_feeds_with_repeated_keys_multiply(spark):
    a = feed(spark, "a", ("10:00:00", 1), ("10:00:00", 2))
    b = feed(spark, "b", ("10:00:00", 3), ("10:00:00", 4))
    assert combine.combine_feeds([a, b]).count() == 4


def test_union_fills_missing_columns(spark):
    out = combine.union_patients([feed(spark, "a", ("10:00:00", 1)), feed(spark, "b", ("10:00:00", 2))])
    assert rows(out, "a", "b") == [(1.0, None), (None, 2.0)]


def test_dedupe_keeps_first_and_is_idempotent(hr):
    data = hr(("10:00:00", 3), ("10:00:00", 1), ("10:01:00", 2), (None, "10:00:00", 8), (None, "10:00:00", 9))
    once = combine.dedupe_readings(data, ["hr"])
    assert rows(once, "hr") == [(1.0,), (2.0,), (8.0,)]
    assert rows(combine.dedupe_readings(once, ["hr"]), "hr") == rows(once, "hr")


def test_sorted_by_patient_then_time(hr):
    data = hr(("b", "10:00:00", 1), ("a", "10:01:00", 2), ("a", "10:00:00", 3))
    assert [r.hr for r in combine.sorted_readings(data).collect()] == [3.0, 2.0, 1.0]


def test_range_without_a_time_column_raises(spark):
    with pytest.raises(ValueError):
        select.filter_time_range(spark.sql("select 'p' as patient_id"), at("00:00:00"), at("01:00:00"))


def test_start_only_intervals_are_sorted_by_start(spark):
    from chartline.operators.combine import sorted_readings

    events = spark.sql("""select 'p' as patient_id, cast(null as timestamp_ntz) as seizure_time, timestamp_ntz'2024-01-03 01:00:00' as seizure_start
        union all select 'p', timestamp_ntz'2024-01-02 02:00:00', null""")
    assert [r.seizure_start is None for r in sorted_readings(events).collect()] == [True, False]
