import datetime as dt
import random

import pytest

from chartline.layout import EVENTS_SCHEMA, Layout, readings_schema
from chartline.operators import context, nearest
from conftest import ONE, at, rows

TWO = Layout(signals=("hr", "t"))


def test_context_window_is_closed(hr, events_at):
    data = hr(("09:54:59.999999", 100), ("09:55:00", 1), ("10:05:00", 3), ("10:05:00.000001", 100),
              ("10:01:00", None), ("q", "10:00:00", 50))
    out = context.event_context(data, events_at("10:00:00"), layout=ONE)
    assert rows(out, "signal", "mean", "min", "max", "count") == [("hr", 2.0, 1.0, 3.0, 2)]


def test_context_without_readings(hr, events_at):
    out = context.event_context(hr(("q", "10:00:00", 1)), events_at("10:00:00"), layout=ONE)
    assert rows(out, "mean", "min", "max", "count") == [(None, None, None, 0)]


def test_reading_at_the_event_counts_once(hr, events_at):
    out = context.event_context(hr(("10:00:00", 4)), events_at("10:00:00", "10:00:00"), layout=ONE)
    assert rows(out, "mean", "count") == [(4.0, 1)]


def test_window_must_be_positive(hr, events_at):
    with pytest.raises(ValueError):
        context.event_context(hr(), events_at(), 0, layout=ONE)


def made_up(seed, minutes=600):
    """Random readings and events on whole minutes, so that ties and edges are common."""
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 2)

    def moment():
        return start + dt.timedelta(minutes=rng.randrange(minutes))

    # Patient a holds most rows; c has no readings, d no events.
    seen = {}
    for p in "aaaaaabd":
        for _ in range(40):
            value = tuple(rng.choice([None, round(rng.uniform(0, 9), 2)]) for _ in range(2))
            seen[p, moment()] = value
    readings = [(p, t, *v) for (p, t), v in seen.items()]
    events = sorted({(rng.choice("aabc"), moment()) for _ in range(60)})
    return readings, events


@pytest.fixture(scope="module")
def frames(spark):
    readings, events = made_up(11)
    return (
        readings, events,
        spark.createDataFrame(readings, readings_schema(TWO)).cache(),
        spark.createDataFrame(events, "patient_id string, seizure_time timestamp_ntz").cache(),
    )


@pytest.mark.parametrize("minutes, chunk_seconds", [(5, 3600), (7, 120), (90, 3600), (90, 1000), (2000, 3600)])
def test_context_matches_brute_force(frames, minutes, chunk_seconds):
    readings, events, r, e = frames
    wide = context.context_wide(r, e, minutes, layout=TWO, chunk_seconds=chunk_seconds)
    got = {(x.patient_id, x.event_time): x for x in wide.collect()}
    assert set(got) == set(events)
    reach = dt.timedelta(minutes=minutes)
    for p, t in events:
        for i, s in enumerate(TWO.signals):
            values = [x[2 + i] for x in readings if x[0] == p and abs(x[1] - t) <= reach and x[2 + i] is not None]
            x = got[p, t]
            assert x[f"{s}_count"] == len(values)
            assert x[f"{s}_min"] == min(values, default=None)
            assert x[f"{s}_max"] == max(values, default=None)
            assert x[f"{s}_mean"] == (pytest.approx(sum(values) / len(values)) if values else None)


@pytest.mark.parametrize("chunk_seconds", [60, 1000, 3600, 1_000_000])
def test_nearest_matches_brute_force(frames, chunk_seconds):
    readings, events, r, e = frames
    out = nearest.nearest_reading(r, e, layout=TWO, chunk_seconds=chunk_seconds)
    got = {(x.patient_id, x.event_time, x.signal): (x.nearest_time, x.value, x.distance_seconds) for x in out.collect()}
    assert len(got) == 2 * len(events)
    for p, t in events:
        for i, s in enumerate(TWO.signals):
            near = [(abs(x[1] - t), x[1], x[2 + i]) for x in readings if x[0] == p and x[2 + i] is not None]
            expected = min(near, key=lambda n: n[:2], default=None)
            assert got[p, t, s] == (
                (None, None, None) if expected is None
                else (expected[1], expected[2], expected[0].total_seconds())
            )


def test_nearest_tie_goes_to_the_earlier(hr, events_at):
    out = nearest.nearest_reading(hr(("00:00:00", 1), ("00:10:00", 2)), events_at("00:05:00"), layout=ONE)
    assert rows(out, "nearest_time", "value", "distance_seconds") == [(at("00:00:00"), 1.0, 300.0)]


def test_nearest_skips_missing_values_and_reaches_over_chunks(hr, events_at):
    data = hr(("00:00:00", 1), ("23:00:00", None), ("23:59:00", None))
    out = nearest.nearest_reading(data, events_at("23:30:00"), layout=ONE)
    assert rows(out, "nearest_time", "value") == [(at("00:00:00"), 1.0)]


def test_flag_tolerance_is_strict(hr, events_at):
    data = hr(("00:00:00", None), ("01:00:00", 2), ("02:00:00", 3))
    events = events_at("00:00:59.999999", "00:59:00", "01:59:30", "02:00:10")
    out = nearest.flag_event_rows(data, events, layout=ONE)
    assert rows(out, "timestamp", "seizure") == [
        (at("00:00:00"), 1), (at("01:00:00"), 0), (at("02:00:00"), 1),
    ]


def test_flags_of_other_patients_do_not_mix(hr, events_at):
    out = nearest.flag_event_rows(hr(("a", "00:00:00", 1), ("b", "00:00:00", 1)), events_at(("b", "00:00:01")), layout=ONE)
    assert rows(out, "patient_id", "seizure") == [("a", 0), ("b", 1)]


@pytest.fixture(scope="module")
def mixed_events(spark):
    return spark.createDataFrame(
        [("p", at("10:00:00"), None, None, "focal", "mild", 42, False),
         ("p", None, at("10:00:00"), at("10:01:30.9"), "unknown", "unknown", None, True),
         ("p", None, at("10:00:00"), at("09:58:29.5"), None, None, None, True),
         ("p", None, at("12:00:00"), None, None, None, None, True),
         ("p", None, None, None, None, None, None, False)],
        EVENTS_SCHEMA,
    )


def test_event_table(hr, mixed_events):
    data = hr(("09:58:00", 36.5), ("10:02:00", 36.75))
    out = context.event_table(mixed_events, data, layout=ONE)
    assert rows(out, "event_time", "end_time", "duration_s", "type", "severity", "hr_mean") == sorted([
        (at("10:00:00"), None, 42, "focal", "mild", 36.625),
        (at("10:00:00"), at("10:01:30.900000"), 90, "unknown", "unknown", 36.625),
        (at("10:00:00"), at("09:58:29.500000"), -90, None, None, 36.625),
        (at("12:00:00"), None, None, None, None, None),
        (None, None, None, None, None, None),
    ], key=repr)


def test_display_table(spark, events_at):
    data = spark.createDataFrame(
        [("p", at("10:00:00"), 97.25, 80.04)],
        "patient_id string, timestamp timestamp_ntz, spo2 double, heart_rate double",
    )
    shown = context.display_event_table(context.event_table(events_at("10:00:00"), data)).head().asDict()
    assert shown["SpO2 (±5min)"].endswith(" %")
    assert shown["Heart Rate (±5min)"] == "80.0 bpm"
    assert shown["Event Time"] == at("10:00:00")
    assert "Temperature (±5min)" not in shown


def test_empty_events(hr, events_at):
    data = hr(("10:00:00", 1))
    assert context.event_table(events_at(), data, layout=ONE).count() == 0
    assert nearest.nearest_reading(data, events_at(), layout=ONE).count() == 0
    assert rows(nearest.flag_event_rows(data, events_at(), layout=ONE), "seizure") == [(0,)]
