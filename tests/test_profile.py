import datetime as dt
import random
import statistics

import pytest

from chartline.layout import readings_schema
from chartline.operators import profile, summaries
from chartline.operators.quantiles import group_quantiles
from conftest import ONE, at, rows


def measured(df):
    return profile.sampling_profile(df, layout=ONE).head()


def test_sampling_profile(hr):
    out = measured(hr(("00:00:00", 1), ("00:01:00", 1), ("00:02:00", 1), ("00:06:00", 1), ("00:03:00", None)))
    assert (out.median_interval_seconds, out.frequency_label, out["count"]) == (60.0, "~60 seconds", 4)
    assert out.coverage_pct == pytest.approx(66.67, abs=0.01)


def test_full_coverage(hr):
    out = measured(hr(("00:00:00", 1), ("00:01:00", 1), ("00:02:00", 1), ("00:04:00", 1)))
    assert out.coverage_pct == 100.0


@pytest.mark.parametrize("n", [0, 1])
def test_too_few_readings(hr, n):
    out = measured(hr(*[("00:00:00", 1)] * n, ("00:01:00", None)))
    assert tuple(out)[2:] == (None, "Insufficient data", n, 0.0)


def test_median_of_zero_has_no_coverage(hr):
    out = measured(hr(("00:00:00", 1), ("00:00:00", 2)))
    assert (out.median_interval_seconds, out.frequency_label, out.coverage_pct) == (0.0, "~1 second", 0.0)


@pytest.mark.parametrize("chunk_seconds", [1, 60, 3600])
def test_gaps_match_brute_force_for_any_chunk(spark, chunk_seconds):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 2)
    data = [
        (p, start + dt.timedelta(microseconds=rng.randrange(7_200_000_000)), 1.0 if rng.random() < 0.8 else None)
        for p in "aaaab" for _ in range(60)
    ]
    out = profile.reading_gaps(
        spark.createDataFrame(data, readings_schema(ONE)), layout=ONE, chunk_seconds=chunk_seconds
    )
    expected = []
    for p in "ab":
        times = sorted(t for q, t, v in data if q == p and v is not None)
        expected += [(p, b, (b - a).total_seconds()) for a, b in zip(times, times[1:])]
    assert rows(out, "patient_id", "timestamp", "gap_seconds") == sorted(expected, key=repr)


def test_signal_stats(hr):
    data = hr(("a", "00:00:00", 1), ("a", "00:01:00", 2), ("a", "00:02:00", 6), ("a", "00:03:00", None),
              ("b", "00:00:00", 5), ("c", "00:00:00", None))
    out = {r.patient_id: tuple(r)[2:] for r in profile.signal_stats(data, layout=ONE).collect()}
    assert out["a"] == (1.0, 6.0, 3.0, 2.0, pytest.approx(statistics.stdev([1, 2, 6])), 3)
    assert out["b"] == (5.0, 5.0, 5.0, 5.0, 0.0, 1)
    assert out["c"] == (None, None, None, None, None, 0)


def test_stats_of_an_absent_signal(hr):
    assert profile.signal_stats(hr(("00:00:00", 1)), ["spo2", "hr"], layout=ONE).count() == 1


def test_signal_coverage(hr):
    data = hr(("00:00:00", None), ("00:01:00", 1), ("00:02:00", 2), ("b", "00:00:00", None))
    assert rows(profile.signal_coverage(data, layout=ONE), "patient_id", "count", "first_time", "last_time") == [
        ("p", 2, at("00:01:00"), at("00:02:00")),
    ]


def test_event_rates(events_at, hr):
    events = events_at(("a", "2024-01-02 00:00:00"), ("a", "2024-01-03 00:00:00"), ("b", "10:00:00"))
    patients = hr(("a", "00:00:00", 1), ("b", "00:00:00", 1), ("c", "00:00:00", 1))
    out = rows(summaries.event_rates(events, patients=patients), "patient_id", "total_count", "per_hour", "per_day")
    assert out == [("a", 2, 2 / 24, 2.0), ("b", 1, 1.0, 24.0), ("c", 0, 0.0, 0.0)]
    month = at("2024-01-01 00:00:00"), at("2024-01-31 23:59:59.999999")
    ranged = summaries.event_rates(events, *month).where("patient_id = 'a'").head()
    assert ranged.per_day == pytest.approx(2 / 31)


def test_event_type_counts(spark):
    events = spark.createDataFrame(
        [("p", "focal"), ("p", "absence"), ("p", "absence"), ("p", None), ("p", "atonic")],
        "patient_id string, seizure_type string",
    )
    out = [tuple(r) for r in summaries.event_type_counts(events).collect()]
    assert out == [("p", "absence", 2), ("p", "atonic", 1), ("p", "focal", 1)]


def test_patient_summary_and_totals(hr, events_at):
    data = hr(("a", "00:00:00", 1), ("a", "00:05:00", None), ("b", "00:01:00", 2))
    events = events_at(("a", "00:02:00"), ("x", "00:02:00"))
    assert rows(summaries.patient_summary(data, events), "patient_id", "total_records", "first_time", "last_time", "event_count") == [
        ("a", 2, at("00:00:00"), at("00:05:00"), 1), ("b", 1, at("00:01:00"), at("00:01:00"), 0),
    ]
    assert tuple(summaries.dataset_totals(data, events).head()) == (3, 2, 2)
    assert tuple(summaries.dataset_totals(hr(), events_at()).head()) == (0, 0, 0)


def test_summary_cards(hr, events_at):
    data = hr(("00:00:00", 1.25), ("00:01:00", 2.5))
    card = summaries.summary_cards(
        data, events_at("00:00:00"), at("2024-01-02 00:00:00"), at("2024-01-04 23:59:59.999999"), layout=ONE
    ).head()
    assert tuple(card) == ("p", "hr", 1.9, 1.3, 2.5, 1, 0.33)


def test_hot_group_medians(spark):
    # A third of all rows in one group, another third a single repeated value.
    rng = random.Random(5)
    data = [("hot", rng.random()) for _ in range(3000)] + [("same", 7.0)] * 3000
    data += [(f"g{i}", float(i + j)) for i in range(300) for j in range(10)]
    out = dict(tuple(r) for r in group_quantiles(
        spark.createDataFrame(data, "g string, v double"), ["g"], "v", {"m": 0.5}
    ).collect())
    assert len(out) == 302 and out["same"] == 7.0 and out["g10"] == 14.5
    assert out["hot"] == pytest.approx(statistics.median(v for g, v in data if g == "hot"), rel=1e-12)


def test_values_far_from_zero_are_split(spark):
    """A million-offset group: exact quantiles, and no window partition holds more than a small share."""
    values = spark.range(20_000).selectExpr("'g' as g", "1e6 + (id * 7919 % 20000) / 20000.0 as v").union(
        spark.createDataFrame([("i", float("inf")), ("i", 1.0), ("i", float("-inf"))], "g string, v double")
    )
    out = {r.g: r for r in group_quantiles(values, ["g"], "v", {"p": 0.25, "m": 0.5}).collect()}
    assert out["g"].m == pytest.approx(1e6 + 9999.5 / 20000, abs=1e-9) and out["g"].p == pytest.approx(1e6 + 4999.75 / 20000, abs=1e-9)
    assert out["i"].m == 1.0
