import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartline.functions.times import MICROS
from chartline.layout import Layout, readings_schema
from chartline.operators import bins
from chartline.operators.density import event_density
from chartline.operators.quantiles import group_quantiles
from conftest import ONE, at, rows

CASE = (("00:03:00", 1), ("00:04:59", 2), ("00:05:00", None), ("00:21:00", 10), ("00:22:00", 4))


def series(df, column="hr"):
    return [r[column] for r in df.orderBy("timestamp").collect()]


def test_dense_mean(hr):
    out = bins.resample(hr(*CASE), "5min", layout=ONE)
    assert series(out) == [1.5, None, None, None, 7.0]
    assert series(out, "timestamp") == [at(f"00:{m:02}:00") for m in (0, 5, 10, 15, 20)]


@pytest.mark.parametrize("aggregation", ["mean", "median"])
def test_bands(hr, aggregation):
    out = bins.resample(hr(*CASE), "5min", aggregation, show_band=True, layout=ONE)
    assert series(out) == [1.5, None, None, None, 7.0]
    assert series(out, "hr_p10") == pytest.approx([1.1, None, None, None, 4.6])
    assert series(out, "hr_p90") == pytest.approx([1.9, None, None, None, 9.4])


def test_forward_fill(hr):
    out = bins.resample(hr(*CASE), "5min", ffill=True, show_band=True, layout=ONE)
    assert series(out) == [1.5, 1.5, 1.5, 1.5, 7.0]
    assert series(out, "hr_p10") == pytest.approx([1.1, 1.1, 1.1, 1.1, 4.6])


def test_forward_fill_crosses_chunks_and_is_idempotent(hr):
    data = hr(("00:00:00", None), ("00:10:00", 1), ("00:50:00", None), ("03:10:00", None), ("05:00:00", 2))
    once = bins.forward_fill(data, ["hr"], ONE, chunk_seconds=3600)
    assert series(once) == [None, 1.0, 1.0, 1.0, 2.0]
    assert series(bins.forward_fill(once, ["hr"], ONE, chunk_seconds=600)) == series(once)


def test_odd_width_counts_from_midnight_of_the_first_day(hr):
    out = bins.resample(hr(("05:03:00", 1)), "7min", layout=ONE)
    assert series(out, "timestamp") == [at("05:01:00")]


def test_odd_width_keeps_its_rhythm_over_midnight(hr):
    out = bins.resample(hr(("2024-01-02 23:00:00", 1), ("2024-01-03 01:00:00", 3)), "5h", layout=ONE)
    assert series(out, "timestamp") == [at("20:00:00"), at("2024-01-03 01:00:00")]


def test_sparse_output(hr):
    out = bins.resample(hr(*CASE), "5min", "median", dense=False, layout=ONE)
    assert series(out) == [1.5, None, 7.0]


@pytest.mark.parametrize(
    "span, width",
    [(0, 60), (597_600, 1), (604_800, 60), (2_678_400, 60), (3_000_000, 300), (9_000_000, 900),
     (36_000_000, 3600), (216_000_000, 21600), (864_000_000, 86400)],
)
def test_auto_width(spark, span, width):
    assert spark.range(1).select(bins.auto_width(F.lit(float(span)))).head()[0] == width


def test_raw_returns_every_row_at_any_size(spark):
    many = spark.range(200_001).selectExpr(
        "'a' as patient_id", "timestamp_ntz'2024-01-02 00:00:00' + make_dt_interval(0, 0, 0, id) as timestamp", "cast(id as double) as hr"
    )
    out = bins.resample(many, "raw", show_band=True, layout=ONE)
    assert out.columns == ["patient_id", "timestamp", "hr"] and out.count() == 200_001
    assert out.exceptAll(many).isEmpty()


def test_raw_guard_counts_non_null_readings(hr):
    data = hr(("a", "00:00:00", 1), ("a", "00:00:01", None), ("b", "00:00:00", 1), ("b", "00:00:01", 2))
    assert rows(bins.raw_guard(data, limit=1, layout=ONE), "patient_id", "points", "over_limit") == [
        ("a", 1, False), ("b", 2, True),
    ]


def test_unknown_options_raise(hr):
    with pytest.raises(ValueError):
        bins.resample(hr(), "1W", layout=ONE)
    with pytest.raises(ValueError):
        bins.resample(hr(), "1h", "sum", layout=ONE)


def test_empty_input_gives_empty_output(hr):
    for granularity in ("1h", "auto", "raw", "7min"):
        assert bins.resample(hr(), granularity, layout=ONE).count() == 0


def test_frame_without_the_signals_is_returned_as_it_is(hr):
    data = hr(("00:00:00", 1))
    assert bins.resample(data, "1h", signals=["spo2"], layout=ONE) is data


def test_bins_hold_every_reading_and_miss_no_bin(spark):
    rng = random.Random(1)
    start = dt.datetime(2024, 1, 2)
    data = [
        (rng.choice("abc"), start + dt.timedelta(seconds=rng.uniform(0, 9 * 86400)), 1.0)
        for _ in range(400)
    ]
    df = spark.createDataFrame(data, readings_schema(ONE))
    out = bins.resample(df, "1s", layout=ONE)
    # 9 days of seconds per patient: several blocks of the grid.
    per = {r[0]: r for r in out.groupBy("patient_id").agg(
        F.count("*").alias("n"), F.countDistinct("timestamp").alias("d"),
        F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"),
        F.count("hr").alias("filled"),
    ).collect()}
    for p in "abc":
        seconds = {t.replace(microsecond=0) for q, t, _ in data if q == p}
        assert per[p].n == per[p].d == (per[p].hi - per[p].lo).total_seconds() + 1
        assert (per[p].lo, per[p].hi, per[p].filled) == (min(seconds), max(seconds), len(seconds))


def test_grid_of_many_blocks(spark):
    spans = spark.sql(
        "select 'p' as id, timestamp_ntz'2024-01-01' as a, timestamp_ntz'2024-01-01 03:00:00' as b"
    )
    grid = bins.bin_grid(spans, ["id"], "a", "b", F.lit(MICROS), "bin")
    out = grid.agg(F.count("*"), F.countDistinct("bin"), F.min("bin"), F.max("bin")).head()
    assert tuple(out) == (10_801, 10_801, at("2024-01-01 00:00:00"), at("2024-01-01 03:00:00"))


@pytest.mark.parametrize("width, seconds", [("1min", 60), ("7min", 420)])
def test_dense_mean_around_1970_at_all_bits_of_a_run(spark, width, seconds):
    """Every bin once, with the mean of its values; rows without a value and entities of one row as well."""
    rng = random.Random(3)
    start = dt.datetime(1969, 12, 25)
    data = [("one", start, 5.0), ("none", start, None), ("none", start + dt.timedelta(hours=99), None)]
    data += [("a", start + dt.timedelta(seconds=60 * m + 7), float(m)) for m in range(64, 192)]  # two full runs
    data += [(rng.choice("bc"), start + dt.timedelta(seconds=rng.uniform(0, 14 * 86400)), rng.choice([None, 1.0, 2.5])) for _ in range(3000)]
    out = bins.resample(spark.createDataFrame(data, readings_schema(ONE)), width, layout=ONE).collect()
    got = {(r.patient_id, r.timestamp): r.hr for r in out}
    expected = {}
    for p in {row[0] for row in data}:
        own = [(int((t - start).total_seconds()) // seconds, v) for q, t, v in data if q == p]
        for i in range(min(i for i, _ in own), max(i for i, _ in own) + 1):
            expected[p, start + dt.timedelta(seconds=i * seconds)] = []
        for i, v in own:
            if v is not None:
                expected[p, start + dt.timedelta(seconds=i * seconds)].append(v)
    assert len(out) == len(got) and got.keys() == expected.keys()
    for at_bin, values in expected.items():
        assert got[at_bin] == (pytest.approx(sum(values) / len(values)) if values else None)


def test_quantiles_match_brute_force(spark):
    rng = random.Random(7)
    groups = {
        "hot": [rng.gauss(37, 0.3) for _ in range(3000)],
        "equal": [98.0] * 500,
        "mixed": [rng.choice([-1e9, -2.5, -0.0, 0.0, 1e-12, 3.0, 1e200]) for _ in range(301)],
        "one": [4.25],
        "two": [1.0, 2.0],
        "endless": [float("inf"), 1.0, 2.0, float("-inf")],
    }
    df = spark.createDataFrame(
        [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("two", None)],
        "g string, v double",
    )
    out = {r.g: r for r in group_quantiles(df, ["g"], "v", {"q10": 0.1, "q50": 0.5, "q90": 0.9}).collect()}
    assert set(out) == set(groups)
    for g, values in groups.items():
        assert out[g].q50 == pytest.approx(statistics.median(values), rel=1e-12, abs=1e-12)
        if g != "endless":
            expected = np.quantile(values, [0.1, 0.9])
            assert (out[g].q10, out[g].q90) == pytest.approx(tuple(expected), rel=1e-9, abs=1e-12)


def test_approximate_quantiles(spark):
    df = spark.range(1001).selectExpr("'g' as g", "cast(id as double) as v")
    assert group_quantiles(df, ["g"], "v", {"m": 0.5}, approx=True).head().m == pytest.approx(500, abs=1)


# Density.

DAY = (at("2024-01-07 00:00:00"), at("2024-01-07 23:59:59.999999"))


@pytest.fixture(scope="module")
def two_events(events_at):
    return events_at("2024-01-07 03:47:05", "2024-01-07 05:14:20")


def test_hourly_density_over_a_day(two_events):
    out = event_density(two_events, "hour", *DAY)
    assert out.count() == 24
    assert rows(out.where("count > 0"), "time_bin", "count", "density_per_hour") == [
        (at("2024-01-07 03:00:00"), 1, 1.0), (at("2024-01-07 05:00:00"), 1, 1.0),
    ]


def test_daily_density(two_events):
    out = event_density(two_events, "day", DAY[0], at("2024-01-08 23:59:59.999999"))
    assert rows(out, "time_bin", "count", "density_per_hour") == [
        (at("2024-01-07 00:00:00"), 2, 2 / 24), (at("2024-01-08 00:00:00"), 0, 0.0),
    ]


def test_density_without_range_runs_from_first_to_last_event(two_events):
    out = event_density(two_events, "hour")
    assert rows(out, "time_bin", "count") == [
        (at("2024-01-07 03:00:00"), 1), (at("2024-01-07 04:00:00"), 0), (at("2024-01-07 05:00:00"), 1),
    ]


def test_density_without_events(events_at, hr):
    patients = hr(("a", "00:00:00", 1), ("b", "00:00:00", 1))
    out = event_density(events_at(), "hour", *DAY, patients=patients)
    assert (out.count(), out.agg(F.sum("count")).head()[0]) == (48, 0)
    assert event_density(events_at(), "hour").count() == 0


def test_events_outside_the_axis_drop(events_at):
    out = event_density(events_at("2024-01-06 23:59:59", "2024-01-07 00:00:00"), "day", *DAY)
    assert rows(out, "count") == [(1,)]


def test_interval_events_count_at_their_start(spark):
    events = spark.sql(
        "select 'p' as patient_id, timestamp_ntz'2024-01-07 03:47:05' as seizure_start,"
        " timestamp_ntz'2024-01-07 09:00:00' as seizure_end"
    )
    assert rows(event_density(events, "hour"), "time_bin") == [(at("2024-01-07 03:00:00"),)]
