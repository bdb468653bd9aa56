"""Feeds through one exchange, files of bounded size, rows that carry their order, uploads of unlike headers."""

import datetime as dt
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chartline.functions import text
from chartline.layout import Layout
from chartline.operators import bins, combine, density, nearest, profile, summaries
from chartline.operators.quantiles import group_quantiles
from chartline.plans import event_queries as eq
from chartline.plans.timeline import patient_timeline
from chartline.sources import ingest, sinks
from conftest import ONE, at, rows

SF = "/root/testdata/sf0.001"


def plan_of(df, part):
    df.collect()
    final, _, initial = df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")
    return final if part == "final" else initial or final


def feed(spark, name, *values):
    full = [("p", at("10:00:00"), v) if not isinstance(v, tuple) else v for v in values]
    return spark.createDataFrame(full, f"patient_id string, timestamp timestamp_ntz, {name} double")


def chained(feeds):
    out = feeds[0]
    for other in feeds[1:]:
        out = out.join(other, ["patient_id", "timestamp"], "full")
    return out


@pytest.mark.parametrize("hot_rows", [combine.HOT_ROWS, 1])
def test_feeds_multiply_as_full_joins_do(spark, hot_rows):
    other = at("11:00:00")
    feeds = [
        feed(spark, "a", 1.0, 2.0, ("q", other, 3.0), (None, other, 4.0), ("q", None, None)),
        feed(spark, "b", 5.0, 6.0, 6.0, (None, other, 7.0)),
        feed(spark, "c", 8.0, ("q", other, None), ("q", other, 9.0), ("r", other, 1.0)),
    ]
    got = rows(combine.combine_feeds(feeds, hot_rows=hot_rows), "patient_id", "timestamp", "a", "b", "c")
    assert got == rows(chained(feeds), "patient_id", "timestamp", "a", "b", "c")
    assert sum(r[0] == "p" for r in got) == 2 * 3 * 1
    one = rows(combine.combine_feeds(feeds[:1], hot_rows=hot_rows), "a")
    assert one == rows(feeds[0], "a")
    assert combine.combine_feeds([f.limit(0) for f in feeds], hot_rows=hot_rows).collect() == []


def test_a_hot_key_is_dealt_out(spark):
    many = spark.range(5000).select(F.lit("p").alias("patient_id"), F.lit(at("10:00:00")).cast("timestamp_ntz").alias("timestamp"), F.col("id").cast("double").alias("a"))
    met = combine.combine_feeds([many, feed(spark, "b", 1.0, 2.0)], hot_rows=100)
    assert met.count() == 10_000 and met.distinct().count() == 10_000


def test_feeds_go_through_one_exchange(spark):
    plan = plan_of(combine.combine_feeds(eq.feeds(spark, SF), layout=eq.USERS), "final")
    assert len(re.findall(r"Exchange hashpartitioning\(user_id#\d+L, ts#\d+, _part", plan)) == 1 and "SortMergeJoin" not in plan


def test_packed_files_are_bounded(spark, tmp_path):
    small = spark.range(10_000).select(F.concat(F.lit("e"), F.col("id")).alias("patient_id"), F.lit(at("10:00:00")).cast("timestamp_ntz").alias("timestamp"), F.lit(1.0).alias("hr"))
    hot = spark.range(12_000).select(F.lit("hot").alias("patient_id"), F.timestamp_add("SECOND", F.col("id").cast("int"), F.lit(at("10:00:00")).cast("timestamp_ntz")).alias("timestamp"), F.col("id").cast("double").alias("hr"))
    path = str(tmp_path / "packed")
    sinks.write_packed(small.unionByName(hot), path, layout=ONE, file_rows=2000)
    files = [p for p in Path(path).iterdir() if p.name.startswith("part-")]
    sizes = [spark.read.parquet(str(p)).count() for p in files]
    assert sum(sizes) == 22_000 and max(sizes) <= 2000 and len(files) < 30
    manifest = spark.read.parquet(f"{path}/{sinks.MANIFEST}")
    assert manifest.agg(F.sum("rows")).first()[0] == 22_000 and manifest.where("patient_id = 'hot'").count() >= 6
    assert spark.read.parquet(path).count() == 22_000
    one = sinks.read_packed(spark, path, ["e77"])
    assert one.count() == 1 and len(one.inputFiles()) == 1
    assert sinks.read_packed(spark, path, ["nobody"]).count() == 0
    again = sinks.read_numbered(spark, path)
    assert [r[0] for r in again.where("patient_id = 'hot'").orderBy("ordinal").select("hr").collect()] == [float(k) for k in range(12_000)]
    assert again.agg(F.min("ordinal"), F.max("ordinal"), F.count_distinct("ordinal")).first() == (1, 22_000, 22_000)


def test_packed_csv(spark, hr, tmp_path):
    path = str(tmp_path / "csv")
    sinks.write_packed(hr(("b", "10:00:00.000001", 1), ("a", "10:01:00", 2), ("a", "10:00:00", None)), path, "csv", layout=ONE, file_rows=1)
    assert rows(sinks.read_packed(spark, path, ["b"], "csv"), "timestamp") == [("2024-01-02 10:00:00.000001",)]
    assert spark.read.parquet(f"{path}/{sinks.MANIFEST}").count() == 3


def test_order_is_in_the_rows(spark):
    data = spark.createDataFrame(
        [("b", at("10:00:00"), 1), ("a", at("10:01:00"), 2), ("a", at("10:00:00"), 4), ("a", at("10:00:00"), 3), (None, None, 5)],
        "patient_id string, timestamp timestamp_ntz, row int",
    )
    out = sinks.numbered(data, ties=("row",)).orderBy("ordinal").select("ordinal", "row").collect()
    assert [tuple(r) for r in out] == [(1, 5), (2, 3), (3, 4), (4, 2), (5, 1)]
    assert sinks.numbered(data.limit(0)).collect() == []


def test_type_counts_carry_their_order(spark):
    events = spark.createDataFrame([("p", t) for t in ("b", "a", "c", "c", None)] + [("q", None), (None, "a")], "patient_id string, seizure_type string")
    assert rows(summaries.event_type_ranks(events), "seizure_type", "count", "rank") == [("a", 1, 2), ("b", 1, 3), ("c", 2, 1)]
    found = summaries.event_type_map(events)
    assert rows(found.select("patient_id", F.to_json("type_counts").alias("text")), "patient_id", "text") == [("p", '{"c":2,"a":1,"b":1}')]


def test_uploads_of_unlike_headers(spark, tmp_path):
    (tmp_path / "1.csv").write_text("timestamp,spo2,note\n2024-01-01 00:00:00,96,x\n")
    (tmp_path / "2.csv").write_text("timestamp,note,spo2\n2024-01-01 00:00:01,n,61\n")
    (tmp_path / "3.csv").write_text("patient_id,timestamp,spo2,seizure\np,2024-01-01 00:00:02,62,1\n")
    (tmp_path / "4.csv").write_text("timestamp,spo2,note\r\n2024-01-01 00:00:03,97,x\r\n")
    raw = ingest.read_upload(spark, str(tmp_path), by_header=True)
    assert rows(raw, "timestamp", "spo2", "note", "patient_id") == [
        ("2024-01-01 00:00:00", "96", "x", None), ("2024-01-01 00:00:01", "61", "n", None),
        ("2024-01-01 00:00:02", "62", None, "p"), ("2024-01-01 00:00:03", "97", "x", None),
    ]
    upload = ingest.load_upload(spark, str(tmp_path), by_header=True)
    assert rows(upload.readings, "spo2") == [(61.0,), (62.0,), (96.0,), (97.0,)] and upload.events.count() == 1


def test_upload_with_line_breaks(spark, tmp_path):
    (tmp_path / "u.csv").write_text('timestamp,spo2,note\n2024-01-01 00:00:00,96,"a\nb"\n2024-01-01 00:00:01,97,c\n')
    upload = ingest.load_upload(spark, str(tmp_path / "u.csv"), multi_line=True)
    assert rows(upload.readings, "spo2") == [(96.0,), (97.0,)]


@pytest.mark.parametrize("given, value", [
    ("10:00:00Z", None), ("T10:00:00Z", None), ("10:00", None), ("2024-01-01T10:00:00EST", None), ("now", None),
    ("2024-01-01 10:00+05", at("2024-01-01 05:00:00")), ("2024-01-01T10+05:00", at("2024-01-01 05:00:00")),
    ("2024-01-01T10", at("2024-01-01 10:00:00")), ("2024-01-01 10:00:00.5 UTC", at("2024-01-01 10:00:00.500000")),
    ("2024-01-01 10:00:00 Europe/Berlin", at("2024-01-01 09:00:00")), ("2024-1-5", at("2024-01-05 00:00:00")),
])
def test_time_texts_begin_with_a_date(spark, given, value):
    assert spark.range(1).select(text.parse_timestamp(F.lit(given))).first()[0] == value


def test_close_values_beside_an_outlier(spark):
    """A million values that share a band, one far away, one group of a single row: exact, also where ranks are divided."""
    close = spark.range(1_000_000).selectExpr("'close' AS g", "1000 + (id * 7919 % 1000000) * 1e-9 AS v")
    data = close.union(spark.createDataFrame([("close", 1e15), ("one", 4.0)], "g string, v double"))
    out = {r.g: r for r in group_quantiles(data, ["g"], "v", {"m": 0.5, "p90": 0.9}, mean="average").collect()}
    assert out["close"].m == pytest.approx(1000 + 500_000e-9, abs=1e-12) and out["close"].p90 == pytest.approx(1000 + 900_000e-9, abs=1e-12)
    assert out["close"].average == pytest.approx((1e15 + 1e9 + 499.9995) / 1_000_001, rel=1e-9)
    assert (out["one"].m, out["one"].p90, out["one"].average) == (4.0, 4.0, 4.0)


def test_groups_of_single_values_need_no_second_division(spark):
    plan = plan_of(profile.signal_stats(eq.readings(spark, SF), layout=eq.USERS), "final")
    assert "_part" not in plan and plan.count("FileScan") == 2


def test_band_and_mean_come_from_one_scan(spark):
    plan = plan_of(bins.resample(eq.readings(spark, SF), "1D", show_band=True, layout=eq.USERS), "final")
    assert plan.count("FileScan") == 2 and "Join" not in plan  # the values, and the spans of the grid


def test_forward_fill_exchanges(spark):
    df = bins.resample(eq.readings(spark, SF), "6h", "median", show_band=True, ffill=True, layout=eq.USERS)
    shuffles = set(re.findall(r"Exchange (?:hash|range)partitioning[^\n]*plan_id=(\d+)", plan_of(df, "final")))
    assert len(shuffles) <= 7


def test_series_of_one_bin_and_blocks_of_many(spark, hr):
    many = hr(("2024-01-01 00:00:00", 1), ("2024-01-03 12:00:00", 3))
    out = bins.resample(many, "1s", "median", ffill=True, layout=ONE).orderBy("timestamp").collect()
    assert len(out) == 2 * 86_400 + 43_201 and {r.hr for r in out[:-1]} == {1.0} and out[-1].hr == 3.0
    odd = bins.resample(many, "7min", "median", ffill=True, layout=ONE).orderBy("timestamp").collect()
    assert len(odd) == 515 and odd[-1].timestamp == at("2024-01-03 11:58:00") and odd[-1].hr == 3.0
    one = bins.resample(hr(("2024-01-01 05:03:00", 2)), "7min", "median", show_band=True, layout=ONE).collect()
    assert [tuple(r) for r in one] == [("p", at("2024-01-01 05:01:00"), 2.0, 2.0, 2.0)]


# Views of one patient


def test_events_without_readings_nearby(spark, hr, events_at):
    readings, events = hr(("2024-01-05 00:00:00", 1.0)), events_at("2024-01-01 10:30:00")
    view = patient_timeline(readings, events, "p", dt.date(2024, 1, 1), layout=ONE)
    counts = view.density.orderBy("time_bin").collect()
    assert len(counts) == 24 and sum(r["count"] for r in counts) == 1
    assert [tuple(r) for r in view.cards.collect()] == [("p", "hr", None, None, None, 1, 1.0)]
    assert view.rates.first().total_count == 1


def test_days_come_from_the_bounds(spark, hr, events_at):
    readings = hr(("2024-01-02 23:00:00", 1.0), ("2024-01-04 01:00:00", None), ("q", "2024-02-01 00:00:00", 1.0))
    view = patient_timeline(readings, events_at("2024-01-03 00:00:00", "2024-01-05 00:00:00"), "p", layout=ONE)
    assert tuple(view.bounds.first()) == ("p", dt.date(2024, 1, 2), dt.date(2024, 1, 4))
    assert rows(view.signals, "signal", "available") == [("hr", True)]
    assert view.events.count() == 1 and view.density.count() == 72
    with pytest.raises(ValueError):
        patient_timeline(readings, events_at(), "nobody", layout=ONE)


def test_no_event_is_on_the_axis_of_another(spark, events_at):
    axis = spark.createDataFrame([("q",)], "patient_id string")
    found = density.event_density(events_at("10:00:00"), "day", at("2024-01-02 00:00:00"), at("2024-01-02 23:00:00"), axis, Layout())
    assert rows(found, "patient_id", "count") == [("q", 0)]


def test_nearest_scans_readings_once(spark):
    plan = plan_of(eq.QUERIES["nearest_reading"](spark, SF), "final")
    assert plan.count("FileScan") <= 3 and len(re.findall(r"FileScan parquet \[ts#\d+,user_id#\d+L,event_type#\d+,value#\d+\]", plan)) == 1


def test_first_value_wins_at_equal_times(spark, events_at):
    data = spark.createDataFrame(
        [("p", at("10:00:00"), 5.0, 3), ("p", at("10:00:00"), 6.0, 2), ("p", at("10:00:00"), None, 1), ("p", at("09:00:00"), 1.0, 9)],
        "patient_id string, timestamp timestamp_ntz, hr double, row int",
    )
    for seconds in (60, 3600, 86_400):
        near = nearest.nearest_reading(data, events_at("10:10:00", "23:00:00"), layout=ONE, order_by="row", chunk_seconds=seconds)
        assert rows(near, "value", "distance_seconds") == [(6.0, 46_800.0), (6.0, 600.0)]


@pytest.mark.parametrize("seconds", [60, 900, 7200])
def test_nearest_as_by_brute_force(spark, hr, events_at, seconds):
    draw = random.Random(seconds)
    start = at("2024-01-01 00:00:00")
    moments = sorted({start + dt.timedelta(seconds=draw.randrange(200_000)) for _ in range(150)})
    values = [(t, None if draw.random() < 0.3 else float(k)) for k, t in enumerate(moments)]
    asked = [start + dt.timedelta(seconds=draw.randrange(-5000, 210_000)) for _ in range(80)]
    data = spark.createDataFrame([("p", t, v) for t, v in values], "patient_id string, timestamp timestamp_ntz, hr double")
    near = nearest.nearest_reading(data, spark.createDataFrame([("p", t) for t in asked], "patient_id string, seizure_time timestamp_ntz"), layout=ONE, chunk_seconds=seconds)
    want = {t: min(((abs((t - u).total_seconds()), u, v) for u, v in values if v is not None))[1:] for t in asked}
    assert {r.event_time: (r.nearest_time, r.value) for r in near.collect()} == want
