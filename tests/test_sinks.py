import datetime as dt
from pathlib import Path

import pytest

from chartline.plans.timeline import patient_timeline
from chartline.sources import ingest, sinks, tables
from conftest import ONE, at, rows


@pytest.fixture
def data(hr):
    return hr(("b", "10:00:00.000001", 1), ("a", "10:01:00", 2), ("a", "10:00:00", None))


def test_per_patient_folders(spark, data, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_per_patient(data, path)
    folders = sorted(p.name for p in Path(path).iterdir() if p.is_dir())
    assert folders == ["patient_id=a", "patient_id=b"]
    assert spark.read.option("header", True).csv(path).count() == 3


def test_per_patient_without_rows_writes_no_folder(hr, tmp_path):
    path = tmp_path / "none"
    sinks.write_per_patient(hr(), str(path))
    assert not [p for p in path.iterdir() if p.is_dir()]


def test_combined_csv_round_trip_keeps_microseconds(spark, data, tmp_path):
    path = str(tmp_path / "all")
    sinks.write_combined(data, path)
    text = spark.read.option("header", True).csv(path)
    assert rows(text, "patient_id", "timestamp", "hr")[-1] == ("b", "2024-01-02 10:00:00.000001", "1.0")


def test_day_folders(spark, data, tmp_path):
    path = str(tmp_path / "days")
    sinks.write_by_day(data, path)
    assert [p.name for p in Path(path).iterdir() if p.is_dir()] == [f"{tables.DAY_FOLDER}=2024-01-02"]
    assert spark.read.parquet(path).count() == 3


def test_day_folders_outside_the_range_are_not_read(spark, hr, tmp_path):
    path = str(tmp_path / "days")
    sinks.write_by_day(hr(*[(f"2024-01-0{d} 10:00:00", d) for d in range(1, 6)]), path)
    out = tables.read_readings(
        spark, path, start=at("2024-01-02 11:00:00"), end=at("2024-01-04 10:00:00"), layout=ONE
    )
    assert rows(out, "hr") == [(3.0,), (4.0,)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull({tables.DAY_FOLDER}" in plan


def test_stored_upload(spark, tmp_path):
    (tmp_path / "u.csv").write_text("timestamp,spo2,seizure\n2024-01-02 10:00:00,97,1\n")
    upload = ingest.load_upload(spark, str(tmp_path / "u.csv"), store=str(tmp_path / 'cleaned'))
    assert (upload.readings.count(), upload.events.count()) == (1, 1)
    plan = upload.readings._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "cleaned" in plan and "FileScan csv" not in plan


def test_upload_ready_round_trip(spark, events_at, tmp_path):
    readings = spark.createDataFrame(
        [("p", at("10:00:00"), 97.0), ("p", at("10:01:00"), 96.0)],
        "patient_id string, timestamp timestamp_ntz, spo2 double",
    )
    path = str(tmp_path / "upload")
    sinks.write_upload_ready(readings, events_at("10:00:59"), path)
    upload = ingest.load_upload(spark, path)
    assert rows(upload.readings, "patient_id", "timestamp", "spo2") == rows(readings, "patient_id", "timestamp", "spo2")
    assert rows(upload.events, "patient_id", "seizure_time") == [("p", at("10:01:00"))]


def test_timeline(hr, events_at):
    data = hr(("p", "2024-01-02 00:00:00", 1), ("p", "2024-01-02 00:00:30", 3), ("p", "2024-01-03 00:00:00", 9),
              ("q", "2024-01-02 00:00:00", 7))
    events = events_at("2024-01-02 00:00:20", "2024-01-03 00:00:00", ("q", "2024-01-02 00:00:00"))
    view = patient_timeline(
        data, events, "p", dt.date(2024, 1, 2), granularity="1min", limits={"hr": (2, None)}, layout=ONE
    )
    assert rows(view.series, "timestamp", "hr") == [(at("00:00:00"), 2.0)]
    assert rows(view.stats, "mean", "count") == [(2.0, 2)]
    assert rows(view.profile, "median_interval_seconds") == [(30.0,)]
    assert rows(view.rates, "total_count", "per_day") == [(1, pytest.approx(1.0))]
    assert (view.density.count(), view.density.where("count > 0").count()) == (24, 1)
    # Markers sit on the resampled series.
    assert rows(view.markers, "nearest_time", "value") == [(at("00:00:00"), 2.0)]
    assert rows(view.breaches, "value") == [(1.0,)]
    assert rows(view.table, "event_time", "hr_mean") == [(at("00:00:20"), 2.0)]
    assert view.intervals.count() == 0
    assert rows(view.cards, "mean", "total_count", "per_day") == [(2.0, 1, 1.0)]
    # These events have no type column, so there is nothing to count.
    assert view.types.count() == 0


def test_by_day_keeps_intervals_without_a_time_and_own_day_columns(spark, tmp_path):
    events = spark.sql("""select 'p' as patient_id, cast(null as timestamp_ntz) as seizure_time, timestamp_ntz'2024-01-03 01:00:00' as seizure_start
        union all select 'p', timestamp_ntz'2024-01-03 02:00:00', null""")
    sinks.write_by_day(events, str(tmp_path / "e"))
    range_ = (dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 3, 23))
    assert tables.read_events(spark, str(tmp_path / "e"), start=range_[0], end=range_[1]).count() == 2
    spark.sql("select 'p' as patient_id, timestamp_ntz'2024-01-03 01:00:00' as timestamp, 1.0D as spo2, 'Tuesday' as day").write.parquet(str(tmp_path / "r"))
    assert tables.read_readings(spark, str(tmp_path / "r"), start=range_[0], end=range_[1]).count() == 1


def test_sinks_leave_the_number_of_tasks_open(spark, tmp_path):
    import inspect

    assert "task_count" not in inspect.getsource(sinks)
