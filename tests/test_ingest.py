import pytest

from pyspark.sql import functions as F

from chartline.functions.text import parse_timestamp
from chartline.layout import EVENTS_SCHEMA, PATIENTS
from chartline.operators.select import filter_patient
from chartline.sources import ingest, tables
from conftest import at, rows


@pytest.fixture
def load(spark, tmp_path):
    def run(text, **options):
        (tmp_path / "upload.csv").write_text(text)
        return ingest.load_upload(spark, str(tmp_path / "upload.csv"), **options)

    return run


FLAGGED = """timestamp,patient_id,heart_rate,spo2,seizure
2024-01-02T10:00:00,001,75,98,0
2024-01-02T10:01:00,001,82,,1
2024-01-02T10:02:00,001,abc,94,true
"""


def test_flagged_upload(load):
    upload = load(FLAGGED)
    assert upload.readings.columns == ["patient_id", "timestamp", "spo2", "heart_rate"]
    assert rows(upload.readings, "patient_id", "timestamp", "spo2", "heart_rate") == [
        ("001", at("10:00:00"), 98.0, 75.0),
        ("001", at("10:01:00"), None, 82.0),
        ("001", at("10:02:00"), 94.0, None),
    ]
    assert rows(upload.events, "seizure_time", "seizure_type", "severity", "duration_seconds") == [
        (at("10:01:00"), "unknown", "unknown", None),
        (at("10:02:00"), "unknown", "unknown", None),
    ]
    assert upload.warnings == []


def test_upload_without_patient_id(load):
    upload = load("timestamp,heart_rate\n2024-01-02 10:00:00,75\n2024-01-02 10:00:00,76\n")
    assert rows(upload.readings, "patient_id", "heart_rate") == [("uploaded_patient", 75.0)]
    assert len(upload.warnings) == 2  # no event columns, default id
    assert upload.events.count() == 0
    assert "seizure_time" in upload.events.columns


def test_duplicates_keep_the_first_row_of_the_file(load):
    lines = "".join(f"2024-01-02 10:00:0{i % 3},p,{i}\n" for i in range(9))
    upload = load("timestamp,patient_id,heart_rate\n" + lines)
    assert rows(upload.readings, "heart_rate") == [(0.0,), (1.0,), (2.0,)]
    assert upload.report.head().asDict() == {
        "rows_read": 9, "blank_times": 0, "bad_times": 0, "duplicates": 6, "rows_kept": 3,
    }


def test_bad_and_blank_times_are_dropped_and_counted(load):
    text = "timestamp,patient_id,heart_rate\nx,p,1\n,p,2\n ,p,3\n1704189600,p,4\n"
    upload = load(text)
    assert rows(upload.readings, "timestamp", "heart_rate") == [(at("10:00:00"), 4.0)]
    report = upload.report.head()
    assert (report.blank_times, report.bad_times, report.rows_kept) == (2, 1, 1)
    with pytest.raises(ingest.DataValidationError):
        load(text, strict=True)


def test_blank_patient_ids_become_null(load):
    upload = load("timestamp,patient_id,heart_rate\n2024-01-02 10:00:00, ,1\n")
    assert rows(upload.readings, "patient_id") == [(None,)]


def test_interval_upload_wins_over_flags(load):
    upload = load(
        "timestamp,patient_id,heart_rate,seizure,seizure_start,seizure_end\n"
        "2024-01-02 10:00:00,p,1,1,2024-01-02 10:00:30,2024-01-02 10:01:00\n"
        "2024-01-02 10:05:00,p,2,1,2024-01-02 10:05:30,\n"
        "2024-01-02 10:10:00,p,3,1,,\n"
    )
    assert rows(upload.events, "seizure_time", "seizure_start", "seizure_end", "is_interval") == [
        (at("10:00:30"), at("10:00:30"), at("10:01:00"), True),
        (at("10:05:30"), at("10:05:30"), None, True),
    ]


def test_seizure_event_column(load):
    upload = load("timestamp,patient_id,seizure_event\n2024-01-02 10:00:00,p,1\n")
    assert upload.events.count() == 1
    assert upload.readings.columns == ["patient_id", "timestamp"]


def test_report_of_an_empty_upload(load):
    upload = load("timestamp,patient_id,heart_rate\n")
    assert upload.report.head().asDict() == {
        "rows_read": 0, "blank_times": 0, "bad_times": 0, "duplicates": 0, "rows_kept": 0,
    }


def test_validation():
    check = ingest.validate_columns
    assert "timestamp" in check(["patient_id", "spo2"]).error
    assert not check(["timestamp", "patient_id"]).valid
    assert "No event columns" in check(["timestamp", *PATIENTS.signals]).warnings[0]
    assert "No signal columns" in check(["timestamp", "seizure"]).warnings[0]
    assert check(["timestamp", "spo2", "seizure", "ward"]).warnings == [
        "Unknown columns are ignored: ward"
    ]
    only_start = check(["timestamp", "spo2", "seizure_start"])
    assert only_start.valid and "both ends" in only_start.warnings[0]


def test_only_one_interval_end_gives_no_events(load):
    upload = load("timestamp,spo2,seizure_start\n2024-01-02 10:00:00,1,2024-01-02 10:00:00\n")
    assert upload.events.count() == 0


def test_invalid_upload_raises(load):
    with pytest.raises(ingest.DataValidationError):
        load("time,spo2\n1,2\n")


def test_parquet_upload(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.sql(
        "select timestamp_ntz'2024-01-02 10:00:00.000001' as timestamp, 'p' as patient_id, 97.5D as spo2"
    ).write.parquet(path)
    upload = ingest.load_upload(spark, path, "parquet")
    assert rows(upload.readings, "timestamp", "spo2") == [(at("10:00:00.000001"), 97.5)]


def test_typed_upload_is_not_read_as_text(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.sql(
        "select timestamp_ntz'2024-01-02 10:00:00' as timestamp, 7 as patient_id, double('nan') as spo2,"
        " 80 as heart_rate, true as seizure union all"
        " select timestamp_ntz'2024-01-02 10:01:00', 7, 97.0D, 81, null"
    ).write.parquet(path)
    upload = ingest.load_upload(spark, path, "parquet")
    assert rows(upload.readings, "patient_id", "spo2", "heart_rate") == [("7", 97.0, 81.0), ("7", None, 80.0)]
    assert rows(upload.events, "seizure_time") == [(at("10:00:00"),)]


def test_epoch_numbers_in_a_typed_upload(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.sql("select 1705312200 as timestamp, 1.0D as spo2, 2 as seizure").write.parquet(path)
    upload = ingest.load_upload(spark, path, "parquet")
    assert rows(upload.events, "patient_id", "seizure_time") == [
        ("uploaded_patient", at("2024-01-15 09:50:00")),
    ]


def test_event_table_from_csv(spark, tmp_path):
    (tmp_path / "events.csv").write_text(
        "patient_id,seizure_time,seizure_type,severity,duration_seconds\n"
        "007,2024-01-02 10:00:00.5,focal,mild,42\n008,,absence,,\n"
    )
    out = tables.read_events(spark, str(tmp_path / "events.csv"), "csv")
    assert out.schema == EVENTS_SCHEMA
    assert rows(out, "patient_id", "seizure_time", "seizure_type", "duration_seconds") == [
        ("007", at("10:00:00.500000"), "focal", 42), ("008", None, "absence", None),
    ]


def test_readings_table_keeps_filters_at_the_scan(spark, tmp_path):
    path = str(tmp_path / "r")
    spark.sql(
        "select 'p' as patient_id, timestamp_ntz'2024-01-02 10:00:00' as timestamp, double('nan') as spo2"
    ).write.parquet(path)
    out = tables.read_readings(spark, path)
    assert out.columns == ["patient_id", "timestamp", "spo2"]
    assert rows(out, "spo2") == [(None,)]
    plan = filter_patient(out, "p")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(patient_id,p)" in plan


def test_offsets_and_epochs_agree(spark):
    texts = ["2024-01-15T10:00:00+05:00", "2024-01-15 05:00:00Z", "1705294800", "2024-01-15 05:00:00", "2024-01-15T06:00:00.5+01:00", "2024-01-15", "x+01:00"]
    kept = spark.conf.get("spark.sql.session.timeZone")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            df = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_timestamp(F.col("t")).cast("string").alias("t"))
            got = [r.t for r in df.collect()]
            zoned = spark.sql("select timestamp_micros(1705312200000000) as t")
            assert zoned.select(ingest.as_time(zoned, "t").cast("string").alias("t")).first().t == "2024-01-15 09:50:00"
        finally:
            spark.conf.set("spark.sql.session.timeZone", kept)
        assert got == ["2024-01-15 05:00:00"] * 4 + ["2024-01-15 05:00:00.5", "2024-01-15 00:00:00", None]


def test_csv_files_with_other_headers_raise_and_quotes_double(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.csv").write_text('timestamp,spo2,note\n2024-01-01 00:00:00,96,"a ""x"" b"\n')
    assert ingest.read_upload(spark, str(tmp_path / "a")).first().note == 'a "x" b'
    (tmp_path / "a" / "2.csv").write_text("timestamp,note,spo2\n2024-01-01 00:00:01,n,61\n")
    with pytest.raises(Exception):
        ingest.read_upload(spark, str(tmp_path / "a")).collect()
