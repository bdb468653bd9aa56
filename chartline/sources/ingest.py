"""Reading uploads that hold signal readings and event markers in one table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartline.functions.text import number, parse_timestamp, truthy
from chartline.functions.times import from_epoch_micros
from chartline.layout import EVENTS_SCHEMA, PATIENTS, Layout
from chartline.operators.combine import dedupe_readings, union_patients

# Upload columns besides the signals, and the id given to uploads without one.
REQUIRED_COLUMNS = ("timestamp",)
EVENT_COLUMNS = ("seizure", "seizure_event", "seizure_start", "seizure_end")
FLAG_COLUMNS = ("seizure", "seizure_event")
DEFAULT_PATIENT = "uploaded_patient"
UNKNOWN = "unknown"

ORDINAL = "_ordinal"

# Quotes inside a quoted field are doubled; a file whose header differs from the first one's is an error,
# as Spark reads the columns of all files of a scan by position.
CSV_OPTIONS = {"header": "true", "escape": '"', "enforceSchema": "false"}


class DataValidationError(ValueError):
    """The upload cannot be used."""


@dataclass
class SchemaCheck:
    valid: bool
    error: str | None = None
    warnings: list[str] = field(default_factory=list)


@dataclass
class Upload:
    """Cleaned readings and events of an upload, its warnings, and a one-row report of row counts."""

    readings: DataFrame
    events: DataFrame
    warnings: list[str]
    report: DataFrame


def _files_by_header(spark: SparkSession, path) -> dict[str, list[str]]:
    """The files of each first line. Only the first split of a file is read for it; the driver gets a row for each file."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value",
        F.monotonically_increasing_id().alias("line"),
    )
    firsts = lines.where("start = 0").groupBy("file").agg(F.min_by("value", "line").alias("header"))
    groups: dict[str, list[str]] = {}
    for file, header in sorted(tuple(r) for r in firsts.collect()):
        groups.setdefault(header.rstrip("\r"), []).append(file)
    if not groups:
        raise DataValidationError(f"no file with a header in {path!r}")
    return groups


def read_upload(spark: SparkSession, path, fmt: str = "csv", multi_line: bool = False, by_header: bool = False) -> DataFrame:
    """The raw table plus an ordinal that follows file and row order. CSV columns stay text.

    ``multi_line`` allows line breaks inside quoted CSV fields; a file is then read by one task. ``by_header`` allows CSV
    files of unlike headers: files are grouped by their first line, each group is one scan, and columns meet by name;
    a column that a file lacks is null there.
    """
    if by_header and fmt == "csv":
        groups = _files_by_header(spark, path).values()
        return union_patients([read_upload(spark, files, fmt, multi_line) for files in groups])
    options = CSV_OPTIONS | {"multiLine": str(multi_line).lower()} if fmt == "csv" else {}
    raw = spark.read.options(**options).format(fmt).load(path)
    return raw.select(
        *(F.col(f"`{c}`") for c in raw.columns),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias(ORDINAL),
    )


def validate_columns(columns: list[str], layout: Layout = PATIENTS) -> SchemaCheck:
    """Check column names alone; no data is read."""
    columns = [c for c in columns if c != ORDINAL]
    missing = [c for c in REQUIRED_COLUMNS if c not in columns]
    if missing:
        return SchemaCheck(False, f"Missing required columns: {', '.join(missing)}")
    signals = [c for c in layout.signals if c in columns]
    markers = [c for c in EVENT_COLUMNS if c in columns]
    if not signals and not markers:
        expected = ", ".join((*layout.signals, *EVENT_COLUMNS))
        return SchemaCheck(False, f"No signal or event columns found; expected at least one of: {expected}")
    check = SchemaCheck(True)
    if not signals:
        check.warnings.append("No signal columns found; only events are available.")
    if not markers:
        check.warnings.append("No event columns found; there will be no events.")
    known = {*REQUIRED_COLUMNS, layout.entity, *layout.signals, *EVENT_COLUMNS}
    unknown = [c for c in columns if c not in known]
    if unknown:
        check.warnings.append(f"Unknown columns are ignored: {', '.join(unknown)}")
    ends = [c for c in ("seizure_start", "seizure_end") if c in columns]
    if len(ends) == 1 and not any(c in columns for c in FLAG_COLUMNS):
        check.warnings.append(f"Only {ends[0]} is given; intervals need both ends, so there are no events.")
    return check


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.typeName()


def as_time(df: DataFrame, name: str) -> Column:
    """A column as zone-free time: zoned timestamps in UTC, zone-free ones as they are, text and numbers parsed."""
    if _kind(df, name) == "timestamp":
        return from_epoch_micros(F.unix_micros(F.col(name)))
    if _kind(df, name) == "timestamp_ntz":
        return F.col(name)
    return parse_timestamp(F.col(name).cast("string"))


def as_number(df: DataFrame, name: str) -> Column:
    """A column as double with null for anything that is not a number, NaN included."""
    if _kind(df, name) == "string":
        return number(F.col(name))
    return F.nanvl(F.col(name).cast("double"), F.lit(None))


def as_flag(df: DataFrame, name: str) -> Column:
    """A column as a flag: booleans as they are, numbers other than zero, text as ``truthy`` reads it."""
    kind = _kind(df, name)
    if kind == "string":
        return truthy(F.col(name))
    if kind == "boolean":
        return F.coalesce(F.col(name), F.lit(False))
    return F.coalesce(as_number(df, name) != 0, F.lit(False))


def parse_upload(raw: DataFrame, layout: Layout = PATIENTS) -> DataFrame:
    """Default id if there is none, blank ids to null, and the time parsed. Bad times become null."""
    text = F.trim(F.col(layout.entity).cast("string"))
    entity = F.when(text != "", text) if layout.entity in raw.columns else F.lit(DEFAULT_PATIENT)
    return raw.withColumns(
        {
            layout.entity: entity,
            "_raw_time": F.col("timestamp"),
            layout.time: as_time(raw, "timestamp"),
        }
    )


def clean_upload(parsed: DataFrame, order_by=None, layout: Layout = PATIENTS) -> DataFrame:
    """Rows with a usable time, the first per entity and time in file order (or ``order_by``).

    Rows without a time collapse with the duplicates and drop at the end: a filter on the time itself
    would be pushed below the parsing and have every text parsed twice.
    """
    marked = parsed.withColumn("_usable", F.col(layout.time).isNotNull())
    return dedupe_readings(marked, order_by or [ORDINAL], layout).where("_usable").drop("_usable")


def extract_readings(df: DataFrame, layout: Layout = PATIENTS) -> DataFrame:
    """Known signal columns as doubles; what is not a number becomes null."""
    return df.select(
        layout.entity, layout.time, *(as_number(df, s).alias(s) for s in layout.present(df))
    )


def _events(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    return df.select(
        *(
            fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in EVENTS_SCHEMA.fields
        )
    )


def extract_point_events(df: DataFrame, flag: str, layout: Layout = PATIENTS) -> DataFrame:
    """An event at every row whose flag is set."""
    return _events(
        df.where(as_flag(df, flag)),
        {
            "patient_id": F.col(layout.entity),
            "seizure_time": F.col(layout.time),
            "seizure_type": F.lit(UNKNOWN),
            "severity": F.lit(UNKNOWN),
            "is_interval": F.lit(False),
        },
    )


def extract_interval_events(df: DataFrame, layout: Layout = PATIENTS) -> DataFrame:
    """An interval for every row with a usable start; its time is the start."""
    start = as_time(df, "seizure_start")
    return _events(
        df.where(start.isNotNull()),
        {
            "patient_id": F.col(layout.entity),
            "seizure_time": start,
            "seizure_start": start,
            "seizure_end": as_time(df, "seizure_end"),
            "seizure_type": F.lit(UNKNOWN),
            "severity": F.lit(UNKNOWN),
            "is_interval": F.lit(True),
        },
    )


def extract_events(df: DataFrame, layout: Layout = PATIENTS) -> DataFrame:
    """Events by the columns present: intervals first, then either flag column, else none."""
    if "seizure_start" in df.columns and "seizure_end" in df.columns:
        return extract_interval_events(df, layout)
    for flag in FLAG_COLUMNS:
        if flag in df.columns:
            return extract_point_events(df, flag, layout)
    return df.sparkSession.createDataFrame([], EVENTS_SCHEMA)


def ingest_report(parsed: DataFrame, layout: Layout = PATIENTS) -> DataFrame:
    """One row: rows read, rows without a time, rows with a bad time, duplicates and rows kept."""
    blank = F.coalesce(F.trim(F.col("_raw_time").cast("string")) == "", F.lit(True))
    usable = F.col(layout.time).isNotNull()
    per_key = parsed.groupBy(layout.entity, layout.time).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(blank).alias("_blank")
    )
    return per_key.agg(
        F.sum("_n").alias("rows_read"),
        F.sum("_blank").alias("blank_times"),
        F.sum(F.when(~usable, F.col("_n") - F.col("_blank")).otherwise(0)).alias("bad_times"),
        F.sum(F.when(usable, F.col("_n") - 1).otherwise(0)).alias("duplicates"),
        F.count_if(usable).alias("rows_kept"),
    ).na.fill(0)


def load_upload(
    spark: SparkSession,
    path,
    fmt: str = "csv",
    strict: bool = False,
    store: str | None = None,
    layout: Layout = PATIENTS,
    multi_line: bool = False,
    by_header: bool = False,
) -> Upload:
    """Read, check and clean an upload. ``strict`` fails on the first unusable time instead of skipping it.

    Readings and events both come from the cleaned rows; with ``store``, a path that all executors share,
    those are written there once as Parquet and read again, so that using both does not clean twice. ``multi_line``
    and ``by_header`` are those of ``read_upload``.
    """
    raw = read_upload(spark, path, fmt, multi_line, by_header)
    check = validate_columns(raw.columns, layout)
    if not check.valid:
        raise DataValidationError(check.error)
    warnings = list(check.warnings)
    if layout.entity not in raw.columns:
        warnings.append(f"No {layout.entity} column found; using {DEFAULT_PATIENT!r}.")
    parsed = parse_upload(raw, layout)
    if strict:
        given = F.trim(F.col("_raw_time").cast("string")) != ""
        bad = parsed.where(F.col(layout.time).isNull() & given)
        first = bad.select("_raw_time").head()
        if first:
            raise DataValidationError(f"Cannot read time {first[0]!r}; expected ISO or Unix epoch.")
    rows = clean_upload(parsed, layout=layout)
    if store:
        rows.write.parquet(store)
        rows = spark.read.parquet(store)
    return Upload(
        extract_readings(rows, layout), extract_events(rows, layout), warnings,
        ingest_report(parsed, layout),
    )
