"""Reading tables that are already split into readings and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartline.functions.times import ntz
from chartline.layout import EVENTS_SCHEMA, PATIENTS, Layout, readings_schema
from chartline.operators.select import filter_time_range
from chartline.sources.ingest import CSV_OPTIONS, as_flag, as_number, as_time


# The partition column of write_by_day; no column of the data is taken for it.
DAY_FOLDER = "chartline_day"


def _scan(spark: SparkSession, path, fmt: str) -> DataFrame:
    return spark.read.options(**(CSV_OPTIONS if fmt == "csv" else {})).format(fmt).load(path)


def _typed(df: DataFrame, field) -> Column:
    kind = field.dataType.typeName()
    if field.name not in df.columns:
        return F.lit(None).cast(field.dataType)
    if kind == "timestamp_ntz":
        return as_time(df, field.name)
    if kind == "double":
        return as_number(df, field.name)
    if kind == "integer":
        return as_number(df, field.name).cast("int")
    if kind == "boolean":
        return as_flag(df, field.name)
    return F.col(field.name).cast(field.dataType)


def _within_days(df: DataFrame, start, end) -> DataFrame:
    """Skip the day folders of ``write_by_day`` that lie outside the range."""
    if start is None or DAY_FOLDER not in df.columns:
        return df
    return df.where(F.col(DAY_FOLDER).between(F.to_date(ntz(start)), F.to_date(ntz(end))))


def read_readings(
    spark: SparkSession, path, fmt: str = "parquet", start=None, end=None, layout: Layout = PATIENTS
) -> DataFrame:
    """Readings in the fixed column types, of a time range if given. Signals the table lacks are left out.

    Typed ids and times pass through unchanged, so filters on them reach the scan.
    """
    df = _within_days(_scan(spark, path, fmt), start, end)
    fields = [f for f in readings_schema(layout).fields if f.name in df.columns]
    out = df.select(*(_typed(df, f).alias(f.name) for f in fields))
    return out if start is None else filter_time_range(out, start, end, layout)


def read_events(
    spark: SparkSession, path, fmt: str = "parquet", start=None, end=None
) -> DataFrame:
    """Point or interval events in the shared event schema; columns the table lacks are null."""
    df = _within_days(_scan(spark, path, fmt), start, end)
    out = df.select(*(_typed(df, f).alias(f.name) for f in EVENTS_SCHEMA.fields))
    return out if start is None else filter_time_range(out, start, end)
