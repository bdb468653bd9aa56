"""Column layout, fixed schemas and signal metadata shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Signal names, units, ranges and default limits.
SIGNAL_METADATA = {
    "spo2": {
        "name": "SpO2", "unit": "%", "normal_range": (95.0, 100.0),
        "critical_low": 90.0, "critical_high": None, "low": 92.0, "high": None,
    },
    "heart_rate": {
        "name": "Heart Rate", "unit": "bpm", "normal_range": (60.0, 100.0),
        "critical_low": None, "critical_high": 150.0, "low": None, "high": 140.0,
    },
    "temperature": {
        "name": "Temperature", "unit": "°C", "normal_range": (36.1, 37.2),
        "critical_low": None, "critical_high": 39.0, "low": None, "high": 38.0,
    },
    "blood_glucose": {
        "name": "Blood Glucose", "unit": "mg/dL", "normal_range": (70.0, 140.0),
        "critical_low": 54.0, "critical_high": 250.0, "low": 70.0, "high": 180.0,
    },
}

METADATA_SCHEMA = T.StructType([
    T.StructField("signal", T.StringType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("unit", T.StringType()),
    T.StructField("normal_low", T.DoubleType()),
    T.StructField("normal_high", T.DoubleType()),
    T.StructField("critical_low", T.DoubleType()),
    T.StructField("critical_high", T.DoubleType()),
])

LIMITS_SCHEMA = T.StructType([
    T.StructField("signal", T.StringType(), False),
    T.StructField("low", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
])

# Point and interval events share one schema; a field that does not apply is null.
EVENTS_SCHEMA = T.StructType([
    T.StructField("patient_id", T.StringType()),
    T.StructField("seizure_time", T.TimestampNTZType()),
    T.StructField("seizure_start", T.TimestampNTZType()),
    T.StructField("seizure_end", T.TimestampNTZType()),
    T.StructField("seizure_type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("duration_seconds", T.IntegerType()),
    T.StructField("is_interval", T.BooleanType()),
])


@dataclass(frozen=True)
class Layout:
    """Names the columns an operator works on.

    ``signals`` lists every signal column in display order. The default fits patient readings; any
    other table with an id, a timestamp and numeric columns works the same way.
    """

    entity: str = "patient_id"
    time: str = "timestamp"
    signals: tuple[str, ...] = tuple(SIGNAL_METADATA)
    event_time: str = "seizure_time"
    event_start: str = "seizure_start"
    event_end: str = "seizure_end"
    event_type: str = "seizure_type"
    severity: str = "severity"
    duration: str = "duration_seconds"
    interval_flag: str = "is_interval"

    def present(self, df: DataFrame, signals=None) -> list[str]:
        """Signals asked for that the frame really has, in layout order."""
        wanted = self.signals if signals is None else signals
        return [s for s in wanted if s in df.columns]

    def event_time_of(self, events: DataFrame) -> Column:
        """When an event happened: its own time, else its start, else null."""
        found = [F.col(c) for c in (self.event_time, self.event_start) if c in events.columns]
        if not found:
            return F.lit(None).cast("timestamp_ntz")
        return F.coalesce(*found)


PATIENTS = Layout()


def readings_schema(layout: Layout = PATIENTS) -> T.StructType:
    return T.StructType(
        [T.StructField(layout.entity, T.StringType()),
         T.StructField(layout.time, T.TimestampNTZType())]
        + [T.StructField(s, T.DoubleType()) for s in layout.signals]
    )


def metadata_table(spark: SparkSession) -> DataFrame:
    """One row per signal with its display name, unit and ranges."""
    rows = [
        (key, m["name"], m["unit"], *m["normal_range"], m["critical_low"], m["critical_high"])
        for key, m in SIGNAL_METADATA.items()
    ]
    return spark.createDataFrame(rows, METADATA_SCHEMA)


def limits_table(spark: SparkSession, limits: dict | None = None) -> DataFrame:
    """One row per signal with its low and high limit, from ``{signal: (low, high)}``."""
    if limits is None:
        limits = {key: (m["low"], m["high"]) for key, m in SIGNAL_METADATA.items()}
    rows = [
        (key, None if low is None else float(low), None if high is None else float(high))
        for key, (low, high) in limits.items()
    ]
    return spark.createDataFrame(rows, LIMITS_SCHEMA)
