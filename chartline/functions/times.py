"""Time arithmetic on zone-free timestamps, exact to the microsecond.

All arithmetic goes through whole microseconds since 1970, so results do not depend on the session
time zone and never pass through a float.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000
DAY_SECONDS = 86_400

# The granularities offered, and their widths in seconds.
GRANULARITY_SECONDS = {
    "1s": 1, "1min": 60, "5min": 300, "15min": 900, "1h": 3600, "6h": 21_600, "1D": 86_400,
}
# The density bins offered, and their widths in seconds.
DENSITY_BIN_SECONDS = {"hour": 3600, "day": 86_400}

_UNIT_SECONDS = {"s": 1, "min": 60, "h": 3600, "D": DAY_SECONDS}
_WIDTH = re.compile(r"\s*(\d+)\s*(s|min|h|D)\s*")


def ntz(value) -> Column:
    """Zone-free timestamp literal from a datetime or ISO string."""
    text = value.isoformat(sep=" ") if isinstance(value, dt.datetime) else str(value)
    return F.lit(text).cast("timestamp_ntz")


def _elapsed(start, end) -> Column:
    """Seconds between zone-free times as an exact decimal with microseconds.

    Subtracting keeps the times zone-free; ``timestamp_diff`` would read them in the session zone and
    be an hour off for times its summer-time change skips.
    """
    return (_column(end) - _column(start)).cast("interval second").cast("decimal(18,6)")


def _column(ts) -> Column:
    return F.col(ts) if isinstance(ts, str) else ts


def micros_between(start, end) -> Column:
    return (_elapsed(start, end) * MICROS).cast("bigint")


def seconds_between(start, end) -> Column:
    return _elapsed(start, end).cast("double")


def epoch_micros(ts) -> Column:
    return micros_between(ntz("1970-01-01 00:00:00"), ts)


def from_epoch_micros(micros) -> Column:
    return F.timestamp_add("MICROSECOND", micros, ntz("1970-01-01 00:00:00"))


def add_micros(ts, micros) -> Column:
    return F.timestamp_add("MICROSECOND", micros if isinstance(micros, Column) else F.lit(micros), ts)


def floor_micros(micros: Column, width: Column) -> Column:
    """Largest multiple of ``width`` not above ``micros``; correct before 1970 as well."""
    return micros - F.pmod(micros, width)


def floor_time(ts, width_seconds: int) -> Column:
    """Start of the bin holding ``ts``, counted from midnight when the width divides a day."""
    return from_epoch_micros(floor_micros(epoch_micros(ts), F.lit(width_seconds * MICROS)))


def time_bin(ts, seconds: float) -> Column:
    """Like ``floor_time`` but cheaper. Rows without a time drop, and a select may hold only one."""
    return F.window(ts, f"{round(seconds * MICROS)} microseconds")["start"]


def day_start(ts) -> Column:
    return floor_time(ts, DAY_SECONDS)


def width_seconds(granularity: str) -> int:
    """Width of a named or free granularity such as ``"7min"``; anything else raises."""
    if granularity in GRANULARITY_SECONDS:
        return GRANULARITY_SECONDS[granularity]
    match = _WIDTH.fullmatch(granularity)
    if not match or int(match.group(1)) == 0:
        raise ValueError(
            f"unknown granularity {granularity!r}: use raw, auto or a width in s, min, h or D"
        )
    return int(match.group(1)) * _UNIT_SECONDS[match.group(2)]


def divides_day(seconds: int) -> bool:
    return DAY_SECONDS % seconds == 0


def calendar_bounds(first: dt.date, last: dt.date | None = None) -> tuple[dt.datetime, dt.datetime]:
    """Inclusive time bounds covering whole calendar days; one date means that day."""
    last = first if last is None else last
    return (
        dt.datetime.combine(first, dt.time.min),
        dt.datetime.combine(last, dt.time.max),
    )
