"""Scalar functions for messy text input and for display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartline.functions.times import from_epoch_micros

# Fixed value: an epoch number at or above this is read as milliseconds, below as seconds.
EPOCH_MILLIS_FROM = 100_000_000_000
# Largest epoch in milliseconds that still falls in year 9999.
EPOCH_MILLIS_MAX = 253_402_300_799_999

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# A time text: a date in front, then if wanted a time of day down to any of its parts, then if wanted a zone.
_DATE = r"[+-]?[0-9]{4,}(?:-[0-9]{1,2}){0,2}"
_CLOCK = r"([0-9]{1,2})(?::([0-9]{1,2}))?(?::([0-9]{1,2}(?:\.[0-9]*)?))?"
_ZONE = r"(?i:z|utc|gmt|ut|(?:utc|gmt|ut)?[+-][0-9]{1,2}(?::?[0-9]{2}){0,2}|[a-z]+/[a-z_/]+)"
_LOCAL = rf"^{_DATE}([ T]{_CLOCK})?$"
_ZONED = rf"^({_DATE})[ T]{_CLOCK} ?({_ZONE})$"
_INFINITY = r"^[+-]?inf(inity)?$"


def number(text) -> Column:
    """Text to double; anything that is not a plain number becomes null, NaN included."""
    trimmed = F.trim(text)
    plain = trimmed.rlike(_NUMBER) | F.lower(trimmed).rlike(_INFINITY)
    return F.when(plain, trimmed.try_cast("double"))


def truthy(text) -> Column:
    """True for the word true or any number other than zero; everything else is false."""
    return F.coalesce((F.lower(F.trim(text)) == "true") | (number(text) != 0), F.lit(False))


def parse_timestamp(text) -> Column:
    """Text to a zone-free timestamp: epoch seconds or milliseconds if numeric, else ISO; bad is null.

    A text must begin with a date: a time of day alone is bad, not a time of today, and so is a zone that is not known.
    """
    trimmed = F.trim(text)
    epoch = trimmed.try_cast("decimal(30,6)")
    scale = F.when(F.abs(epoch) >= EPOCH_MILLIS_FROM, 1000).otherwise(1_000_000)
    micros = F.floor(epoch * scale).cast("bigint")
    from_epoch = F.when(F.abs(epoch) <= EPOCH_MILLIS_MAX, from_epoch_micros(micros))

    def part(group: int) -> Column:
        found = F.regexp_extract(trimmed, _ZONED, group)
        return F.when(found == "", F.lit("00")).otherwise(found)

    # With a zone of its own a text names an instant, which epochs are too: both become UTC.
    whole = F.concat(part(1), F.lit(" "), part(2), F.lit(":"), part(3), F.lit(":"), part(4), F.lit(" "), part(5))
    zoned = from_epoch_micros(F.unix_micros(whole.try_cast("timestamp")))
    return (
        F.when(trimmed.rlike(_NUMBER), from_epoch).when(trimmed.rlike(_LOCAL), trimmed.try_cast("timestamp_ntz"))
        .when(trimmed.rlike(_ZONED), zoned)
    )


def interval_label(seconds) -> Column:
    """Approximate sampling interval in words, such as "~5 minutes"; the count is cut, not rounded."""

    def counted(width: int, unit: str) -> Column:
        n = (seconds / width).cast("bigint")
        return F.concat(F.lit("~"), n.cast("string"), F.lit(f" {unit}"), F.when(n > 1, "s").otherwise(""))

    return (
        F.when(seconds < 2, "~1 second")
        .when(seconds < 120, counted(1, "second"))
        .when(seconds < 3600, counted(60, "minute"))
        .when(seconds < 86_400, counted(3600, "hour"))
        .when(seconds.isNotNull(), counted(86_400, "day"))
    )


def with_unit(value, unit: str) -> Column:
    """One-decimal display text. For reading only: keep the number itself for any further work."""
    return F.when(value.isNotNull(), F.format_string("%.1f %s", value, F.lit(unit)))


def context_title(name: str, window_minutes: int) -> str:
    return f"{name} (±{window_minutes}min)"
