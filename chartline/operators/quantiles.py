"""Exact grouped quantiles that stay distributed for groups of any size.

The built-in exact percentile keeps every distinct value of a group in one task. Here a group is
split by value instead. Equal values are counted before the shuffle, and the counts are summed over
value bands. A running count over the bands of a group finds those that hold a wanted rank. A band that
holds a single value, as nearly all do in groups of usual size or resolution, is an answer already;
everything below is then empty, and runtime re-planning drops it. The others are divided again,
evenly between the least and the greatest value that they really hold, and only parts with a wanted rank
are ranked row by row. The first division follows the size of the values, whatever their spread; the
second follows their spread, whatever their size: an outlier leaves close values their own band, and
values far from zero are split too. The result is the same linear interpolation between ranks.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bands per doubling of the value, so one band spans about 0.004 % of it.
_BANDS = 1 << 14
# Parts of a band that holds several values and a wanted rank.
_PARTS = 4096

# Coarse whole-number band of a double, never decreasing as the value grows; infinity included. The offset puts the
# band of the smallest positive double above zero, and the cut stands above that of the largest.
_SIZE = f"floor(least(log2(abs(_value)) * {_BANDS}, {1025.0 * _BANDS}D)) + {1100 * _BANDS}L"
# Never null, and said so: a filter that a join infers on one side only would keep both uses of the counts from sharing a shuffle.
_BAND = f"coalesce(CASE WHEN _value > 0 THEN {_SIZE} WHEN _value < 0 THEN -({_SIZE}) END, 0L)"


def group_quantiles(
    df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], approx: bool = False, mean: str | None = None
) -> DataFrame:
    """Quantiles of ``value`` per group, one column per entry of ``quantiles`` (name to fraction).

    Nulls are skipped; groups without any value and rows without a full key are left out. ``mean`` names a column for the
    mean, summed along with the counts. ``approx=True`` answers quantiles from a bounded sketch in one shuffle:
    cheaper, but only close, and without interpolation.
    """
    rows = df.select(*keys, F.col(value).alias("_value"))
    # Asking for all keys up front keeps both uses of the counts below one and the same shuffle.
    rows = rows.where(reduce(and_, (F.col(column).isNotNull() for column in rows.columns)))
    if approx:
        average = [F.avg("_value").alias(mean)] if mean else []
        return rows.groupBy(*keys).agg(
            *(F.percentile_approx("_value", p, 10_000).alias(name) for name, p in quantiles.items()), *average
        )
    found = quantile_parts(rows, keys, quantiles, mean)
    return found.groupBy(*keys).agg(*(F.sum(name).alias(name) for name in quantiles), *([F.max(mean).alias(mean)] if mean else []))


def quantile_parts(rows: DataFrame, keys: list[str], quantiles: dict[str, float], mean: str | None = None) -> DataFrame:
    """Few rows per group whose sums, null where there is nothing to add, are the quantiles of ``_value``.

    A quantile between two ranks is a share of the value at each; they may stand in rows of their own. ``mean`` is the
    same in all rows of a group. Keys and values are not null.
    """
    places = range(len(quantiles))
    by = ", ".join(f"`{key}`" for key in keys)
    ranks = [f"{name}{i}" for i in places for name in ("_low", "_high")]
    carried = ", ".join([*ranks, *(f"_share{i}" for i in places), *(["_mean"] if mean else [])])
    at = [f"((_total - 1) * {float(p)!r}D)" for p in quantiles.values()]
    positions = ", ".join(f"floor({p}) AS _low{i}, ceil({p}) AS _high{i}, {p} - floor({p}) AS _share{i}" for i, p in enumerate(at))
    share = "try_divide(_value - _least, _most - _least)"

    def holding(start: str, end: str) -> str:
        return " OR ".join(f"({rank} >= {start} AND {rank} < {end})" for rank in ranks)

    def only(text: str) -> str:
        return text if mean else ""

    def answers(value: str) -> str:
        """What a value that holds the ranks from _start up to _end adds to each quantile."""
        out = []
        for i, name in enumerate(quantiles):
            low, high = (f"{rank} >= _start AND {rank} < _end" for rank in (f"_low{i}", f"_high{i}"))
            out.append(
                f"CASE WHEN {low} AND {high} THEN {value} WHEN {low} THEN {value} * (1 - _share{i})"
                f" WHEN {high} THEN {value} * _share{i} END AS `{name}`"
            )
        return ", ".join(out) + only(f", _mean AS `{mean}`")

    # counted: shuffled by key and value, so a hot group spreads over all tasks and a hot value collapses to a row.
    # wanted: the bands that hold a wanted rank. parted, ranked: the same again inside those of several values.
    return rows.sparkSession.sql(f"""
        WITH counted AS (
          SELECT {by}, _band, _value, count(1) AS _n FROM (SELECT {by}, _value, {_BAND} AS _band FROM {{rows}}) GROUP BY {by}, _band, _value
        ), bands AS (
          SELECT {by}, _band, sum(_n) AS _in, min(_value) AS _least, max(_value) AS _most {only(", sum(_value * _n) AS _sum")}
          FROM counted GROUP BY {by}, _band
        ), placed AS (
          SELECT {by}, _band, _least, _most, _in, sum(_in) OVER (PARTITION BY {by} ORDER BY _band ROWS UNBOUNDED PRECEDING) AS _end,
                 sum(_in) OVER (PARTITION BY {by}) AS _total {only(f", sum(_sum) OVER (PARTITION BY {by}) AS _sum")}
          FROM bands
        ), wanted AS (
          SELECT * FROM (
            SELECT {by}, _band, _least, _most, _end - _in AS _start, _end, {positions} {only(", _sum / _total AS _mean")} FROM placed
          ) WHERE {holding("_start", "_end")}
        ), parted AS (
          SELECT {by}, _band, _value, _n, _start, {carried},
                 CASE WHEN {share} > 0 AND {share} <= 1 THEN cast(floor({share} * {_PARTS}) AS int) ELSE 0 END AS _part
          FROM counted JOIN (SELECT {by}, _band, _least, _most, _start, {carried} FROM wanted WHERE _least < _most) USING ({by}, _band)
        ), parts AS (
          SELECT {by}, _band, _part, _in, {", ".join(ranks)},
                 _start + sum(_in) OVER (PARTITION BY {by}, _band ORDER BY _part ROWS UNBOUNDED PRECEDING) AS _end
          FROM (SELECT {by}, _band, _part, sum(_n) AS _in, max(_start) AS _start, {", ".join(f"max({r}) AS {r}" for r in ranks)}
                FROM parted GROUP BY {by}, _band, _part)
        ), ranked AS (
          SELECT {by}, _value, _n, {carried},
                 _before + sum(_n) OVER (PARTITION BY {by}, _band, _part ORDER BY _value ROWS UNBOUNDED PRECEDING) AS _end
          FROM (SELECT {by}, _band, _part, _value, _n, {carried} FROM parted)
          JOIN (SELECT {by}, _band, _part, _end - _in AS _before FROM parts WHERE {holding("_end - _in", "_end")}) USING ({by}, _band, _part)
        )
        SELECT {by}, {answers("_least")} FROM wanted WHERE _least = _most
        UNION ALL
        SELECT {by}, {answers("_value")} FROM (SELECT *, _end - _n AS _start FROM ranked) WHERE {holding("_start", "_end")}
    """, rows=rows)
