"""The same results as ``event_queries``, as SQL over the ``events`` table for another engine."""

from __future__ import annotations

SIGNALS = ("click", "view", "purchase", "signup")
START = "timestamp '2024-01-05 00:00:00'"
END = "timestamp '2024-01-25 23:59:59.999999'"
FIRST = "timestamp '2024-01-01 00:00:00'"
LAST = "timestamp '2024-01-31 23:59:59.999999'"
ORIGIN = "timestamp '1970-01-01'"

_CASES = ", ".join(f"case when event_type = '{s}' then value end as {s}" for s in SIGNALS)
READINGS = f"readings as (select user_id, ts, {_CASES} from events where event_type <> 'error')"
LONG = (
    "long as (select user_id, ts, event_type as signal, value from events"
    " where event_type <> 'error' and value is not null)"
)
SIGNAL_LIST = "signals(signal) as (values " + ", ".join(f"('{s}')" for s in SIGNALS) + ")"
USERS = "users as (select distinct user_id from events where event_type <> 'error')"
EVERYONE = "everyone as (select distinct user_id from events)"
HAPPENED = """
happened as (
  select event_id, user_id, ts as moment, k % 2 = 0 as is_interval, k,
         case when k % 2 = 0
              then ts + to_seconds(case when k % 10 = 0 then -k else k end) end as finish,
         'type_' || (k % 5) as kind, 'severity_' || (k % 3) as severity
  from (select *, cast(regexp_extract(props, '(\\d+)', 1) as int) as k
        from events where event_type = 'error')
)"""


def _with(*parts: str) -> str:
    return "with " + ", ".join(parts) + " "


def _each(template: str, signals=SIGNALS) -> str:
    return ", ".join(template.format(s=s) for s in signals)


def _values_list(signals=SIGNALS) -> str:
    return ", ".join(signals)


# Hourly text of an upload: what each kind of time text must be read as.
_PARSED = """
  case event_id % 6
    when 0 then {t} when 1 then {t}
    when 2 then date_trunc('second', {t}) when 3 then date_trunc('millisecond', {t})
  end"""
_CLEAN = "case when event_id % 7 in (0, 1, 3) then null else {v} end"
_FLAG = "event_id % 9 in (0, 1, 2, 3, 4)"


def _grid(seconds: int, spans: str = "readings", extra: str = "") -> str:
    """All bins from a user's first to last row, by ``time_bucket``."""
    return f"""
grid as (
  select user_id, unnest(generate_series(
           time_bucket(interval {seconds} second, min(ts), {ORIGIN}), max(ts),
           interval {seconds} second)) as bin
  from {spans} {extra} group by user_id
)"""


def _binned(seconds: int) -> str:
    return (
        f"binned as (select *, time_bucket(interval {seconds} second, ts, {ORIGIN}) as bin"
        " from readings)"
    )


_WIDTH = """
  case when span = 0 then 60 when span / 10000 < 60 then 1 when span / 10000 < 300 then 60
       when span / 10000 < 900 then 300 when span / 10000 < 3600 then 900
       when span / 10000 < 21600 then 3600 when span / 10000 < 86400 then 21600 else 86400 end"""
_SPANS = f"""
spans as (
  select *, cast({_WIDTH} as bigint) as width from (
    select user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as span,
           date_trunc('day', min(ts)) as origin,
           count(*) as points
    from readings group by user_id)
)"""


def _anchored(width: str) -> str:
    """Start of the bin of ``ts`` counted from ``origin``."""
    return (
        f"origin + to_microseconds(((epoch_us(ts) - epoch_us(origin)) // ({width} * 1000000))"
        f" * ({width} * 1000000))"
    )


_LABEL = """
  case when {x} < 2 then '~1 second'
       when {x} < 120 then '~' || cast(floor({x}) as bigint) || ' seconds'
       when {x} < 3600 then '~' || cast(floor({x} / 60) as bigint) || ' minute'
            || case when floor({x} / 60) > 1 then 's' else '' end
       when {x} < 86400 then '~' || cast(floor({x} / 3600) as bigint) || ' hour'
            || case when floor({x} / 3600) > 1 then 's' else '' end
       else '~' || cast(floor({x} / 86400) as bigint) || ' day'
            || case when floor({x} / 86400) > 1 then 's' else '' end end"""

_GAPS = """
gaps as (
  select user_id, signal, ts,
         (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id, signal order by ts))) / 1e6 as gap
  from long
)"""

ORACLE: dict[str, str] = {}

# Ingest.

_HOURLY = "hourly as (select * replace (date_trunc('hour', ts) as ts) from events)"

ORACLE["ingest_readings"] = (
    _with(_HOURLY)
    + f"""
select patient_id, "timestamp", {_values_list()} from (
  select cast(user_id as varchar) as patient_id, {_PARSED.format(t='ts')} as "timestamp", event_id,
         {", ".join(_CLEAN.format(v=f"case when event_type = '{s}' then value end") + f" as {s}" for s in SIGNALS)}
  from hourly)
where "timestamp" is not null
qualify row_number() over (partition by patient_id, "timestamp" order by event_id) = 1"""
)

ORACLE["ingest_default_id"] = ORACLE["ingest_readings"].replace("cast(user_id as varchar)", "'uploaded_patient'")

ORACLE["event_dispatch"] = f"""
select 'ends' as given, cast(user_id as varchar) as patient_id, ts as seizure_time, ts as seizure_start,
       case when event_id % 3 > 0 then ts + interval 90 second end as seizure_end, true as is_interval
from events where event_type = 'error'
union all
select 'flag', cast(user_id as varchar), ts, null, null, false from events where {_FLAG}"""

ORACLE["parse_timestamps"] =f"select event_id, {_PARSED.format(t='ts')} as parsed from events"

ORACLE["dedupe_readings"] = (
    _with(_HOURLY)
    + """
select event_id, user_id, ts, event_type, value from hourly
qualify row_number() over (partition by user_id, ts order by event_id) = 1"""
)

ORACLE["extract_readings"] = f"""
select cast(user_id as varchar) as patient_id, ts as "timestamp",
       {", ".join(_CLEAN.format(v=f"case when event_type = '{s}' then value end") + f" as {s}" for s in SIGNALS)}
from events"""

ORACLE["extract_point_events"] = f"""
select cast(user_id as varchar) as patient_id, ts as seizure_time,
       'unknown' as seizure_type, 'unknown' as severity
from events where {_FLAG}"""

ORACLE["extract_interval_events"] = """
select cast(user_id as varchar) as patient_id, ts as seizure_time, ts as seizure_start,
       case when event_id % 3 > 0 then ts + interval 90 second end as seizure_end,
       true as is_interval
from events where event_type = 'error'"""

ORACLE["ingest_report"] = (
    _with(_HOURLY)
    + f""", texts as (
  select user_id, event_id, {_PARSED.format(t='ts')} as parsed from hourly)
select count(*) as rows_read,
       count(*) filter (event_id % 6 = 5) as blank_times,
       count(*) filter (event_id % 6 = 4) as bad_times,
       count(parsed) - count(distinct (user_id, parsed)) filter (parsed is not null) as duplicates,
       count(distinct (user_id, parsed)) filter (parsed is not null) as rows_kept
from texts"""
)

# Filters and projections.

ORACLE["filter_patient"] = _with(READINGS) + "select * from readings where user_id = 3"
ORACLE["filter_time_range"] = (
    _with(HAPPENED)
    + f"select event_id, user_id, kind as seizure_type from happened where moment between {START} and {END}"
)
ORACLE["filter_calendar_days"] = _with(READINGS) + """
select * from readings where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-10'"""
ORACLE["readings_long"] = _with(LONG) + "select user_id, ts, signal, value from long"
ORACLE["event_time"] = _with(HAPPENED) + "select event_id, user_id, moment as seizure_time from happened"
ORACLE["valid_intervals"] = _with(HAPPENED) + """
select event_id, user_id, moment as seizure_start, finish as seizure_end from happened where is_interval"""

# Aggregations.

ORACLE["patient_list"] = _with(USERS) + "select user_id from users order by user_id"
ORACLE["patient_date_bounds"] = _with(READINGS) + """
select user_id, cast(cast(min(ts) as date) as varchar) as first_date,
       cast(cast(max(ts) as date) as varchar) as last_date
from readings group by user_id"""
ORACLE["available_signals"] = _with(USERS, SIGNAL_LIST, LONG) + """
select user_id, signal,
       exists (select 1 from long l where l.user_id = u.user_id and l.signal = s.signal) as available
from users u cross join signals s"""
ORACLE["time_extent"] = _with(READINGS) + """
select min(ts) as first_time, max(ts) as last_time from readings"""

_STATS = """
stats as (
  select u.user_id, s.signal, min(value) as lo, max(value) as hi, avg(value) as mean,
         median(value) as med, count(value) as n,
         case when count(value) = 1 then 0 else stddev_samp(value) end as sd
  from users u cross join signals s
  left join long l on l.user_id = u.user_id and l.signal = s.signal
  group by u.user_id, s.signal
)"""
ORACLE["signal_stats"] = _with(USERS, SIGNAL_LIST, LONG, _STATS) + """
select user_id, signal, round(lo, 6) as min, round(hi, 6) as max, round(mean, 6) as mean,
       round(med, 6) as median, round(sd, 6) as std, n as count
from stats"""

_RATES = """
rates as (
  select e.user_id, count(h.event_id) as total_count,
         greatest(1, coalesce({span}, 0) / 3600) as hours
  from everyone e left join happened h on h.user_id = e.user_id {cond}
  group by e.user_id
)"""
_SPAN_OWN = "((epoch_us(max(h.moment)) - epoch_us(min(h.moment))) / 1e6)"
_SPAN_RANGE = f"((epoch_us({END}) - epoch_us({START})) / 1e6)"
_RATE_COLUMNS = """
select user_id, total_count, round(total_count / hours, 6) as per_hour,
       round(total_count / (hours / 24), 6) as per_day from rates"""
ORACLE["event_rates"] = (
    _with(EVERYONE, HAPPENED, _RATES.format(span=_SPAN_OWN, cond="")) + _RATE_COLUMNS
)
_IN_RANGE = f"and h.moment between {START} and {END}"
ORACLE["event_rates_in_range"] = (
    _with(EVERYONE, HAPPENED, _RATES.format(span=_SPAN_RANGE, cond=_IN_RANGE)) + _RATE_COLUMNS
)
ORACLE["event_type_counts"] = _with(HAPPENED) + """
select user_id, kind as seizure_type, count(*) as count from happened
group by all order by user_id, count desc, seizure_type"""
ORACLE["event_type_ranks"] = _with(HAPPENED) + """
select user_id, kind as seizure_type, count(*) as count,
       row_number() over (partition by user_id order by count(*) desc, kind) as rank
from happened group by user_id, kind"""
ORACLE["event_type_map"] = _with(HAPPENED) + """
select user_id, '{' || string_agg('"' || kind || '":' || n, ',' order by n desc, kind) || '}' as type_counts
from (select user_id, kind, count(*) as n from happened group by user_id, kind) group by user_id"""
ORACLE["patient_summary"] = _with(READINGS, HAPPENED) + """
select r.user_id, count(*) as total_records, min(ts) as first_time, max(ts) as last_time,
       (select count(*) from happened h where h.user_id = r.user_id) as event_count
from readings r group by r.user_id"""
ORACLE["signal_coverage"] = _with(LONG) + """
select user_id, signal, count(*) as count, min(ts) as first_time, max(ts) as last_time
from long group by all"""
ORACLE["dataset_totals"] = _with(READINGS, HAPPENED) + """
select (select count(*) from readings) as reading_rows, (select count(*) from happened) as events,
       (select count(distinct user_id) from readings) as patients"""

_EXACT = "cast(round(cast({x} as decimal(38, 9)), {d}) as double)"
_ANYONE = "users as (select distinct user_id from events)"
_MONTH_RATES = _RATES.format(span=_SPAN_RANGE.replace(START, FIRST).replace(END, LAST), cond="")
_CARDS = f"""
select user_id, signal, {_EXACT.format(x='mean', d=1)} as mean, {_EXACT.format(x='lo', d=1)} as min,
       {_EXACT.format(x='hi', d=1)} as max, total_count,
       {_EXACT.format(x='total_count / (hours / 24)', d=2)} as per_day
from stats join rates using (user_id)"""
ORACLE["summary_cards"] = _with(_ANYONE, EVERYONE, SIGNAL_LIST, LONG, _STATS, HAPPENED, _MONTH_RATES) + _CARDS
ORACLE["cards_of_all"] = _with(
    "clicked as (select distinct user_id from events where event_type = 'click' and value > 150)",
    "users as (select user_id from clicked union select user_id from events where event_type = 'error')",
    EVERYONE, SIGNAL_LIST,
    "long as (select user_id, ts, event_type as signal, value from events semi join clicked using (user_id)"
    " where event_type <> 'error' and value is not null)",
    _STATS, HAPPENED, _MONTH_RATES,
) + _CARDS

# Time bins.

_MEANS = _each("round(avg({s}), 6) as {s}")
ORACLE["resample_mean"] = _with(READINGS, _grid(3600), _binned(3600)) + f"""
select g.user_id, g.bin as ts, {_MEANS}
from grid g left join binned b on b.user_id = g.user_id and b.bin = g.bin group by g.user_id, g.bin"""
ORACLE["resample_median"] = _with(READINGS, _grid(21600), _binned(21600)) + f"""
select g.user_id, g.bin as ts, {_each('round(median({s}), 6) as {s}')}
from grid g left join binned b on b.user_id = g.user_id and b.bin = g.bin group by g.user_id, g.bin"""
_BANDS = (
    "round(quantile_cont({s}, 0.1), 6) as {s}_p10, round(quantile_cont({s}, 0.9), 6) as {s}_p90"
)
ORACLE["resample_band"] = _with(READINGS, _grid(86400), _binned(86400)) + f"""
select g.user_id, g.bin as ts, {_MEANS}, {_each(_BANDS)}
from grid g left join binned b on b.user_id = g.user_id and b.bin = g.bin group by g.user_id, g.bin"""
ORACLE["resample_two_signals"] = _with(READINGS, _grid(21600), _binned(21600)) + f"""
select g.user_id, g.bin as ts, {_each('round(avg({s}), 6) as {s}', ("click", "view"))}
from grid g left join binned b on b.user_id = g.user_id and b.bin = g.bin group by g.user_id, g.bin"""
_FILLED = ", ".join(
    f"last_value({c} ignore nulls) over (partition by user_id order by ts"
    f" rows between unbounded preceding and current row) as {c}"
    for s in SIGNALS
    for c in (s, f"{s}_p10", f"{s}_p90")
)
ORACLE["resample_ffill"] = _with(READINGS, _grid(21600), _binned(21600)) + f"""
select user_id, ts, {_FILLED} from (
  select g.user_id, g.bin as ts, {_each('round(median({s}), 6) as {s}')}, {_each(_BANDS)}
  from grid g left join binned b on b.user_id = g.user_id and b.bin = g.bin group by g.user_id, g.bin)"""
ORACLE["resample_custom_width"] = _with(
    READINGS, _SPANS,
    "origins as (select user_id, date_trunc('day', min(ts)) as origin, min(ts) as first,"
    " max(ts) as final from readings group by user_id)",
    f"""grid as (
  select user_id, unnest(generate_series(bin, final, interval 5 hour)) as bin
  from (select *, {_anchored('cast(18000 as bigint)').replace('(ts)', '(first)')} as bin from origins))""",
    f"binned as (select r.*, {_anchored('cast(18000 as bigint)')} as bin from readings r join origins using (user_id))",
) + f"""
select g.user_id, g.bin as ts, {_MEANS}
from grid g left join binned b on b.user_id = g.user_id and b.bin = g.bin group by g.user_id, g.bin"""
ORACLE["resample_auto"] = _with(READINGS, _SPANS) + f"""
select user_id, {_anchored('width')} as ts, {_MEANS}
from readings join spans using (user_id) group by user_id, {_anchored('width')}"""
ORACLE["resample_raw"] = _with(READINGS) + f"""
select user_id, ts, {_each('round({s}, 6) as {s}')} from readings"""
ORACLE["bin_grid"] = _with(READINGS, _grid(21600)) + "select user_id, bin from grid"
ORACLE["raw_guard"] = _with(READINGS, _SPANS) + """
select user_id, points, points > 50 as over_limit from spans"""
ORACLE["auto_granularity"] = _with(READINGS, _SPANS) + """
select user_id, round(span, 6) as span_seconds, width as width_seconds from spans"""

_AXIS = """
axis as (
  select user_id, unnest(generate_series({start}, {end}, interval 1 {unit})) as time_bin from everyone
)"""
_DENSITY = """
select a.user_id, a.time_bin, count(h.event_id) as count,
       round(count(h.event_id) / {hours}, 6) as density_per_hour
from axis a left join happened h
  on h.user_id = a.user_id and date_trunc('{unit}', h.moment) = a.time_bin {cond}
group by a.user_id, a.time_bin"""
ORACLE["event_density_hour"] = _with(
    EVERYONE, HAPPENED, _AXIS.format(start=FIRST, end=LAST, unit="hour")
) + _DENSITY.format(hours="1.0", unit="hour", cond="")
ORACLE["event_density_some"] = _with(
    "everyone as (select distinct user_id from events where event_type = 'click')",
    HAPPENED, _AXIS.format(start=FIRST, end=LAST, unit="day")
) + _DENSITY.format(hours="24.0", unit="day", cond="")
ORACLE["event_density_day"] = _with(
    HAPPENED,
    """axis as (select user_id, unnest(generate_series(
  date_trunc('day', min(moment)), max(moment), interval 1 day)) as time_bin from happened group by user_id)""",
) + _DENSITY.format(hours="24.0", unit="day", cond="")
ORACLE["event_density_empty"] = _with(
    EVERYONE, _AXIS.format(start=START, end=END, unit="day")
) + "select user_id, time_bin, cast(0 as bigint) as count, cast(0 as double) as density_per_hour from axis"

# Sampling.

ORACLE["reading_gaps"] = _with(LONG, _GAPS) + """
select user_id, signal, ts, round(gap, 6) as gap_seconds from gaps where gap is not null"""
ORACLE["sampling_profile"] = _with(USERS, SIGNAL_LIST, LONG, _GAPS, """
measured as (
  select u.user_id, s.signal, median(gap) as med, count(g.ts) as n,
         (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as span
  from users u cross join signals s
  left join gaps g on g.user_id = u.user_id and g.signal = s.signal
  group by u.user_id, s.signal
)""") + f"""
select user_id, signal, round(med, 3) as median_interval_seconds,
       case when med is null then 'Insufficient data' else {_LABEL.format(x='med')} end as frequency_label,
       n as count,
       round(case when med > 0 and span > 0 then least(100, n / (span / med) * 100) else 0 end, 6)
         as coverage_pct
from measured"""
ORACLE["interval_labels"] = _with(LONG, _GAPS) + f"""
select user_id, signal, ts, {_LABEL.format(x='gap')} as label from gaps where gap is not null"""

# Joins.

ORACLE["combine_feeds"] = _with(READINGS) + f"""
select user_id, ts, {_each('max({s}) as {s}')} from readings group by user_id, ts"""
ORACLE["combine_unique_feeds"] = ORACLE["combine_feeds"]
ORACLE["combine_feeds_hourly"] = _with(READINGS) + f"""
select user_id, date_trunc('hour', ts) as ts, {_each('max({s}) as {s}')} from readings
group by user_id, date_trunc('hour', ts)"""
ORACLE["union_patients"] =_with(READINGS) + "select * from readings"
ORACLE["sorted_readings"] = _with(READINGS) + "select * from readings order by user_id, ts"
ORACLE["numbered_readings"] = _with(READINGS) + "select row_number() over (order by user_id, ts) as ordinal, * from readings"
ORACLE["combine_feeds_repeated"] = """
select user_id, ts, click, view
from (select user_id, date_trunc('day', ts) as ts, value as click from events where event_type = 'click')
full join (select user_id, date_trunc('day', ts) as ts, value as view from events where event_type = 'view') using (user_id, ts)"""
ORACLE["parse_time_forms"] = """
select event_id, case event_id % 7
    when 2 then date_trunc('minute', ts) - interval 5 hour when 3 then date_trunc('hour', ts) - interval 5 hour
    when 4 then date_trunc('hour', ts) when 5 then date_trunc('day', ts) end as parsed
from events"""
ORACLE["event_context"] = _with(HAPPENED, SIGNAL_LIST, LONG) + """
select h.user_id, h.moment as event_time, s.signal, round(avg(value), 6) as mean,
       round(min(value), 6) as min, round(max(value), 6) as max, count(value) as count
from (select distinct user_id, moment from happened) h cross join signals s
left join long l on l.user_id = h.user_id and l.signal = s.signal
  and l.ts between h.moment - interval 6 hour and h.moment + interval 6 hour
group by h.user_id, h.moment, s.signal"""
ORACLE["event_table"] = _with(HAPPENED, READINGS) + f"""
select h.event_id, h.user_id, h.moment as event_time, h.finish as end_time,
       cast(case when is_interval and k % 10 = 0 then -k else k end as bigint) as duration_s,
       h.kind as type, h.severity, {_each('round(avg({s}), 6) as {s}_mean')}
from happened h left join readings r on r.user_id = h.user_id
  and r.ts between h.moment - interval 6 hour and h.moment + interval 6 hour
group by all"""
ORACLE["nearest_reading"] = _with(HAPPENED, SIGNAL_LIST, LONG) + """
select user_id, event_time, signal, pick.ts as nearest_time, round(pick.value, 6) as value,
       round(pick.away / 1e6, 6) as distance_seconds
from (
  select h.user_id, h.moment as event_time, s.signal,
         arg_min({'ts': l.ts, 'value': l.value, 'away': abs(epoch_us(l.ts) - epoch_us(h.moment))},
                 (abs(epoch_us(l.ts) - epoch_us(h.moment)), l.ts)) filter (l.ts is not null) as pick
  from (select distinct user_id, moment from happened) h cross join signals s
  left join long l on l.user_id = h.user_id and l.signal = s.signal
  group by h.user_id, h.moment, s.signal)"""
ORACLE["flag_event_rows"] = _with(HAPPENED, READINGS, """
hits as (
  select distinct user_id, pick.ts as ts from (
    select h.user_id, h.moment,
           arg_min({'ts': r.ts, 'away': abs(epoch_us(r.ts) - epoch_us(h.moment))},
                   (abs(epoch_us(r.ts) - epoch_us(h.moment)), r.ts)) as pick
    from happened h join readings r on r.user_id = h.user_id group by h.user_id, h.moment)
  where pick.away < 3600000000
)""") + """
select r.*, case when hits.ts is null then 0 else 1 end as seizure
from readings r left join hits on hits.user_id = r.user_id and hits.ts = r.ts"""

_LIMITS = "limits(signal, low, high) as (values ('click', 5, 50), ('view', null, 60), ('purchase', 10, null), ('signup', 2, 80))"
_BREACHES = """
breaches as (
  select user_id, ts, signal, value, case when value < low then 'low' else 'high' end as side
  from long join limits using (signal) where value < low or value > high
)"""
ORACLE["threshold_breaches"] = _with(LONG, _LIMITS, _BREACHES) + "select * from breaches"
ORACLE["breach_counts"] = _with(LONG, _LIMITS, _BREACHES) + """
select user_id, signal, side, count(*) as breaches from breaches group by all"""
