"""The timeline of one patient: everything a viewer shows, as lazy frames."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame

from chartline.functions.times import calendar_bounds
from chartline.layout import PATIENTS, Layout
from chartline.operators.bins import resample
from chartline.operators.context import event_table
from chartline.operators.density import event_density
from chartline.operators.limits import threshold_breaches
from chartline.operators.nearest import nearest_reading
from chartline.operators.profile import sampling_profile, signal_stats
from chartline.operators.select import available_signals, filter_patient, filter_time_range, patient_date_bounds, valid_intervals
from chartline.operators.summaries import event_rates, event_type_counts, summary_cards


@dataclass
class Timeline:
    bounds: DataFrame
    signals: DataFrame
    readings: DataFrame
    events: DataFrame
    profile: DataFrame
    stats: DataFrame
    rates: DataFrame
    types: DataFrame
    cards: DataFrame
    series: DataFrame
    density: DataFrame
    markers: DataFrame
    intervals: DataFrame
    breaches: DataFrame
    table: DataFrame


def patient_timeline(
    readings: DataFrame,
    events: DataFrame,
    patient,
    first_day: dt.date | None = None,
    last_day: dt.date | None = None,
    granularity: str = "auto",
    aggregation: str = "mean",
    show_band: bool = False,
    ffill: bool = False,
    density_bin: str = "hour",
    window_minutes: float = 5,
    signals=None,
    limits: dict | None = None,
    layout: Layout = PATIENTS,
) -> Timeline:
    """Filter to one patient and whole calendar days, then derive every view of them.

    ``bounds`` and ``signals`` tell what there is to choose from: first and last day, and signals with any value, of
    all readings of the patient. Without ``first_day`` the view covers these days, which are read at once; a patient
    without readings then needs days. With ``last_day`` alone it covers all days up to that one.
    Statistics use the readings as they are; event markers sit on the resampled series. Density, rates and cards are
    on the axis of the range, for a patient without a single reading too.
    """
    known = filter_patient(readings, patient, layout)
    bounds = patient_date_bounds(known, layout)
    if first_day is None:
        found = bounds.where("first_date IS NOT NULL").head()
        if found is None:
            raise ValueError(f"no readings of {patient!r} to take the days from: name first_day")
        first_day, last_day = found.first_date, found.last_date if last_day is None else last_day
    start, end = calendar_bounds(first_day, last_day)
    own = filter_time_range(known, start, end, layout)
    happened = filter_time_range(filter_patient(events, patient, layout), start, end, layout)
    one = readings.sparkSession.createDataFrame([(patient,)], readings.select(layout.entity).schema)
    series = resample(own, granularity, aggregation, show_band, ffill, signals, layout=layout)
    return Timeline(
        bounds=bounds,
        signals=available_signals(known, layout),
        readings=own,
        events=happened,
        profile=sampling_profile(own, layout=layout),
        stats=signal_stats(own, signals, layout=layout),
        rates=event_rates(happened, start, end, one, layout),
        types=event_type_counts(happened, layout),
        cards=summary_cards(own, happened, start, end, signals, layout),
        series=series,
        density=event_density(happened, density_bin, start, end, one, layout),
        markers=nearest_reading(series, happened, signals, layout),
        intervals=valid_intervals(happened, layout),
        breaches=threshold_breaches(own, limits, layout),
        table=event_table(happened, own, window_minutes, layout),
    )
