"""Spark-native engine for multi-rate time-series signals and the events around them."""

from chartline.layout import PATIENTS, SIGNAL_METADATA, Layout, limits_table, metadata_table
from chartline.operators.bins import auto_granularity, bin_grid, forward_fill, raw_guard, resample
from chartline.operators.combine import combine_feeds, dedupe_readings, sorted_readings, union_patients
from chartline.operators.context import display_event_table, event_context, event_table
from chartline.operators.density import event_density
from chartline.operators.limits import breach_counts, threshold_breaches
from chartline.operators.nearest import flag_event_rows, nearest_reading
from chartline.operators.profile import reading_gaps, sampling_profile, signal_coverage, signal_stats
from chartline.operators.quantiles import group_quantiles
from chartline.operators.select import (
    available_signals,
    filter_calendar_days,
    filter_patient,
    filter_time_range,
    patient_date_bounds,
    patient_list,
    readings_long,
    time_extent,
    valid_intervals,
    with_event_time,
)
from chartline.operators.summaries import (
    dataset_totals,
    event_rates,
    event_type_counts,
    patient_summary,
    summary_cards,
)
from chartline.plans.timeline import Timeline, patient_timeline
from chartline.sources.ingest import DataValidationError, load_upload, read_upload, validate_columns
from chartline.sources.tables import read_events, read_readings
from chartline.sources.sinks import write_by_day, write_combined, write_per_patient, write_upload_ready

__all__ = [name for name in dir() if not name.startswith("_")]
