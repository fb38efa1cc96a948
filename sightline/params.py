"""Default parameters. All are values that the results must agree on; every operator takes them as arguments."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    fresh_minutes: int = 45
    recent_minutes: int = 180
    stale_minutes: int = 360
    expire_minutes: int = 360
    future_skew_seconds: int = 120
    conflict_window_minutes: int = 30
    quiet_gap_minutes: int = 60
    resume_window_minutes: int = 20
    minimum_events: int = 2
    strong_signal: float = 4.0
    drift_meters: float = 100.0
    ambiguity_margin: float = 0.18
    merge_threshold: float = 0.82
    retention_days: int = 90
    forecast_days: int = 28
    forecast_count: int = 3
    interval_minutes: int = 10
    compact_after_empty: int = 4
    gap_intervals: int = 3
    arrival_gap_minutes: int = 120
    utc_offset_minutes: int = 180


DEFAULTS = Params()

#: Ordered enumerations by rank.
CONFIDENCE = {"NONE": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3}
QUEUE = {"NONE": 0, "SHORT": 1, "MEDIUM": 2, "LONG": 3, "VERY_LONG": 4}
STATUS = {"UNKNOWN": 0, "OUT_OF_STOCK": 1, "LIMITED": 2, "IN_STOCK": 3}
