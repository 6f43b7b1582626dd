"""Column functions shared by every operator (all JVM-side expressions)."""

from ordermart.functions.columns import (
    BUCKET_LABELS,
    ON_TIME,
    DELAYED,
    day_of_week,
    dp,
    is_late,
    pct,
    safe_corr,
    severity_bucket,
    status_label,
    trunc_ts,
    whole_days,
)

__all__ = [
    "BUCKET_LABELS",
    "ON_TIME",
    "DELAYED",
    "day_of_week",
    "dp",
    "is_late",
    "pct",
    "safe_corr",
    "severity_bucket",
    "status_label",
    "trunc_ts",
    "whole_days",
]
