"""Whole years and whole hours between two timestamps without a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_years(start: Column, end: Column) -> Column:
    """Completed calendar years from start to end, truncated toward zero."""
    return F.timestamp_diff("YEAR", start, end)


def whole_hours(start: Column, end: Column) -> Column:
    """Completed hours from start to end, truncated toward zero."""
    return F.timestamp_diff("HOUR", start, end)


def age_flag(age: Column, min_years: int = 18) -> Column:
    """0 below the age limit, else 1; an unknown age counts as adult."""
    return F.when(age < min_years, 0).otherwise(1)
