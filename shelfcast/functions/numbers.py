"""Arithmetic of the estimate, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Day counts, bounds and defaults of the estimate.
DAYS_PER_YEAR = 365
DAYS_PER_MONTH = 30
DEFAULT_SPEED = 0.5
LOWER_FACTOR = 0.85
LOWER_FLOOR = 0.1
UPPER_FACTOR = 1.15


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Halves go up for negative numbers too, unlike ``round``."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def speed_score(days: Column) -> Column:
    missing = days.isNull() | F.isnan(days) | (days == 0)
    return F.when(missing, F.lit(DEFAULT_SPEED)).otherwise(1 / (days / DAYS_PER_YEAR))


def whole_years(years: Column) -> Column:
    """Truncates toward zero."""
    return years.cast("int")


def whole_months(years: Column) -> Column:
    return ((years - years.cast("int")) * 12).cast("int")


def lower_bound(years: Column) -> Column:
    lower = years * LOWER_FACTOR
    return F.when(lower < LOWER_FLOOR, F.lit(LOWER_FLOOR)).otherwise(lower)


def upper_bound(years: Column) -> Column:
    return years * UPPER_FACTOR


def average_years(days: Column) -> Column:
    return (days / DAYS_PER_YEAR).cast("int")


def average_months(days: Column) -> Column:
    """May be 12: months have 30 days here and years 365."""
    return (F.pmod(days, F.lit(float(DAYS_PER_YEAR))) / DAYS_PER_MONTH).cast("int")


def rounded_days(days: Column) -> Column:
    return F.floor(days + 0.5).cast("bigint")
