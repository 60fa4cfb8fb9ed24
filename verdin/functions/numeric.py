"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdin.functions.timefuncs import col_of


def safe_round(c, digits: int = 6) -> Column:
    """X11: half-even rounding; NaN/±inf → null."""
    x = col_of(c).cast("double")
    finite = ~(F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(x.isNotNull() & finite, F.bround(x, digits))


def to_number(c) -> Column:
    """Numeric coercion, errors → null (``pd.to_numeric(errors='coerce')``)."""
    return col_of(c).try_cast("double")


def strength(score) -> Column:
    """≥0.66 strong, ≥0.33 medium, else weak."""
    s = col_of(score)
    return F.when(s >= 0.66, F.lit("strong")).when(s >= 0.33, F.lit("medium")).otherwise(F.lit("weak"))


# Bounds and default of a forecast request (minutes) and the most points that are shown.
INTERVAL_STEP_MINUTES = 10
INTERVAL_MIN_MINUTES = 10
INTERVAL_MAX_MINUTES = 1440
DEFAULT_INTERVAL_MINUTES = 120
MAX_FORECAST_POINTS = 720


def _usable(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < float("inf"))


def normalize_interval(minutes) -> Column:
    """Interval rounded to 10 minutes and clamped to [10, 1440]; 120 where it is missing, not finite or not positive."""
    x = col_of(minutes).cast("double")
    m = F.round(x / INTERVAL_STEP_MINUTES) * INTERVAL_STEP_MINUTES
    clamped = F.least(F.greatest(m, F.lit(float(INTERVAL_MIN_MINUTES))), F.lit(float(INTERVAL_MAX_MINUTES)))
    return F.when(_usable(x), clamped).otherwise(F.lit(float(DEFAULT_INTERVAL_MINUTES))).cast("int")


def forecast_steps(interval_minutes, cadence_minutes) -> Column:
    """steps = ceil(interval / cadence), at least 1.  What is shown of them is bounded (:func:`shown_points`), not what is computed."""
    steps = F.ceil(col_of(interval_minutes).cast("double") / F.greatest(col_of(cadence_minutes), F.lit(1)))
    return F.greatest(steps, F.lit(1)).cast("int")


def shown_points(steps, preferred) -> Column:
    """Of the allowed point counts 1..min(steps, 720) the one nearest to ``preferred`` (the smaller of two as near); the largest where
    that is missing, not finite or not positive.  Closed form of the search through the counts."""
    most = F.least(col_of(steps), F.lit(MAX_FORECAST_POINTS))
    want = col_of(preferred).cast("double")
    nearest = F.ceil(want - 0.5)
    return F.when(_usable(want), F.greatest(F.lit(1), F.least(nearest, most))).otherwise(most).cast("int")


def request_shape(interval_minutes, cadence_minutes, preferred) -> list[Column]:
    """X15 as columns: interval, steps at the cadence, minutes they span, points shown and minutes between them."""
    interval = normalize_interval(interval_minutes)
    cadence = F.greatest(col_of(cadence_minutes), F.lit(1))
    steps = forecast_steps(interval, cadence)
    points = shown_points(steps, preferred)
    return [interval.alias("interval_minutes"), steps.alias("steps"), (steps * cadence).cast("long").alias("total_minutes"),
            points.alias("point_count"), F.bround(steps * cadence / points, 6).alias("display_step_minutes")]
