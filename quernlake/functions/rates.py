"""Rates, signals and rounding of the metric contracts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An alert needs both a rise in percentage points and an excess of sessions.
ALERT_POINTS, ALERT_SESSIONS = 5.0, 20


def safe_rate(part: Column, whole: Column) -> Column:
    """part / whole as a double; NULL where whole is 0 or NULL."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def no_attempt_signal(count: Column, total: Column, before: Column, total_before: Column) -> Column:
    """Struct of both rates, their change in points, the sessions expected and in excess, and whether to alert.

    Expected sessions follow the previous rate; without a previous period all are as expected.  The excess rounds half
    to even.
    """
    rate, rate_before = safe_rate(count, total), safe_rate(before, total_before)
    expected = F.coalesce(total * rate_before, count.cast("double"))
    excess = F.greatest(F.lit(0).cast("long"), F.bround(count - expected, 0).cast("long"))
    points = (rate - rate_before) * 100
    return F.struct(
        rate.alias("rate"), rate_before.alias("previous_rate"), points.alias("change_pp"), expected.alias("expected"), excess.alias("excess"),
        F.coalesce((points >= ALERT_POINTS) & (excess >= ALERT_SESSIONS), F.lit(False)).alias("alert"),
    )


def percentile(column: Column, fraction: float) -> Column:
    """Exact percentile with linear interpolation; NULLs are ignored and an empty group gives NULL.

    The aggregate holds a group's distinct values in one task; ``operators.ordered.percentiles`` holds none.
    """
    return F.percentile(column, F.lit(fraction))


def price(tokens_in: Column, cached: Column, tokens_out: Column, per_in: float, per_cached: float, per_out: float, billed: Column | None = None) -> Column:
    """Cost of a request: cached input tokens have their own price; a cost that the provider billed wins."""
    hit = F.least(F.greatest(cached, F.lit(0)), tokens_in)
    own = (tokens_in - hit) * per_in + hit * per_cached + tokens_out * per_out
    return own if billed is None else F.coalesce(billed, own)
