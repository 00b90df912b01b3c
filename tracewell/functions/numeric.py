"""Time, ratio and banding columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 with the fraction kept."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def duration_seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1e6)


def clamp_min(value: Column, lower: float) -> Column:
    return F.greatest(value, F.lit(lower))


def safe_ratio(part: Column, whole: Column) -> Column:
    """``part`` over ``whole``, the latter raised to at least one."""
    return part / clamp_min(whole, 1)


def band(value: Column, steps: Sequence[tuple[float | None, str]]) -> Column:
    """Colour of the highest step that ``value`` reaches; the first step has no lower edge."""
    picked = F.lit(steps[0][1])
    for edge, colour in steps[1:]:
        picked = F.when(value >= F.lit(edge), F.lit(colour)).otherwise(picked)
    return F.when(value.isNotNull(), picked)


# Panel thresholds.
SUCCESS_STEPS = ((None, "red"), (0.99, "green"))
BUDGET_STEPS = ((None, "red"), (0.25, "orange"), (0.5, "green"))
STALE_STEPS = ((None, "green"), (1.0, "red"))
AGE_STEPS = ((None, "green"), (1800.0, "orange"), (3600.0, "red"))
