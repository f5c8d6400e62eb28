"""Tables for one fire event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlattice.operators.clean import in_box, in_month, on_month_day
from emberlattice.operators.joins import left_join_zero


def event_day(df: DataFrame, month_day: str, box: Sequence[float] | None = None) -> DataFrame:
    """Rows of the event's month and day, optionally inside a box."""
    rows = on_month_day(df, month_day)
    return rows if box is None else rows.where(in_box(box))


def high_days_with_zero(
    df: DataFrame, value: str, box: Sequence[float], month: int = 10, threshold: float = 40.0
) -> DataFrame:
    """All points of the box with their day count above the threshold, 0 where none: the explicit
    left-join form of ``exceedance_days``."""
    rows = in_month(df, month).where(in_box(box))
    keys = ["latitude", "longitude"]
    points = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_days"))
    high = rows.where(F.col(value) > threshold).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("high_fwi_days")
    )
    return left_join_zero(points, high, keys)
