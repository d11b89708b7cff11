"""Clock and calendar features of timestamps."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month * 100 + day of ten holidays, taken as the same every year.
HOLIDAYS = (101, 115, 219, 527, 619, 704, 902, 1111, 1128, 1225)


def cyclic(c: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a position in a period."""
    angle = c * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def is_weekend(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def is_holiday(ts: Column) -> Column:
    return (F.month(ts) * 100 + F.dayofmonth(ts)).isin(*HOLIDAYS).cast("int")


def minutes_between(start: Column, end: Column) -> Column:
    seconds = F.timestamp_diff("SECOND", start, end)
    return seconds / 60.0


def hour_of_hhmm(c: Column) -> Column:
    return F.floor(c / 100).cast("int")
