"""Cleaning of columns: coercion, missing codes, clipping, buckets. NULL stays NULL unless said otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codes by which surveys mark a missing answer.
MISSING_CODES = (-1, -7, -8, -9)


def number(c: Column) -> Column:
    """As double; what is no number, NaN included, is NULL."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def unmasked(c: Column, codes: Sequence[int] = MISSING_CODES) -> Column:
    return F.when(~c.isin(*codes), c)


def clipped(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def ratio(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    """a / b where b is above zero."""
    return F.when(b > 0, a / b).otherwise(F.lit(otherwise).cast("double"))


def bucket(c: Column, upper: Sequence[float], labels: Sequence[str], low: float) -> Column:
    """Label of the right-closed interval that holds c; NULL outside (low, upper[-1]]."""
    out, last = None, low
    for top, label in zip(upper, labels, strict=True):
        test = (c > last) & (c <= top)
        out = F.when(test, label) if out is None else out.when(test, label)
        last = top
    return out


def mapped(c: Column, table: Mapping, otherwise: Column | None = None) -> Column:
    """Value of c in a small fixed table; `otherwise` where c is not listed."""
    pairs = F.create_map(*[F.lit(x) for x in chain(*table.items())])
    found = F.try_element_at(pairs, c)
    return found if otherwise is None else F.coalesce(found, otherwise)


def flag(c: Column, yes: int = 1) -> Column:
    """1 or 0 by equality; NULL stays."""
    return F.when(c.isNotNull(), (c == yes).cast("int"))


def direction(change: Column, margin: float = 0.005) -> Column:
    """UP, DOWN or NEUTRAL; NULL is NEUTRAL."""
    return F.when(change > margin, "UP").when(change < -margin, "DOWN").otherwise("NEUTRAL")


def moment(c: Column) -> Column:
    """As timestamp; what is no time is NULL."""
    return c.cast("string").try_cast("timestamp_ntz")


def complete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The rows without a NULL in any column, or in the given ones."""
    return df.dropna(subset=list(columns) if columns else None)


def interaction(*columns: Column) -> Column:
    """Product of columns; NULL if one is."""
    out = columns[0]
    for c in columns[1:]:
        out = out * c
    return out


def complement(p: Column) -> Column:
    """1 - p, with p clamped to [0, 1]; NULL stays."""
    return 1 - clipped(p, 0.0, 1.0)
