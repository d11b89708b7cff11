"""Code tables of travel surveys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import mapped

# Purpose buckets of reason-for-trip codes and of trip-purpose names.
REASONS = {1: 1, 2: 2, 3: 2, 4: 2, 5: 6, 6: 7, 7: 9, 8: 3, 9: 3, 10: 3, 11: 4, 12: 4, 13: 5, 14: 4, 15: 6, 16: 6, 17: 6, 18: 8, 19: 6, 97: 9}
PURPOSES = {"HBW": 2, "HBO": 9, "NHB": 9, "HBSHOP": 4, "HBSOCREC": 6, "HBSCHOOL": 3, "HBC": 6, "HBMED": 8}
# Ranges of mode-of-transport codes.
MODES = {"PRIVATE_VEHICLE": (1, 7), "PUBLIC_TRANSIT": (10, 16), "ACTIVE": (17, 19)}


def purpose(reason: Column, name: Column) -> Column:
    """Bucket of the reason code; else of the purpose: its name, or its number where that is 1 to 10."""
    number = name.cast("string").try_cast("double")
    listed = mapped(F.upper(name.cast("string")), PURPOSES)
    return F.coalesce(mapped(reason.cast("int"), REASONS), listed, F.when(number.between(1, 10), number.cast("int")))


def transport_mode(code: Column) -> Column:
    """Name of the group of modes that holds the code; NULL for other codes."""
    out = F.lit(None).cast("string")
    for name, (low, high) in MODES.items():
        out = F.when(code.between(low, high), name).otherwise(out)
    return out
