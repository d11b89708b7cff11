"""Survey-style tables: joins to dimensions, unions of editions, imputation and code tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_dimensions(facts: DataFrame, persons: DataFrame, households: DataFrame, person_key: Sequence[str], household_key: Sequence[str]) -> DataFrame:
    """facts left-joined to both; whether a side is broadcast is decided by its size at run time."""
    return facts.join(persons, list(person_key), "left").join(households, list(household_key), "left")


def all_editions(editions: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns an edition lacks are NULL."""
    out = editions[0]
    for more in editions[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def imputed(df: DataFrame, medians: Sequence[str] = (), modes: Sequence[str] = ()) -> DataFrame:
    """NULLs replaced by the column's exact median or its most frequent value (the least of equals)."""
    fills = df.agg(*[F.median(c).alias(f"_m_{c}") for c in medians], *[F.mode(c, True).alias(f"_m_{c}") for c in modes])
    joined = df.crossJoin(F.broadcast(fills))  # one row
    return joined.select(*[F.coalesce(c, F.col(f"_m_{c}").cast(df.schema[c].dataType)).alias(c) if c in (*medians, *modes) else F.col(c) for c in df.columns])


def edition_starts(df: DataFrame, edition: str, order: Sequence[str]) -> DataFrame:
    """starts_edition: 1 on the first row of every edition but the earliest; `order` must tell an edition's rows apart."""
    firsts = df.groupBy(F.col(edition).alias("_edition")).agg(F.min(F.struct(*order)).alias("_first"))  # a row per edition
    earliest = Window.partitionBy()
    firsts = firsts.where(F.col("_edition").isNotNull()).withColumn("_late", F.col("_edition") > F.min("_edition").over(earliest))
    joined = df.join(F.broadcast(firsts), df[edition] == F.col("_edition"), "left")
    starts = F.coalesce(F.col("_late") & F.struct(*order).eqNullSafe(F.col("_first")), F.lit(False))
    return joined.withColumn("starts_edition", starts.cast("int")).drop("_edition", "_first", "_late")


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: rows, nulls, distinct values, least, greatest, mean and population deviation; one pass."""
    parts = []
    for c in columns:
        v = F.col(c).cast("double")
        parts += [F.struct(F.lit(c).alias("name"), F.count(F.lit(1)).alias("n_rows"), F.count_if(v.isNull()).alias("n_null"), F.count_distinct(v).alias("n_distinct"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("deviation"))]
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p"))
