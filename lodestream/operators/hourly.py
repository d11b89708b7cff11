"""Hourly demand per key and the features built on it."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush, heappushpop

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clock


def demand(events: DataFrame, key: str, low: float, high: float) -> DataFrame:
    """key, hour, n_events, avg_value, sum_value of the events whose value is within [low, high]."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    kept = events.where(F.col("value").between(low, high)).select(F.col(key), hour, "value")
    return kept.groupBy(key, "hour").agg(F.count(F.lit(1)).alias("n_events"), F.avg("value").alias("avg_value"), F.sum("value").alias("sum_value"))


def rolled(c: Column, by, n: int, f) -> Column:
    """f of the n values before the current row; NULL until there are n that are not NULL."""
    frame = by.rowsBetween(-n, -1)
    return F.when(F.count(c).over(frame) >= n, f(c).over(frame))


def lag_features(hourly: DataFrame, key: str, value: str, warm_up: int = 24) -> DataFrame:
    """Lags, their difference, and means and deviation of the past 4, 12 and 24 rows of each key; the first rows go."""
    w = Window.partitionBy(key).orderBy("hour")
    c = F.col(value)
    df = hourly.withColumns(
        {
            "lag_1": F.lag(c, 1).over(w),
            "lag_2": F.lag(c, 2).over(w),
            "delta": F.lag(c, 1).over(w) - F.lag(c, 2).over(w),
            "mean_4": rolled(c, w, 4, F.avg),
            "mean_12": rolled(c, w, 12, F.avg),
            "mean_24": rolled(c, w, 24, F.avg),
            "std_24": rolled(c, w, 24, F.stddev_samp),
            "row_num": F.row_number().over(w) - 1,
        }
    )
    return df.where(F.col("row_num") >= warm_up)


class RunningMedian:
    """Exact median of the values so far; None before the first. A value takes logarithmic time."""

    def __init__(self) -> None:
        self.below: list[float] = []  # the smaller half, negated, its greatest first
        self.above: list[float] = []

    def add(self, x: float) -> None:
        heappush(self.above, -heappushpop(self.below, -x))
        if len(self.above) > len(self.below):
            heappush(self.below, -heappop(self.above))

    def value(self) -> float | None:
        if not self.below:
            return None
        return -self.below[0] if len(self.below) > len(self.above) else (self.above[0] - self.below[0]) / 2


def past_median_label(hourly: DataFrame, key: str, value: str) -> DataFrame:
    """past_median, the exact median of all earlier rows of the key, and label HIGH above it, else LOW.

    Rows are read in order, key by key; a task holds the hours of one key, whose number the calendar bounds. NULL values enter no median.
    """
    hourly = hourly.drop("past_median")
    names = [*hourly.columns, "past_median"]
    k, v = names.index(key), names.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, past = object(), RunningMedian()
        for batch in batches:
            medians = []
            for of, x in zip(batch.column(k).to_pylist(), batch.column(v).to_pylist()):
                if of != current:
                    current, past = of, RunningMedian()
                medians.append(past.value())
                if x is not None:
                    past.add(float(x))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(medians, pa.float64())], names=names)

    rows = hourly.repartition(key).sortWithinPartitions(key, "hour")
    marked = rows.mapInArrow(run, T.StructType([*hourly.schema.fields, T.StructField("past_median", T.DoubleType())]))
    return marked.withColumn("label", F.when(F.col(value) > F.col("past_median"), "HIGH").otherwise("LOW"))


def cyclic_time(df: DataFrame, ts: str) -> DataFrame:
    t = F.col(ts)
    (hs, hc), (ds, dc) = clock.cyclic(F.hour(t), 24), clock.cyclic(F.weekday(t), 7)
    return df.withColumns({"hour_sin": hs, "hour_cos": hc, "day_sin": ds, "day_cos": dc, "weekend": clock.is_weekend(t), "holiday": clock.is_holiday(t)})


def neighbour_mean(values: DataFrame, adjacency: DataFrame, time: str, key: str, value: str, max_edges: int = 100_000) -> DataFrame:
    """values with neighbour_avg: the mean over the key's neighbours at that time; NULL if none has a value.

    adjacency: key, neighbour; a graph of fixed size, broadcast under a checked number of edges. The values go
    to their neighbours (an edge each) and are averaged before they meet the rows again.
    """
    edges = adjacency.select(F.col(key).alias("_to"), F.col("neighbour").alias("_from")).distinct()
    edges = F.broadcast(edges) if edges.limit(max_edges + 1).count() <= max_edges else edges
    sent = values.select(F.col(time), F.col(key).alias("_from"), F.col(value).alias("_v")).join(edges, "_from")
    means = sent.groupBy(time, F.col("_to").alias(key)).agg(F.avg("_v").alias("neighbour_avg"))
    return values.join(means, [time, key], "left")


def pivoted(events: DataFrame, key: str, values: list[str]) -> DataFrame:
    """day x key sums, absent pairs NULL."""
    return events.groupBy(F.to_date("ts").alias("day")).pivot(key, values).agg(F.sum("value"))
