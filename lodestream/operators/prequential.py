"""Baselines and test-then-train metrics over runs: rows of run, seq, y (class index), p (predicted index).

Counts over the last w rows are differences of running counts, so a row costs the same for any w.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _upto(order: str):
    return Window.partitionBy("run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def _by(order: str):
    return Window.partitionBy("run").orderBy(order)


def no_change(labels: DataFrame) -> DataFrame:
    """p: the label before; class 0 at first."""
    return labels.withColumn("p", F.coalesce(F.lag("y").over(_by("seq")), F.lit(0)))


def majority(labels: DataFrame, classes: int) -> DataFrame:
    """p: the most frequent label so far (the least of equals); class 0 at first."""
    before = _by("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = [F.coalesce(F.count_if(F.col("y") == c).over(before), F.lit(0)) for c in range(classes)]
    df = labels.withColumns({f"_c{c}": n for c, n in enumerate(seen)})
    best = F.greatest(*[F.col(f"_c{c}") for c in range(classes)]) if classes > 1 else F.col("_c0")
    p = F.coalesce(*[F.when(F.col(f"_c{c}") == best, c) for c in range(classes)])
    return df.withColumn("p", p).drop(*[f"_c{c}" for c in range(classes)])


def _kappa(agree: Column, chance: Column) -> Column:
    return F.when(F.abs(1 - chance) < 1e-12, 0.0).otherwise((agree - chance) / (1 - chance))


def metrics(predicted: DataFrame, classes: int, window: int = 1000) -> DataFrame:
    """accuracy, kappa and temporal kappa, of all rows so far and of the last `window` rows.

    Rows whose label or prediction is out of range count for nothing. The no-change baseline of a run's first
    row is that row's own label in the window, and leaves it out in the cumulative form.
    """
    inside = F.col("y").between(0, classes - 1) & F.col("p").between(0, classes - 1)
    df = predicted.where(inside).withColumn("_ok", (F.col("y") == F.col("p")).cast("long"))
    before = F.lag("y").over(_by("seq"))
    df = df.withColumns({"_same": (F.coalesce(before, F.col("y")) == F.col("y")).cast("long"), "_same_later": F.coalesce((before == F.col("y")).cast("long"), F.lit(0))})
    running = {"_n": F.count(F.lit(1)), "_hits": F.sum("_ok"), "_stay": F.sum("_same"), "_stay_later": F.sum("_same_later")}
    for c in range(classes):
        running |= {f"_y{c}": F.count_if(F.col("y") == c), f"_p{c}": F.count_if(F.col("p") == c)}
    df = df.withColumns({k: v.over(_upto("seq")) for k, v in running.items()})
    df = df.withColumns({f"_w{k}": F.col(k) - F.coalesce(F.lag(k, window).over(_by("seq")), F.lit(0)) for k in running})

    def chance(prefix: str) -> Column:
        both = sum((F.col(f"{prefix}_y{c}").cast("double") * F.col(f"{prefix}_p{c}") for c in range(classes)), F.lit(0.0))
        return both / (F.col(f"{prefix}_n").cast("double") * F.col(f"{prefix}_n"))

    total, recent = F.col("_hits") / F.col("_n"), F.col("_w_hits") / F.col("_w_n")
    later = F.when(F.col("_n") > 1, F.col("_stay_later") / (F.col("_n") - 1)).otherwise(0.0)
    return df.select(
        "run",
        "seq",
        total.alias("accuracy"),
        _kappa(total, chance("")).alias("kappa"),
        _kappa(total, later).alias("kappa_temporal"),
        recent.alias("accuracy_recent"),
        _kappa(recent, chance("_w")).alias("kappa_recent"),
        _kappa(recent, F.col("_w_stay") / F.col("_w_n")).alias("kappa_temporal_recent"),
    )


def sampled(metric_rows: DataFrame, every: int) -> DataFrame:
    """Every n-th row of a run, and its last."""
    last = F.max("_i").over(Window.partitionBy("run"))
    df = metric_rows.withColumn("_i", F.row_number().over(_by("seq"))).withColumn("_last", last)
    return df.where((F.col("_i") % every == 0) | (F.col("_i") == F.col("_last"))).drop("_i", "_last")


def recovery(metric_rows: DataFrame, alarms: Column, metric: str = "accuracy", tolerance: float = 0.01, limit: int | None = None) -> DataFrame:
    """run, alarm_seq, recovered_after: rows from an alarm to the first later row (before the next alarm) whose metric is back.

    NULL where none is, or none of the first `limit` rows.
    """
    df = metric_rows.select("run", "seq", F.col(metric).alias("m"), alarms.alias("alarm"), F.row_number().over(_by("seq")).alias("i"))
    df = df.withColumn("session", F.sum(F.col("alarm").cast("int")).over(_upto("seq"))).where("session > 0")
    at = Window.partitionBy("run", "session").orderBy("seq")
    df = df.withColumns({"m0": F.first("m").over(at), "i0": F.first("i").over(at), "seq0": F.first("seq").over(at)})
    after = F.col("i") - F.col("i0")
    due = after > 0 if limit is None else after.between(1, limit)
    back = F.min(F.when(due & (F.col("m") >= F.col("m0") - tolerance), after))
    return df.groupBy("run", F.col("seq0").alias("alarm_seq")).agg(back.alias("recovered_after"))


def strict_stability(selected: DataFrame) -> DataFrame:
    """run, stability: share of samples whose selection (an array) equals the one before; 1 for a single sample."""
    df = selected.withColumn("_b", F.lag("selection").over(_by("seq"))).withColumn("_i", F.row_number().over(_by("seq")))
    same = F.avg(F.when(F.col("_i") > 1, (F.col("_b") == F.col("selection")).cast("double")))
    return df.groupBy("run").agg(F.coalesce(same, F.lit(1.0)).alias("stability"))


def ram_hours(memory: DataFrame, *ties: str) -> DataFrame:
    """run, mb_hours (trapezoid) and gb_hours (right rectangle) of samples run, seconds, mb; samples of one time go by `ties`."""
    w = Window.partitionBy("run").orderBy("seconds", *ties)
    hours = (F.col("seconds") - F.lag("seconds").over(w)) / 3600
    df = memory.withColumns({"_h": hours, "_m": (F.col("mb") + F.lag("mb").over(w)) / 2})
    return df.groupBy("run").agg(F.coalesce(F.sum(F.col("_h") * F.col("_m")), F.lit(0.0)).alias("mb_hours"), F.coalesce(F.sum(F.col("_h") * F.col("mb") / 1024), F.lit(0.0)).alias("gb_hours"))


def snapshot(predicted: DataFrame, classes: int) -> DataFrame:
    """The last metrics of each run, with its number of rows."""
    rows = metrics(predicted, classes).withColumn("n", F.row_number().over(_by("seq")))
    return rows.groupBy("run").agg(*[F.max_by(c, "seq").alias(c) for c in ("n", "accuracy", "kappa", "kappa_temporal")])


def progress(predicted: DataFrame, every: int) -> DataFrame:
    """run, n, accuracy after every `every` rows of a run."""
    by = _by("seq")
    hits = F.count_if(F.col("y") == F.col("p")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    rows = predicted.select("run", F.row_number().over(by).alias("n"), hits.alias("_hits"))
    return rows.where(F.col("n") % every == 0).select("run", F.col("n").cast("long").alias("n"), (F.col("_hits") / F.col("n")).alias("accuracy"))
