"""Hourly windows with a watermark, change detectors kept as keyed state, and runs that event-time timers set in order.

`sample_windows` does not depend on how the stream is cut into micro-batches: rows wait in the state until the watermark has passed
them, and are then taken in order of time. Its warm-up is a phase of the state: a run's first values fill the reference. A
run that is silent for longer than `idle` begins afresh, and timers free what silent runs hold.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.drift import HoeffdingMean, SampleWindow, TwoLevel
from ..session import shared_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def hourly(events: DataFrame, key: str, late: str = "10 minutes") -> DataFrame:
    """key, hour, n_events, total of each hour that the watermark has closed; later rows are dropped by Spark."""
    rows = events.withColumn("_ts", F.col("ts").cast("timestamp")).withWatermark("_ts", late)
    counted = rows.groupBy(F.window("_ts", "1 hour"), key).agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total"))
    return counted.select(key, F.col("window.start").cast("timestamp_ntz").alias("hour"), "n_events", "total")


def alarms(predicted: DataFrame, alpha: float = 0.001) -> DataFrame:
    """run, seq of changes in the error of rows run, seq, y, p; the state of a run is four numbers.

    Rows of one micro-batch are taken in order of seq; batches must arrive in order.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        detector = HoeffdingMean(alpha)
        if state.exists:
            detector.n, detector.sum, detector.n_min, detector.sum_min = state.get
        rows = pd.concat(list(frames)).sort_values("seq")
        found = [s for s, wrong in zip(rows["seq"], rows["y"] != rows["p"]) if detector.add(float(wrong))]
        state.update((detector.n, detector.sum, detector.n_min, detector.sum_min))
        yield pd.DataFrame({"run": [key[0]] * len(found), "seq": found}).astype({"run": "int32", "seq": "int64"})

    return predicted.groupBy("run").applyInPandasWithState(step, "run int, seq long", "n long, sum double, n_min long, sum_min double", "append", GroupStateTimeout.NoTimeout)


def two_level_alarms(predicted: DataFrame, features: Sequence[str], size: int = 100, q: float = 0.05, alpha: float = 0.001) -> DataFrame:
    """run, seq, drifting: changes in the error of rows run, seq, y, p, and the features that drifted, by name.

    The state of a run is four numbers and two windows a feature. Rows of one micro-batch are taken in order of
    seq; batches must arrive in order.
    """
    state_type = "n long, sum double, n_min long, sum_min double, reference array<double>, n_reference array<int>, current array<double>, n_current array<int>"

    def cut(values: Sequence[float], lengths: Sequence[int]) -> list[list[float]]:
        ends = [sum(lengths[: i + 1]) for i in range(len(lengths))]
        return [list(values[e - n : e]) for e, n in zip(ends, lengths)]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        d = TwoLevel(len(features), size, q, HoeffdingMean(alpha))
        if state.exists:
            d.error.n, d.error.sum, d.error.n_min, d.error.sum_min, reference, n_reference, current, n_current = state.get
            for w, a, b in zip(d.windows, cut(reference, n_reference), cut(current, n_current)):
                w.reference, w.current = a, deque(b, maxlen=size)
        rows, found = pd.concat(list(frames)).sort_values("seq"), []
        for seq, wrong, values in zip(rows["seq"], rows["y"] != rows["p"], rows[list(features)].to_numpy(float).tolist()):
            drifting = d.add(float(wrong), values)
            if drifting is not None:
                found.append((key[0], seq, [features[i] for i in drifting]))
        parts = [[w.reference for w in d.windows], [list(w.current) for w in d.windows]]
        flat = [x for p in parts for x in ([float(v) for own in p for v in own], [len(own) for own in p])]
        state.update((d.error.n, float(d.error.sum), d.error.n_min, float(d.error.sum_min), *flat))
        yield pd.DataFrame(found, columns=["run", "seq", "drifting"]).astype({"run": "int32", "seq": "int64"})

    return predicted.groupBy("run").applyInPandasWithState(step, "run int, seq long, drifting array<string>", state_type, "append", GroupStateTimeout.NoTimeout)


class SampleWindows(StatefulProcessor):
    """Changes of the distribution of a run's values, by `drift.SampleWindow`, in order of time."""

    def __init__(self, size: int, alpha: float, every: int, idle: int) -> None:
        self.size, self.alpha, self.every, self.idle = size, alpha, every, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, seq long, x double")
        self.reference, self.current = handle.getListState("reference", "x double"), handle.getListState("current", "x double")
        self.told = handle.getValueState("told", "seen int, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            own = [(int(at), int(seq), float(x)) for at, seq, x in zip(pdf["at"], pdf["seq"], pdf["value"])]
            self.waiting.appendList(own)
            first = min([r[0] for r in own] + ([] if first is None else [first]))
        self.handle.registerTimer(first)
        yield pd.DataFrame({"run": [], "seq": []}).astype({"run": "int64", "seq": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        due = [r for r in waiting if r[0] <= now]
        window, last, found = SampleWindow(self.size, self.alpha, self.every), None, []
        if self.told.exists():
            window.seen, last = self.told.get()
            window.reference = [x for (x,) in self.reference.get()] if self.reference.exists() else []
            window.current.extend(x for (x,) in self.current.get()) if self.current.exists() else None
        for at, seq, x in due:
            if last is not None and at - last > self.idle:
                window.reset()
            if window.add(x):
                found.append(seq)
            last = at
        rest = waiting[len(due) :]
        if not rest and last is not None and last + self.idle < now:
            for state in (self.waiting, self.reference, self.current, self.told):
                state.clear()
        else:
            if due:
                self.waiting.put(rest) if rest else self.waiting.clear()
                for state, values in ((self.reference, window.reference), (self.current, window.current)):
                    state.put([(float(x),) for x in values]) if values else state.clear()
                self.told.update((window.seen, last))
            if rest or last is not None:  # neither where an earlier timer of the same batch has cleared the run
                self.handle.registerTimer(rest[0][0] if rest else last + self.idle + 1)
        yield pd.DataFrame({"run": [key[0]] * len(found), "seq": found}).astype({"run": "int64", "seq": "int64"})


def sample_windows(stream: DataFrame, late: str = "10 minutes", size: int = 100, alpha: float = 0.001, every: int = 1, idle: int = 1 << 40) -> DataFrame:
    """run, seq of the changes, once the watermark has passed them.

    stream: run (a whole number), seq, ts, value; NULL values are left out, rows later than `late` are dropped by Spark. Rows of one time
    go by seq. idle: milliseconds of silence after which a run begins afresh.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = stream.where("run IS NOT NULL AND value IS NOT NULL").select(F.col("run").cast("long").alias("run"), F.col("seq").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    rows = rows.withColumn("at", F.unix_millis("ts")).withWatermark("ts", late)
    return rows.groupBy("run").transformWithStateInPandas(SampleWindows(size, alpha, every, idle), "run long, seq long", "Append", "EventTime")


def slices(spark: SparkSession, events: DataFrame, ts: str, n: int, run) -> DataFrame:
    """run(stream), fed with the events in n slices of time. The query ends after each slice and starts again from its checkpoint when the next has landed."""
    folder = shared_folder(spark)
    ends = events.agg(F.unix_micros(F.min(ts).cast("timestamp")).alias("a"), F.unix_micros(F.max(ts).cast("timestamp")).alias("b")).first()
    if ends.a is None:
        ends = {"a": 0, "b": 0}
    width = (ends["b"] - ends["a"]) // n + 1
    at = F.floor((F.unix_micros(F.col(ts).cast("timestamp")) - ends["a"]) / width)
    for k in range(n):
        events.where(at == k).write.mode("append").parquet(f"{folder}/landed")
        out = run(spark.readStream.schema(events.schema).parquet(f"{folder}/landed"))
        found = finished(out, "append", folder)
    return found


def finished(stream: DataFrame, mode: str, folder: str | None = None) -> DataFrame:
    """All that the stream gives for the input there is now, written to the shared folder and read back.

    With the folder of an earlier call the query goes on from where that one ended, and what both gave is read back.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    query = writer.format("parquet").start(f"{folder}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
