"""Sweeps: all runs of an experiment in one plan, keyed by run, each cut at its own number of instances.

A run is a configuration's data set, variant and seed. What the variants name is looked up in MODELS and DETECTORS; other names are an error.
Runs of one model share its plan; their rows differ by `run`. Results have a row after every `log_every` instances of a run and one at
its end, and are written to a folder a run by dynamic overwrite, so that a sweep that is started again does what is missing.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import small, stored
from . import drift, learners, prequential

RUN = ["experiment_group", "dataset", "variant", "seed"]
#: Up to so many runs are broadcast to the rows.
MOST_RUNS = 10_000
#: Rows of a data set that are kept together.
PIECE = 4096
LINES = "run int, instance_num long, accuracy double, kappa double, kappa_per double, drift_count long, recovery_time int"
#: name -> f(stream with run, seq, y, seed and features, features, classes), giving the stream with p.
MODELS: dict[str, Callable[[DataFrame, Sequence[str], int], DataFrame]] = {
    "NO_CHANGE": lambda stream, features, classes: prequential.no_change(stream),
    "MAJORITY": lambda stream, features, classes: prequential.majority(stream, classes),
    "RANDOM": lambda stream, features, classes: stream.withColumn("p", ((F.col("seq").cast("long") * 7919 + F.col("seed").cast("long") * 104729) % 1000003 % classes).cast("int")),
    "NAIVE_BAYES": lambda stream, features, classes: learners.naive_bayes(stream, features, classes),
}
DETECTORS: dict[str, Callable[[], object]] = {
    "HOEFFDING": drift.HoeffdingMean,
    "WEIGHTED": drift.WeightedMean,
    "ADAPTIVE_WINDOW": drift.AdaptiveWindow,
}


def _known(names: Sequence[str], registry: dict, what: str) -> list[str]:
    unknown = sorted(set(names) - set(registry))
    if unknown:
        raise ValueError(f"unknown {what}: {', '.join(unknown)}")
    return sorted(set(names))


def streams(data: DataFrame, runs: DataFrame) -> DataFrame:
    """The rows of each run: those of its data set below its max_instances, with run (a struct of RUN) and the run's settings.

    data: dataset, seq (from 0), y and the features; runs: RUN, model, detector, warmup, log_every, max_instances (below 1: no limit); a row a run.
    """
    own = runs.select("dataset", F.struct(*RUN).alias("run"), "seed", "model", "detector", "warmup", "log_every", F.when(F.col("max_instances") > 0, F.col("max_instances")).alias("_most"))
    met = data.join(small(stored(own, "runs"), MOST_RUNS), "dataset")
    return met.where(F.col("_most").isNull() | (F.col("seq") < F.col("_most"))).drop("_most")


def predicted(rows: DataFrame, features: Sequence[str], classes: int, models: Sequence[str]) -> DataFrame:
    """rows with p, each model's runs by its own plan."""
    parts = [MODELS[m](rows.where(F.col("model") == m), features, classes) for m in _known(models, MODELS, "models")]
    return reduce(DataFrame.unionByName, parts)


class NoChange:
    """The label before; class 0 at first and after a NULL."""

    def __init__(self, classes: int, seed: int) -> None:
        self.last = np.nan

    def predict(self, seq: np.ndarray, y: np.ndarray) -> np.ndarray:
        before = np.append(self.last, y[:-1])
        self.last = y[-1]
        return np.where(np.isnan(before), 0.0, before)


class Majority:
    """The most frequent label so far, the least of equals."""

    def __init__(self, classes: int, seed: int) -> None:
        self.seen = np.zeros(classes, int)

    def predict(self, seq: np.ndarray, y: np.ndarray) -> np.ndarray:
        upto = self.seen + np.equal.outer(y, np.arange(len(self.seen))).cumsum(axis=0)
        before = np.vstack([self.seen, upto[:-1]])
        self.seen = upto[-1]
        return before.argmax(axis=1).astype(float)


class Random:
    def __init__(self, classes: int, seed: int) -> None:
        self.classes, self.seed = classes, seed

    def predict(self, seq: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.fmod(np.fmod(seq * 7919 + self.seed * 104729, 1000003), self.classes).astype(float)


#: Those of MODELS that predict a run piece by piece and keep a few numbers; their rows are not copied for each run.
STEPPED = {"NO_CHANGE": NoChange, "MAJORITY": Majority, "RANDOM": Random}


class Followed:
    """One run, read piece by piece: its counts, its detector and its recovery."""

    def __init__(self, model: str, detector: str, seed: int, warmup: int | None, log_every: int | None, classes: int) -> None:
        self.model = STEPPED[model](classes, seed) if model in STEPPED else None
        self.detector, self.warmup, self.log_every, self.classes = DETECTORS[detector](), warmup, log_every, classes
        self.n = self.hits = self.stay = self.drifts = 0
        self.ys, self.ps = np.zeros(classes, int), np.zeros(classes, int)
        self.last, self.recovery, self.waits, self.row, self.logged = np.nan, None, None, None, False

    def piece(self, seq: np.ndarray, y: np.ndarray, p: np.ndarray | None, tolerance: float = 0.01) -> list[tuple]:
        """The logged rows of a piece. y, p: NaN where NULL."""
        p = self.model.predict(seq, y) if self.model else p
        told = np.flatnonzero(~np.isnan(y) & ~np.isnan(p) & (seq >= (np.inf if self.warmup is None else self.warmup)))
        fired = np.zeros(len(seq), bool)
        fired[told[drift.changes(self.detector, (p[told] != y[told]).astype(float))]] = True
        inside = (y >= 0) & (y < self.classes) & (p >= 0) & (p < self.classes)
        y, p, fired = y[inside], p[inside], fired[inside]
        if not len(y):
            return []
        kinds = np.arange(self.classes)
        n = self.n + np.arange(1, len(y) + 1)
        hits = self.hits + (y == p).cumsum()
        stay = self.stay + (np.append(self.last, y[:-1]) == y).cumsum()
        ys, ps = (so_far + np.equal.outer(x, kinds).cumsum(axis=0) for so_far, x in ((self.ys, y), (self.ps, p)))
        drifts = self.drifts + fired.cumsum()
        accuracy = hits / n
        back = self._recovered(n, accuracy, np.flatnonzero(fired), tolerance)
        logged = np.zeros(len(y), bool) if self.log_every is None else n % self.log_every == 0
        out = [self._line(i, n, accuracy, stay, ys, ps, drifts, back) for i in np.flatnonzero(logged)]
        self.row, self.logged = self._line(-1, n, accuracy, stay, ys, ps, drifts, back), bool(logged[-1])
        self.n, self.hits, self.stay, self.ys, self.ps, self.drifts, self.last = int(n[-1]), hits[-1], stay[-1], ys[-1], ps[-1], drifts[-1], y[-1]
        return out

    def _recovered(self, n: np.ndarray, accuracy: np.ndarray, alarms: np.ndarray, tolerance: float) -> list[tuple[int, int | None]]:
        """From which row of the piece on which recovery is the latest."""
        back = [(0, self.recovery)]
        for at, end in zip([-1, *alarms], [*alarms, len(n)]):
            if at >= 0:
                self.waits = (accuracy[at], n[at])
            if self.waits:
                there = np.flatnonzero(accuracy[at + 1 : end] >= self.waits[0] - tolerance)
                if len(there):
                    i = at + 1 + there[0]
                    self.recovery, self.waits = int(n[i] - self.waits[1]), None
                    back.append((i, self.recovery))
        return back

    def _line(self, i: int, n: np.ndarray, accuracy: np.ndarray, stay: np.ndarray, ys: np.ndarray, ps: np.ndarray, drifts: np.ndarray, back: list) -> tuple:
        total, rows = float(accuracy[i]), float(n[i])
        both = 0.0
        for a, b in zip(ys[i].tolist(), ps[i].tolist()):
            both += float(a) * b
        kappa = lambda chance: 0.0 if abs(1 - chance) < 1e-12 else (total - chance) / (1 - chance)
        later = float(stay[i]) / (rows - 1) if rows > 1 else 0.0
        at = i % len(n)
        return int(n[i]), total, kappa(both / (rows * rows)), kappa(later), int(drifts[i]), back[bisect.bisect_right(back, at, key=lambda x: x[0]) - 1][1]


def _pieces(rows: DataFrame, *by: str) -> DataFrame:
    """by, piece, first, seqs, cells (y, and p where there is one): up to PIECE rows in order; seqs is NULL where they leave no gap."""
    own = [c for c in ("y", "p") if c in rows.columns]
    at = F.array_sort(F.collect_list(F.struct(F.col("seq").cast("long").alias("seq"), *[F.col(c).cast("int").alias(c) for c in own])))
    found = rows.groupBy(*by, F.floor(F.col("seq") / PIECE).alias("piece")).agg(at.alias("_at"))
    first, seqs = F.col("_at")[0]["seq"], F.col("_at.seq")
    gaps = F.element_at(seqs, -1) - first + 1 != F.size("_at")
    ps = F.col("_at.p") if "p" in own else F.lit(None).cast("array<int>")
    return found.select(*by, "piece", first.alias("first"), F.when(gaps, seqs).alias("seqs"), F.col("_at.y").alias("ys"), ps.alias("ps"))


def _followed(pieces: DataFrame, classes: int, tasks: int) -> DataFrame:
    """run and the logged rows of all runs: a task reads its runs in order and holds a batch of pieces."""
    numbers = lambda x: x.values.cast(pa.float64()).fill_null(np.nan).to_numpy()  # noqa: E731  a list scalar

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, run, settings = None, None, ["model", "detector", "seed", "warmup", "log_every"]
        for batch in batches:
            out = []
            column = {c: batch.column(c) for c in batch.schema.names}
            for i in range(batch.num_rows):
                own = column["run"][i].as_py()
                if own != known:
                    if run and run.row and not run.logged:
                        out.append((known, *run.row))
                    known, run = own, Followed(*(column[c][i].as_py() for c in settings), classes)
                y, given = numbers(column["ys"][i]), column["seqs"][i]
                seq = given.values.to_numpy() if given.is_valid else column["first"][i].as_py() + np.arange(len(y))
                p = numbers(column["ps"][i]) if column["ps"][i].is_valid else None
                most = column["_most"][i].as_py()
                if most is not None and seq[-1] >= most:
                    seq = seq[: np.searchsorted(seq, most)]
                    y, p = y[: len(seq)], None if p is None else p[: len(seq)]
                if len(seq):
                    out += [(own, *line) for line in run.piece(seq, y, p)]
            yield _batch(out)
        if run and run.row and not run.logged:
            yield _batch([(known, *run.row)])

    ordered = pieces.repartitionById(tasks, F.pmod("run", F.lit(tasks)).cast("int")).sortWithinPartitions("run", "piece")
    return ordered.mapInArrow(lines, LINES)


def _batch(lines: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    fields = [c.split() for c in LINES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in lines], kinds[k]) for i, (_, k) in enumerate(fields)], names=[c for c, _ in fields])


def results(data: DataFrame, runs: DataFrame, features: Sequence[str], classes: int) -> DataFrame:
    """RUN, instance_num, accuracy, kappa, kappa_per, drift_count, recovery_time (of the latest drift that has recovered).

    Rows are gathered in pieces, each run's are read in order once; those of STEPPED models are labels alone.
    """
    named = runs.select("model", "detector").distinct().collect()  # from the configuration
    models = _known([r.model for r in named], MODELS, "models")
    _known([r.detector for r in named], DETECTORS, "detectors")
    most = F.when(F.col("max_instances") > 0, F.col("max_instances")).cast("long").alias("_most")
    settings = [F.col(c).cast("long").alias(c) for c in ("warmup", "log_every")]
    own = stored(runs.select(*RUN, "model", "detector", *settings, most, F.row_number().over(Window.orderBy(*RUN)).alias("run")), "runs")
    held = small(own, MOST_RUNS)
    settings = ["model", "detector", F.col("seed").cast("long").alias("seed"), "warmup", "log_every", "_most"]
    parts = []
    if set(models) & set(STEPPED):
        met = _pieces(data, "dataset").join(held.where(F.col("model").isin(*STEPPED)), "dataset")
        parts.append(met.where(F.col("_most").isNull() | (F.col("first") < F.col("_most"))).select("run", *settings, "piece", "first", "seqs", "ys", "ps"))
    others = sorted(set(models) - set(STEPPED))
    if others:
        rows = data.join(held.where(F.col("model").isin(*others)).select("dataset", "run", "seed", "model", "_most"), "dataset")
        found = predicted(rows.where(F.col("_most").isNull() | (F.col("seq") < F.col("_most"))), features, classes, others)
        parts.append(_pieces(found.select("run", "seq", "y", "p"), "run").join(held, "run").select("run", *settings, "piece", "first", "seqs", "ys", "ps"))
    lines = _followed(reduce(DataFrame.unionByName, parts), classes, max(1, min(own.count(), MOST_RUNS)))
    return lines.join(held.select("run", *RUN), "run").select(*RUN, "instance_num", "accuracy", "kappa", "kappa_per", "drift_count", "recovery_time")


def missing(spark: SparkSession, runs: DataFrame, path: str) -> DataFrame:
    """The runs that have no folder of results yet."""
    try:
        there = spark.read.parquet(path).select(*[F.col(c).cast("string").alias(c) for c in RUN]).distinct()
    except AnalysisException as error:
        if error.getCondition() and ("PATH_NOT_FOUND" in error.getCondition() or "UNABLE_TO_INFER_SCHEMA" in error.getCondition()):
            return runs
        raise
    same = [runs[c].cast("string").eqNullSafe(there[c]) for c in RUN]
    return runs.join(F.broadcast(there), same, "left_anti")


def run(data: DataFrame, runs: DataFrame, features: Sequence[str], classes: int, path: str) -> DataFrame:
    """Do the runs that have no results in path, and read the results of all runs there are."""
    spark = data.sparkSession
    todo = missing(spark, runs, path)
    if not todo.isEmpty():
        out = results(data, todo, features, classes)
        out.repartition(*RUN).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*RUN).parquet(path)
    return spark.read.parquet(path)
