"""Drift: two-sample Kolmogorov-Smirnov windows with Benjamini-Hochberg control, and sequential error detectors."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import groupby
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

TERMS = 100
#: Up to so many rows a running total is one window; beyond, groups are cut into ranges.
FEW = 200_000


def ranged_sums(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """df with `upto_x` and `all_x` for each x of sums: its total up to the row in its group, and over the group.

    Beyond FEW rows groups are cut into ranges, however few or long they are: rows are sorted by ranges and stored, a row per range
    (a few for each task) is summed up, and each range goes on from the total of those before it. `order` must tell a group's rows apart.
    """
    keys = list(by)
    df = stored(df, "rows")
    if df.limit(FEW + 1).count() <= FEW:
        whole = Window.partitionBy(*keys)
        upto = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select(*df.columns, *[F.sum(x).over(upto).alias(f"upto_{x}") for x in sums], *[F.sum(x).over(whole).alias(f"all_{x}") for x in sums])
    pieces = stored(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = pieces.groupBy(*keys, "_range").agg(*[F.sum(x).alias(f"_{x}") for x in sums])
    group = Window.partitionBy(*keys)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(c).alias(f"_of_{c}") for c in (*keys, "_range")], *[F.coalesce(F.sum(f"_{x}").over(before), F.lit(0)).alias(f"_before_{x}") for x in sums], *[F.sum(f"_{x}").over(group).alias(f"all_{x}") for x in sums])
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys] + [F.col("_range") == F.col("_of__range")]
    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = pieces.join(offsets, reduce(and_, same))
    return joined.select(*df.columns, *[(F.col(f"_before_{x}") + F.sum(x).over(within)).alias(f"upto_{x}") for x in sums], *[f"all_{x}" for x in sums])


def positions(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df without the columns of order, with `seq`: the position (from 0) of a row in its group.

    Beyond FEW rows groups are sorted by ranges, however few or long they are, and stored; a range goes on from the rows of those before it.
    """
    keep = [c for c in df.columns if c not in order]
    if df.limit(FEW + 1).count() <= FEW:
        return df.select(*keep, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long").alias("seq"))
    ranged = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    ranged = stored(ranged.select(*keep, F.monotonically_increasing_id().alias("_at")), "ranged").withColumn("_range", F.shiftright("_at", 33))  # the number of the task
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(*by, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    starts = starts.select(*[F.col(c).alias(f"_of_{c}") for c in (*by, "_range")], (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by] + [F.col("_range") == F.col("_of__range")]
    return ranged.join(starts, reduce(and_, same)).select(*keep, (F.col("_at") + F.col("_shift")).alias("seq"))


def _points(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    return samples.groupBy(*by, "value").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))


def _distance(steps: DataFrame, by: Sequence[str]) -> DataFrame:
    gap = F.abs(F.try_divide("upto_a", "all_a") - F.try_divide("upto_b", "all_b"))
    return steps.groupBy(*by).agg(F.max("all_a").alias("n0"), F.max("all_b").alias("n1"), F.max(gap).alias("ks"))


def distance(samples: DataFrame, *by: str) -> DataFrame:
    """by, n0, n1, ks: the greatest difference of the two samples' distribution functions; NULL without one of them.

    samples: by, side (0 or 1), value. Equal values are counted first, so the ordered pass is over distinct values.
    For many groups that fit a task each; see `long_distance` for few and long ones.
    """
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.sum(x).over(w).alias(f"{name}_{x}") for x in "ab" for name, w in (("upto", upto), ("all", whole))]
    return _distance(_points(samples, by).select(*by, *sums), by)


def long_distance(samples: DataFrame, *by: str) -> DataFrame:
    """As `distance`, for groups of any length: their distinct values spread over tasks by ranges."""
    return _distance(ranged_sums(_points(samples, by), by, ["value"], ["a", "b"]), by)


def p_value(ks: Column, n0: Column, n1: Column) -> Column:
    """Asymptotic two-sample p-value, by its alternating series."""
    x = ks * ks * (n0 * n1 / (n0 + n1))
    terms = F.transform(F.sequence(F.lit(1), F.lit(TERMS)), lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x))
    total = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
    return F.when(ks == 0, 1.0).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def windows(stream: DataFrame, key: str, seq: str, value: str, size: int) -> DataFrame:
    """The reference (first `size` rows of a key) as side 0 and the current window (last `size` rows after it) as side 1."""
    w = Window.partitionBy(key)
    df = stream.select(key, F.col(value).alias("value"), F.row_number().over(w.orderBy(seq)).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    df = df.where((F.col("n") >= 2 * size) & ((F.col("i") <= size) | (F.col("i") > F.col("n") - size)))
    return df.select(key, "value", (F.col("i") > size).cast("int").alias("side"))


def discoveries(tests: DataFrame, p: str, q: float = 0.05) -> DataFrame:
    """drift: whether each test is among those up to the largest rank r with p <= r q / m. A NULL p is no test.

    Equal p are counted first and ranked by ranges; what is compared with all tests is one row, the greatest such p.
    """
    points = tests.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("n"))
    ranks = ranged_sums(points, [], ["_p"], ["n"])
    cut = ranks.agg(F.max(F.when(F.col("_p") <= F.col("upto_n") * q / F.col("all_n"), F.col("_p"))).alias("_cut"))
    return tests.crossJoin(F.broadcast(cut)).withColumn("drift", F.coalesce(F.col(p) <= F.col("_cut"), F.lit(False))).drop("_cut")  # one row


class HoeffdingMean:
    """Change of a mean of values in [0, 1] upwards, by Hoeffding's bound against the prefix with the least mean."""

    def __init__(self, alpha: float = 0.001) -> None:
        if not 0 < alpha < 1:
            raise ValueError("alpha must lie in (0, 1)")
        self.alpha = alpha
        self.n, self.sum, self.n_min, self.sum_min = 0, 0.0, 0, 0.0

    def add(self, x: float) -> bool:
        self.n += 1
        self.sum += x
        bound = lambda n: math.sqrt(math.log(1 / self.alpha) / (2 * n))
        if not self.n_min or self.sum / self.n + bound(self.n) <= self.sum_min / self.n_min + bound(self.n_min):
            self.n_min, self.sum_min = self.n, self.sum
        if self.n == self.n_min:
            return False
        m = (self.n - self.n_min) / (self.n * self.n_min)
        if self.sum / self.n - self.sum_min / self.n_min < math.sqrt(m / 2 * math.log(2 / self.alpha)):
            return False
        self.__init__(self.alpha)
        return True


    def changes(self, values: np.ndarray) -> list[int]:
        """The positions of values at which `add` tells of a change."""
        found, at, width = [], 0, 256
        while at < len(values):
            own = values[at : at + width]
            n, total = self.n + np.arange(1, len(own) + 1), self.sum + own.cumsum()
            limit = total / n + np.sqrt(math.log(1 / self.alpha) / (2 * n))
            before = np.inf if not self.n_min else self.sum_min / self.n_min + math.sqrt(math.log(1 / self.alpha) / (2 * self.n_min))
            better = limit <= np.minimum.accumulate(np.append(before, limit[:-1]))
            best = np.maximum.accumulate(np.where(better, np.arange(len(own)), -1))
            n_min, sum_min = np.where(best < 0, self.n_min, n[best]), np.where(best < 0, self.sum_min, total[best])
            over = (n > n_min) & (total / n - sum_min / n_min >= np.sqrt((n - n_min) / (n * n_min) / 2 * math.log(2 / self.alpha)))
            if over.any():
                found.append(at + int(over.argmax()))
                at, width = found[-1] + 1, 256
                self.__init__(self.alpha)
            else:
                self.n, self.sum, self.n_min, self.sum_min = int(n[-1]), float(total[-1]), int(n_min[-1]), float(sum_min[-1])
                at, width = at + len(own), 2 * width
        return found


class AdaptiveWindow:
    """Change of a mean in either direction: the window drops its oldest part while two of its parts differ.

    Values are kept as sums over parts of 1, 2, 4, ... values, at most `per_size` of a size.
    """

    def __init__(self, delta: float = 0.002, per_size: int = 5, every: int = 32, least: int = 5) -> None:
        if not 0 < delta < 1:
            raise ValueError("delta must lie in (0, 1)")
        self.delta, self.per_size, self.every, self.least = delta, per_size, every, least
        self.parts: list[list[float]] = []  # oldest first: number, sum, sum of squares
        self.seen = 0

    def add(self, x: float) -> bool:
        self.parts.append([1, x, x * x])
        self.seen += 1
        size, end = 1, len(self.parts)
        while True:
            start = end
            while start and self.parts[start - 1][0] == size:
                start -= 1
            if end - start <= self.per_size:
                break
            a, b = self.parts[start], self.parts[start + 1]
            self.parts[start : start + 2] = [[p + q for p, q in zip(a, b)]]
            size, end = size * 2, start + 1
        return self.seen % self.every == 0 and self._shrink()

    def _shrink(self) -> bool:
        changed = False
        while self._differs():
            self.parts.pop(0)
            changed = True
        return changed

    def _differs(self) -> bool:
        n, s, q = (sum(p[i] for p in self.parts) for i in range(3))
        if n < 2 * self.least:
            return False
        variance, log = max(q / n - (s / n) ** 2, 0.0), math.log(2 * math.log(n) / self.delta)
        n0 = s0 = 0.0
        for part in self.parts[:-1]:
            n0, s0 = n0 + part[0], s0 + part[1]
            n1 = n - n0
            if n0 >= self.least and n1 >= self.least:
                m = 1 / n0 + 1 / n1
                if abs(s0 / n0 - (s - s0) / n1) > math.sqrt(2 * m * variance * log) + 2 / 3 * m * log:
                    return True
        return False


class WeightedMean:
    """Change of a mean upwards that favours recent values: exponential means under McDiarmid's bound.

    One mean holds the values up to the least upper limit so far, the other those after it. `warning` tells
    whether the last value passed the looser level `warn` without being a change.
    """

    def __init__(self, alpha: float = 0.001, warn: float = 0.005, rate: float = 0.05) -> None:
        if not (0 < alpha <= warn < 1 and 0 < rate < 1):
            raise ValueError("0 < alpha <= warn < 1 and 0 < rate < 1")
        self.alpha, self.warn, self.rate = alpha, warn, rate
        self.warning = False
        self._clear()

    def _clear(self) -> None:
        self.whole = self.before = self.after = None  # each: mean, sum of squared weights

    def _with(self, state: tuple | None, x: float) -> tuple:
        if state is None:
            return x, 1.0
        return state[0] + self.rate * (x - state[0]), self.rate**2 + (1 - self.rate) ** 2 * state[1]

    @staticmethod
    def _bound(weight: float, alpha: float) -> float:
        return math.sqrt(weight * math.log(1 / alpha) / 2)

    def add(self, x: float) -> bool:
        self.whole, self.after = self._with(self.whole, x), self._with(self.after, x)
        limit = lambda s: s[0] + self._bound(s[1], self.alpha)
        if self.before is None or limit(self.whole) < limit(self.before):
            self.before, self.after = self.whole, None
        self.warning = False
        if self.after is None:
            return False
        rise, weight = self.after[0] - self.before[0], self.before[1] + self.after[1]
        if rise > self._bound(weight, self.alpha):
            self._clear()
            return True
        self.warning = rise > self._bound(weight, self.warn)
        return False


class SampleWindow:
    """Change of a distribution: the first `size` values against the last `size` after them, by the two-sample test.

    On a change the current window becomes the reference; both can be set by hand. Tested at every `every`-th value.
    """

    def __init__(self, size: int = 100, alpha: float = 0.001, every: int = 1) -> None:
        if size < 2 or not 0 < alpha < 1 or every < 1:
            raise ValueError("size from 2, alpha in (0, 1), every from 1")
        self.size, self.alpha, self.every = size, alpha, every
        self.reset()

    def reset(self) -> None:
        self.reference: list[float] = []
        self.current: deque[float] = deque(maxlen=self.size)
        self.seen = 0

    def set_reference(self, values: list[float]) -> None:
        if len(values) != self.size:
            raise ValueError(f"a reference holds {self.size} values")
        self.reference = sorted(values)

    def promote(self) -> None:
        """The current window becomes the reference."""
        if len(self.current) < self.size:
            raise ValueError("the current window is not full")
        self.reference = sorted(self.current)
        self.current.clear()

    def p_value(self) -> float:
        if len(self.reference) < self.size or len(self.current) < self.size:
            return 1.0
        a, b = np.array(self.reference), np.sort(np.array(self.current))
        at = np.concatenate([a, b])
        ks = np.abs(np.searchsorted(a, at, "right") - np.searchsorted(b, at, "right")).max() / self.size
        k = np.arange(1, TERMS + 1)
        return 1.0 if ks == 0 else float(np.clip((np.where(k % 2, 2.0, -2.0) * np.exp(-k * k * ks * ks * self.size)).sum(), 0, 1))

    def take(self, x: float) -> bool:
        """Hold a value without a test; whether it went to the current window."""
        if len(self.reference) < self.size:
            self.reference.append(x)
            if len(self.reference) == self.size:
                self.reference.sort()
            return False
        self.current.append(x)
        self.seen += 1
        return True

    def add(self, x: float) -> bool:
        if not self.take(x) or self.seen % self.every or self.p_value() >= self.alpha:
            return False
        self.promote()
        return True


class TwoLevel:
    """A detector of the error, and a sample window per feature that is tested only when the error alarms.

    The tests of an alarm share one false discovery rate; the features found start a new reference.
    """

    def __init__(self, features: int, size: int = 100, q: float = 0.05, error: object | None = None) -> None:
        self.q = q
        self.error = error or HoeffdingMean()
        self.windows = [SampleWindow(size) for _ in range(features)]

    def add(self, wrong: float, values: list[float]) -> list[int] | None:
        """None without an alarm, else the numbers of the drifting features; a missing value enters no window."""
        for w, x in zip(self.windows, values, strict=True):
            if x is not None and x == x:
                w.take(float(x))
        if not self.error.add(wrong):
            return None
        ranked = sorted((w.p_value(), i) for i, w in enumerate(self.windows))
        last = max((r for r, (p, _) in enumerate(ranked, 1) if p <= r * self.q / len(ranked)), default=0)
        found = sorted(i for _, i in ranked[:last])
        for i in found:
            if len(self.windows[i].current) == self.windows[i].size:
                self.windows[i].promote()
        return found


def changes(detector: object, values: np.ndarray) -> list[int]:
    """The positions of values at which a detector, which goes on from what it has seen, tells of a change."""
    if hasattr(detector, "changes"):
        return detector.changes(values)
    return [i for i, x in enumerate(values.tolist()) if detector.add(x)]


def alarms(stream: DataFrame, key: str, seq: str, value: str, detector: Callable[[], object]) -> DataFrame:
    """key, seq of each change found. Rows are read in order, key by key; a task holds one detector's state only."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), None
        for pdf in frames:
            found = []
            for k, rows in groupby(zip(pdf[key], pdf[seq], pdf[value]), lambda r: r[0]):
                if k != current:
                    current, state = k, detector()
                found += [(k, s) for _, s, x in rows if state.add(float(x))]
            yield pd.DataFrame(found, columns=[key, seq]).astype({seq: "int64"})

    rows = stream.select(key, F.col(seq).cast("long").alias(seq), value).where(F.col(value).isNotNull())
    kind = stream.schema[key].dataType.simpleString()
    return rows.repartition(key).sortWithinPartitions(key, seq).mapInPandas(run, f"{key} {kind}, {seq} long")
