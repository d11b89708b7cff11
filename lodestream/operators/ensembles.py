"""A drift-aware ensemble, tested and then trained block by block, as joins and windows over class moments.

A stream has rows run, seq, y (a class from 0) and its features. A run is cut into blocks of `size` rows; a block
is predicted by what was learned up to the block before. Learners are Gaussian naive Bayes models on subspaces of
the features, and the subspaces evolve. After each block every feature is scored and tested against the block before (two
samples, one false discovery rate for a run's block), and each learner is dealt with by its share of drifting features:

* KEEP: none drifts;
* SURGICAL: some do, and are swapped, in the order of the subspace, for the best-scored others that do not drift, where these score
  more. What stays keeps what it has learned, what comes learns from this block on;
* NO_REPLACEMENT: some do, but none of the others would gain;
* FULL: many do; the learner draws a new subspace of the same size, by weight and without the drifting features while there
  are enough others, and learns afresh from this block on.

With `alarms` learners are touched only after blocks in which an error detector fired.

Nothing is learned row by row: a block's counts, sums and squares by feature and class are matrix products, and what a learner
knows is their sum since the feature came. Rows are dealt by run and read block by block in Arrow batches; a task holds one block and one
run's sums. Only a block's scores, one row, reach the fold that keeps the subspaces.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import drift, folds, ranking

ACTIONS = ("KEEP", "SURGICAL", "NO_REPLACEMENT", "FULL")


def blocks(stream: DataFrame, size: int) -> DataFrame:
    """The stream with its block, counted from 0; seq counts a run's rows from 0."""
    return stream.withColumn("block", F.floor(F.col("seq") / size))


def _long(blocked: DataFrame, features: Sequence[str]) -> DataFrame:
    return ranking.unpivoted(blocked, features, "run", "block", "y")


def block_distances(blocked: DataFrame, features: Sequence[str]) -> DataFrame:
    """run, block, feature, n0, n1, ks: the greatest difference of a block's distribution function from that of the block before.

    A window by run brings each run into one task, in the order of its blocks; a task holds two blocks at a time. A NULL is a value below all others.
    """
    names = [f"_x{i}" for i in range(len(features))]
    order = F.row_number().over(Window.partitionBy("run").orderBy("block")).alias("_i")
    rows = blocked.select("run", "block", order, *[F.col(f).cast("double").alias(x) for f, x in zip(features, names)]).sortWithinPartitions("run", "block")
    kinds = ", ".join(f"{c} {blocked.schema[c].dataType.simpleString()}" for c in ("run", "block"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return folds.batched(_distances(batches, list(features), names))

    return rows.mapInArrow(of, f"{kinds}, feature string, n0 long, n1 long, ks double")


def _sample(column: pa.ChunkedArray) -> tuple[int, int, np.ndarray]:
    """Number of rows, of NULLs, and the other values in order."""
    return len(column), column.null_count, np.sort(column.drop_null().to_numpy())


def _ks(a: tuple[int, int, np.ndarray], b: tuple[int, int, np.ndarray]) -> float:
    (n0, nulls0, x), (n1, nulls1, y) = a, b
    at = np.concatenate([x, y])
    gaps = np.abs((nulls0 + np.searchsorted(x, at, "right")) / n0 - (nulls1 + np.searchsorted(y, at, "right")) / n1)
    return float(max(gaps.max(initial=0.0), abs(nulls0 / n0 - nulls1 / n1)))


def _distances(batches: Iterator[pa.RecordBatch], features: list[str], names: list[str]) -> Iterator[pa.Table]:
    """Rows come by run and block."""
    before = None
    for (run, block), rows in folds.blocks(batches):
        own = [_sample(rows.column(x)) for x in names]
        if before is not None and before[0] == run and before[1] + 1 == block:
            n0, n1, ks = zip(*[(a[0], b[0], _ks(a, b)) for a, b in zip(before[2], own)])
            of = pa.array([0] * len(features))
            yield pa.table({"run": rows.column("run").take(of), "block": rows.column("block").take(of), "feature": features, "n0": pa.array(n0, pa.int64()), "n1": pa.array(n1, pa.int64()), "ks": pa.array(ks)})
        before = (run, block, own)


def block_drift(blocked: DataFrame, features: Sequence[str], q: float = 0.05) -> DataFrame:
    """run, block, feature, ks, p, drift: each block after a run's first against the one before."""
    d = block_distances(blocked, features)
    tests = d.select("run", "block", "feature", "ks", drift.p_value(F.col("ks"), F.col("n0").cast("double"), F.col("n1").cast("double")).alias("p"))
    mine = Window.partitionBy("run", "block")
    tests = tests.withColumn("_r", F.row_number().over(mine.orderBy(F.round("p", 9), "feature"))).withColumn("_m", F.count(F.lit(1)).over(mine))
    cut = F.max(F.when(F.round("p", 9) <= F.col("_r") * q / F.col("_m"), F.col("_r"))).over(mine)
    return tests.withColumn("drift", F.col("_r") <= F.coalesce(cut, F.lit(0))).drop("_r", "_m")


def block_scores(blocked: DataFrame, features: Sequence[str], bins: int = 10, score: str = "chi2") -> DataFrame:
    """run, block, feature, score (to nine digits): each block by itself, binned over the span of its run's first block."""
    counts = ranking.own_histogram(blocked, features, "y", F.col("block") == 0, bins, "block")
    return ranking.scores(counts, "run", "block").select("run", "block", "feature", F.round(score, 9).alias("score"))


def drawn(weights: dict[str, float], size: int, avoid: set[str], seed: int, *key: object) -> list[str]:
    """`size` features without replacement, with chances that follow the weights; those to avoid only where there are too few others.

    Weights not above 0 come after all others. The draw depends on seed and key alone.
    """

    def rank(f: str) -> tuple:
        u = (int(hashlib.md5(":".join(map(str, (seed, *key, f))).encode()).hexdigest()[:8], 16) + 0.5) / 2**32
        w = weights[f]
        return (f in avoid, not w > 0, -math.log(u) / w if w > 0 else -u, f)

    return sorted(sorted(weights, key=rank)[:size])


def replaced(own: Sequence[str], drifting: set[str], score: dict[str, float]) -> list[str]:
    """The subspace with its drifting features, in their order, swapped for the best others that score more."""
    others = sorted((f for f in score if f not in own and f not in drifting), key=lambda f: (-score[f], f))
    swaps = {f: other for f, other in zip((f for f in own if f in drifting), others) if score[other] > score.get(f, 0.0)}
    return [swaps.get(f, f) for f in own]


def evolving_subspaces(found: DataFrame, start: DataFrame, full: float = 0.5, seed: int = 1) -> DataFrame:
    """run, block, learner, overlap, action, features (in place, after the block), fresh (those that learn from this block on).

    found: run, block, feature, score, drift and, optionally, weight (of a draw; the score where absent), a row for each feature of each
    block; a NULL score is 0, a NULL drift is none. start: learner, feature; a small table, the subspaces to begin with.
    """
    spaces: dict[int, list[str]] = {}
    for r in start.select("learner", "feature").orderBy("learner", "feature").collect():  # a row for each learner and feature
        spaces.setdefault(r.learner, []).append(r.feature)
    if not spaces:
        raise ValueError("start names no learner")
    weight = "weight" if "weight" in found.columns else "score"
    number = lambda c: F.coalesce(c, F.lit(0.0)).cast("double")
    entry = F.struct("feature", number("score").alias("score"), number(weight).alias("weight"), F.coalesce("drift", F.lit(False)).alias("drift"))
    rows = found.groupBy("run", "block").agg(F.collect_list(entry).alias("found")).withColumn("key", F.col("run").cast("string"))
    kinds = {c: found.schema[c].dataType.simpleString() for c in ("run", "block")}

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, now = object(), {}
        for pdf in frames:
            made = []
            for run, block, key, features in zip(pdf["run"], pdf["block"], pdf["key"], pdf["found"]):
                if key != current:
                    current, now = key, {learner: list(own) for learner, own in spaces.items()}
                    made += [(run, block, learner, 0.0, "KEEP", own, own) for learner, own in now.items()]
                    continue
                score = {x["feature"]: x["score"] for x in features}
                drifting = {x["feature"] for x in features if x["drift"]}
                for learner, own in now.items():
                    overlap = sum(f in drifting for f in own) / len(own)
                    if overlap == 0:
                        action, new, fresh = "KEEP", own, []
                    elif overlap < full:
                        new = replaced(own, drifting, score)
                        fresh = [f for f in new if f not in own]
                        action = "SURGICAL" if fresh else "NO_REPLACEMENT"
                    else:
                        new = drawn({x["feature"]: x["weight"] for x in features}, len(own), drifting, seed, key, block, learner)
                        action, fresh = "FULL", new
                    made.append((run, block, learner, overlap, action, new, fresh))
                    now[learner] = new
            yield pd.DataFrame(made, columns=["run", "block", "learner", "overlap", "action", "features", "fresh"]).astype({"run": pdf["run"].dtype, "block": pdf["block"].dtype, "learner": "int64"})

    out = f"run {kinds['run']}, block {kinds['block']}, learner long, overlap double, action string, features array<string>, fresh array<string>"
    return rows.repartition("run").sortWithinPartitions("run", "block").mapInPandas(fold, out)


def surgery(blocked: DataFrame, features: Sequence[str], start: DataFrame, q: float = 0.05, full: float = 0.5, bins: int = 10, alarms: DataFrame | None = None, seed: int = 1) -> DataFrame:
    """The evolving subspaces of a stream in blocks. alarms: run, block; without it each block's drift counts."""
    found = block_scores(blocked, features, bins).join(block_drift(blocked, features, q).select("run", "block", "feature", "drift"), ["run", "block", "feature"], "left")
    if alarms is not None:
        fired = alarms.select("run", "block", F.lit(True).alias("_fired")).distinct()
        found = found.join(fired, ["run", "block"], "left").withColumn("drift", F.col("drift") & F.coalesce("_fired", F.lit(False))).drop("_fired")
    return evolving_subspaces(found, start, full, seed)


def action_summary(actions: DataFrame) -> DataFrame:
    """run, action, n_learners and n_features that learn afresh."""
    return actions.groupBy("run", "action").agg(F.count(F.lit(1)).alias("n_learners"), F.sum(F.size("fresh")).alias("n_features"))


class Learned:
    """What a run's learners know: counts, sums and squares by learner, class and feature, of the features each has in its subspace."""

    def __init__(self, learners: Sequence[int], features: Sequence[str], classes: int, eps: float) -> None:
        self.at, self.of, self.classes, self.eps = {x: i for i, x in enumerate(learners)}, {f: i for i, f in enumerate(features)}, classes, eps
        self.moments = np.zeros((3, len(self.at), classes, len(self.of)))
        self.prior = np.zeros((len(self.at), classes))
        self.has = np.zeros((len(self.at), len(self.of)), bool)

    def learn(self, spaces: list[dict], y: np.ndarray, x: np.ndarray, there: np.ndarray) -> None:
        """The subspaces change, then the block's rows teach them."""
        for s in spaces:
            i = self.at[s["learner"]]
            self.moments[:, i, :, [self.of[f] for f in s["fresh"]]] = 0
            if s["action"] == "FULL":
                self.prior[i] = 0
            self.has[i] = False
            self.has[i, [self.of[f] for f in s["features"]]] = True
        told = np.equal.outer(np.arange(self.classes), y).astype(float)
        self.moments += np.stack([told @ there, told @ x, told @ (x * x)])[:, None] * self.has[None, :, None]
        self.prior += told.sum(axis=1)

    def weights(self) -> np.ndarray:
        """Of each learner: the mean share of its features' variance that lies between classes."""
        n, s, q = self.moments
        with np.errstate(divide="ignore", invalid="ignore"):
            between = np.where(n > 0, s * s / n, 0.0).sum(axis=1)
            n, s, q = (m.sum(axis=1) for m in (n, s, q))
            centre = np.where(n > 0, s * s / n, 0.0)
            share = np.where(q - centre > 0, (between - centre) / (q - centre), 0.0)
        return np.round((np.maximum(share, 0.0) * self.has).sum(axis=1) / np.maximum(self.has.sum(axis=1), 1), 9)

    def predict(self, x: np.ndarray, there: np.ndarray) -> np.ndarray:
        n, s, q = self.moments
        some = np.maximum(n, 1.0)
        mean = s / some
        variance = np.where(n > 0, np.maximum(q / some - mean * mean, 0.0) + self.eps, 1.0)
        gap = x[:, None, None, :] - mean
        density = (-0.5 * np.log(variance) - gap * gap / (2 * variance)) * (self.has[:, None, :] & there[:, None, None, :])
        winner = np.round(np.log(self.prior + 1.0) + density.sum(axis=-1), 9).argmax(axis=-1)
        weights = self.weights()
        weights = np.ones(len(weights)) if weights.sum() == 0 else weights
        return np.round((np.equal.outer(np.arange(self.classes), winner) * weights).sum(axis=-1), 9).argmax(axis=0)


def drift_aware(stream: DataFrame, features: Sequence[str], classes: int, size: int, spaces: DataFrame, eps: float = 1e-3, tasks: int | None = None) -> DataFrame:
    """run, seq, y, p and block of every row; rows of a run's first block are predicted as class 0.

    spaces: what `surgery` makes of the stream in blocks of this size. Ties of classes and of votes go to the lowest class; NULL features
    count nothing. A task reads its runs in the order of their blocks, each followed by its subspaces, and holds one block and what one run's
    learners know. tasks: what the rows are dealt into by run, where given.
    """
    names = [f"_x{i}" for i in range(len(features))]
    rows = blocks(stream, size).select("run", "seq", "y", "block", *[F.col(f).cast("double").alias(x) for f, x in zip(features, names)])
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("run", "seq", "y", "block")}
    known = spaces.select("run", F.col("block").cast(kinds["block"]).alias("block"), F.struct("learner", "action", "features", "fresh").alias("space"))
    both = rows.unionByName(known, allowMissingColumns=True)
    both = both.repartition("run") if tasks is None else both.repartition(tasks, "run")

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        run, learned, last = None, None, None
        for (own, block), piece in folds.blocks(batches):
            if learned is None or own != run:
                run, learned, last = own, None, None
            told = piece.column("space").is_valid()
            found, data = piece.column("space").filter(told).to_pylist(), piece.filter(pc.invert(told))
            x, there = folds.matrix(data, names)
            # NULL labels count for no class
            y = data.column("y").cast(pa.float64()).fill_null(-1.0).to_numpy()
            p = learned.predict(x, there) if learned is not None and last == block - 1 else np.zeros(len(y), np.int64)
            yield data.select(["run", "seq", "y"]).append_column("p", pa.array(p, pa.int32())).append_column("block", data.column("block"))
            if found:
                learned = learned or Learned(sorted(s["learner"] for s in found), features, classes, eps)
                learned.learn(found, y, x, there)
                last = block

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return folds.batched(predicted(batches))

    return both.sortWithinPartitions("run", "block").mapInArrow(of, f"run {kinds['run']}, seq {kinds['seq']}, y {kinds['y']}, p int, block {kinds['block']}")


def random_subspaces(spark, features: Sequence[str], learners: int, share: float = 0.6, seed: int = 1, avoid: Sequence[str] = ()) -> DataFrame:
    """learner, feature: each learner draws its share of the features that are not avoided, then of the others where these are too few."""
    k = max(1, round(share * len(features)))
    df = spark.createDataFrame([(i, f, f in avoid) for i in range(learners) for f in features], "learner int, feature string, avoided boolean")
    order = Window.partitionBy("learner").orderBy("avoided", F.xxhash64(F.lit(seed), "learner", "feature"))
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).select("learner", "feature")
