"""Hoeffding trees that grow from block to block, and an adaptive forest of them.

A run is cut into blocks of `size` rows. A block is predicted by the trees as they stand, then it teaches them: its counts by leaf,
feature, bin and class are added to those that the leaves have gathered so far. A leaf splits when its own gathered counts meet
Hoeffding's bound, and hands its counts by class on to its children. So nothing is forgotten and no row is counted twice.

The adaptive forest watches each learner's errors by Hoeffding's bound against the prefix with the least mean, at the end of each block. At
the looser level (a warning) a background tree starts, with features of its own, and grows along without a vote; at the stricter
level (a drift) it takes the learner's place, or a fresh tree does where none is there yet.

Rows are dealt by run and read in the order of their blocks, once: a task holds one block and one run's trees, whose counts are bounded
by the nodes. Trees learn blocks as matrices. Bins span the first block of a run; later values beyond it fall in the end bins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.generators import uniform
from . import folds
from .trees import Growth, poisson, poisson_steps


@dataclass(frozen=True)
class Adapt:
    """Levels of a learner's warning and drift."""

    warn: float = 0.05
    drift: float = 0.01

    def __post_init__(self) -> None:
        if not 0 < self.drift <= self.warn < 1:
            raise ValueError("0 < drift <= warn < 1")


def own_features(learner: Column, born: Column, n_features: int, growth: Growth) -> Column:
    """The feature numbers of a tree, drawn by its learner and the block it is born in."""
    size = n_features if growth.subspace is None else min(growth.subspace, n_features)
    keyed = F.transform(F.sequence(F.lit(0), F.lit(n_features - 1)), lambda f: F.struct(F.xxhash64(F.lit(growth.seed), learner, born, f).alias("h"), f.alias("f")))
    return F.sort_array(F.slice(F.sort_array(keyed), 1, size)["f"])


def _quantile(growth: Growth, learner: Column) -> Column:
    return uniform(growth.seed + 31, learner, F.col("run"), F.col("seq"))


def weight(growth: Growth, learner: Column) -> Column:
    """What a row weighs for a learner."""
    return poisson(growth.rate, _quantile(growth, learner)) if growth.rate else F.lit(1)


def _spread(counts: np.ndarray) -> np.ndarray:
    """n times the entropy of counts by class (the last axis): n ln n - sum of c ln c."""
    terms = lambda x: x * np.log2(np.maximum(x, 1.0))  # noqa: E731  whole numbers
    return terms(counts.sum(axis=-1)) - terms(counts).sum(axis=-1)


class Tree:
    """One tree: its nodes, the votes of each, and the counts (features x bins x classes) that each open leaf has gathered."""

    def __init__(self, features: Sequence[int], classes: int, growth: Growth) -> None:
        self.features, self.classes, self.growth = np.array(features), classes, growth
        self.feature, self.cut, self.child, self.level = (np.array([x]) for x in (-1, 0, 0, 0))
        self.votes = np.zeros((1, classes))
        self.place = np.array([0])  # of a leaf's counts; -1 of leaves that are as deep as they may be, and of nodes that are none
        self.counts = np.zeros((1, len(features), growth.bins, classes))

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(bins), int), np.arange(len(bins))
        for _ in range(self.level.max()):
            feature = self.feature[at]
            at = np.where(feature < 0, at, self.child[at] + (bins[rows, feature] > self.cut[at]))
        return at

    def learn(self, at: np.ndarray, bins: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        self.votes += np.bincount(at * self.classes + y, w, self.votes.size).reshape(self.votes.shape)
        place = self.place[at]
        open_ = place >= 0
        if not open_.all():
            place, bins, y, w = place[open_], bins[open_], y[open_], w[open_]
        k = len(self.features)
        cell = ((place[:, None] * k + np.arange(k)) * self.growth.bins + bins[:, self.features]) * self.classes + y[:, None]
        self.counts += np.bincount(cell.ravel(), np.repeat(w, k), self.counts.size).reshape(self.counts.shape)
        self.split()

    def split(self) -> None:
        """Split the leaves whose own counts allow it; equal gains take the lowest feature and cut."""
        growth = self.growth
        n = self.counts[:, 0].sum(axis=(1, 2))
        due = np.flatnonzero((n >= growth.grace) & (n > 0))
        if not len(due):
            return
        left, n = self.counts[due].cumsum(axis=2), n[due]
        whole = left[:, :, -1:]
        gains = np.round(np.maximum((_spread(whole) - _spread(left) - _spread(whole - left)) / n[:, None, None], 0.0), 9)
        cuts, gains = gains.argmax(axis=2), gains.max(axis=2)
        best = gains.argmax(axis=1)
        order = np.sort(gains, axis=1)
        first, second = order[:, -1], order[:, -2] if order.shape[1] > 1 else np.zeros(len(due))
        bound = np.sqrt(math.log2(max(self.classes, 2)) ** 2 * math.log(1 / growth.delta) / (2 * n))
        leaf = {p: node for node, p in enumerate(self.place.tolist()) if p >= 0}
        for i in np.flatnonzero((first > 0) & ((first - second > bound) | (bound < growth.tie))):
            own = left[i, best[i]]
            self._divide(leaf[due[i]], best[i], cuts[i, best[i]], np.stack([own[cuts[i, best[i]]], own[-1] - own[cuts[i, best[i]]]]))

    def _divide(self, node: int, feature: int, cut: int, handed: np.ndarray) -> None:
        place, level = self.place[node], self.level[node] + 1
        self.feature[node], self.cut[node], self.child[node], self.place[node] = self.features[feature], cut, len(self.feature), -1
        self.votes[node] = 0
        self.counts[place] = 0
        places = [-1, -1]
        if level < self.growth.depth:  # the one child goes on in the leaf's place
            places = [place, len(self.counts)]
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts[:1])])
        added = {"feature": [-1, -1], "cut": [0, 0], "child": [0, 0], "level": [level] * 2, "place": places}
        for name, values in added.items():
            setattr(self, name, np.append(getattr(self, name), values))
        self.votes = np.concatenate([self.votes, handed])


class Errors:
    """A learner's errors so far, with the prefix of the least upper limit."""

    def __init__(self) -> None:
        self.n = self.s = self.n_min = self.s_min = 0

    def add(self, n: int, s: int, adapt: Adapt) -> tuple[bool, bool]:
        """Whether they are at the level of a warning and of a drift after n more rows with s errors."""
        self.n += n
        self.s += s
        if not self.n:
            return False, False
        limit = lambda s, n: s / n + math.sqrt(math.log(1 / adapt.drift) / (2 * n))
        if not self.n_min or limit(self.s, self.n) <= limit(self.s_min, self.n_min):
            self.n_min, self.s_min = self.n, self.s
        if self.n == self.n_min:
            return False, False
        rise, m = self.s / self.n - self.s_min / self.n_min, (self.n - self.n_min) / (self.n * self.n_min)
        warn, drift = (rise >= math.sqrt(m / 2 * math.log(2 / alpha)) for alpha in (adapt.warn, adapt.drift))
        return warn, drift


class Forest:
    """One run's trees: a learner's own and, from n on, those that grow behind them."""

    def __init__(self, first: np.ndarray, spaces: Sequence[Sequence[int]], classes: int, growth: Growth, adapt: Adapt | None) -> None:
        """first: the values of the run's first block, NaN where NULL."""
        self.classes, self.growth, self.adapt, self.n = classes, growth, adapt, growth.learners
        self.trees = {j: Tree(own, classes, growth) for j, own in enumerate(spaces)}
        self.errors = [Errors() for _ in spaces]
        self.steps = np.array(poisson_steps(growth.rate)) if growth.rate else None
        there = ~np.isnan(first)
        a = np.where(there.any(axis=0), np.where(there, first, np.inf).min(axis=0), 0.0)
        b = np.where(there.any(axis=0), np.where(there, first, -np.inf).max(axis=0), 1.0)
        self.low = np.where(a == b, a, a - 0.05 * (b - a))
        self.width = (np.where(a == b, a + 1, b + 0.05 * (b - a)) - self.low) / growth.bins

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.nan_to_num(np.clip(np.floor((x - self.low) / self.width), 0, self.growth.bins - 1)).astype(int)

    def block(self, x: np.ndarray, y: np.ndarray, quantiles: np.ndarray | None, fresh: Sequence[Sequence[int]] | None) -> tuple[np.ndarray, list[tuple[int, str]]]:
        """The predictions of a block that is then learned, and its events: learner, event.

        y: -1 where a row teaches nothing; quantiles: of each row and learner, for its weight; fresh: the features of trees born after the block.
        """
        bins, taught = self.binned(x), y >= 0
        own_bins, own_y = (bins, y) if taught.all() else (bins[taught], y[taught])
        sums, wrong = np.zeros((len(y), self.classes)), {}
        for j, tree in self.trees.items():
            at = tree.leaves(bins)
            if j < self.n:
                total = tree.votes.sum(axis=1, keepdims=True)
                sums += (tree.votes / np.where(total > 0, total, 1.0))[at]
                wrong[j] = int((tree.votes.argmax(axis=1)[at[taught]] != own_y).sum())
            w = np.ones(len(own_y)) if self.steps is None else np.searchsorted(self.steps, quantiles[taught, j], "right").astype(float)
            tree.learn(at[taught], own_bins, own_y, w)
        return np.round(sums, 9).argmax(axis=1), [] if self.adapt is None else self.watch(len(own_y), wrong, fresh)

    def watch(self, n: int, wrong: dict[int, int], fresh: Sequence[Sequence[int]]) -> list[tuple[int, str]]:
        events = []
        for j in range(self.n):
            warn, drift = self.errors[j].add(n, wrong[j], self.adapt)
            behind = self.n + j
            if drift:
                events.append((j, "SWAP" if behind in self.trees else "RESET"))
                self.trees[j] = self.trees.pop(behind) if behind in self.trees else Tree(fresh[j], self.classes, self.growth)
                self.errors[j] = Errors()
            elif warn and behind not in self.trees:
                events.append((j, "WARNING"))
                self.trees[behind] = Tree(fresh[behind], self.classes, self.growth)
        return events


def grown(stream: DataFrame, features: Sequence[str], classes: int, size: int, growth: Growth = Growth(), adapt: Adapt | None = None) -> tuple[DataFrame, DataFrame]:
    """The predictions (run, seq, y, p, block) of all rows, and the events (run, block, learner, event) after each block.

    stream: run, seq (from 0), y (class index) and the features. The first block of a run is predicted as class 0. Rows whose label is NULL or
    out of range are predicted and teach nothing; a NULL feature falls in bin 0. Ties go to the lowest class. Each of the two is a pass
    over the stream of its own.
    """
    spark, n = stream.sparkSession, growth.learners
    most = n if adapt is None else 2 * n
    names, quantiles = [f"_x{i}" for i in range(len(features))], [f"_u{j}" for j in range(most)] if growth.rate else []
    drawn = lambda learners, born: F.array(*[own_features(F.lit(j), born, len(features), growth) for j in range(learners)])
    spaces = spark.range(1).select(drawn(n, F.lit(0).cast("long")).alias("own")).first().own
    rows = stream.select("run", "seq", "y", F.floor(F.col("seq") / size).alias("block"), *[F.col(f).cast("double").alias(x) for f, x in zip(features, names)])
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("run", "seq", "y")}
    begins = F.coalesce(F.lag("block").over(Window.partitionBy("run").orderBy("block")) != F.col("block"), F.lit(True))
    fresh = F.lit(None).cast("array<array<int>>") if adapt is None else F.when(begins, drawn(most, F.col("block") + 1))  # once a block
    rows = rows.withColumns({"_fresh": fresh} | {u: _quantile(growth, F.lit(j)) for j, u in enumerate(quantiles)})
    if adapt is None:
        rows = rows.withColumn("_begins", begins)  # deals the rows by run

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table, np.ndarray, list[tuple[int, str]]]]:
        known, forest = None, None
        for (run, block), piece in folds.blocks(batches):
            x, there = folds.matrix(piece, names)
            x = np.where(there, x, np.nan)
            if forest is None or run != known:
                known, forest = run, Forest(x, spaces, classes, growth, adapt)
            y = piece.column("y").cast(pa.float64()).fill_null(-1.0).to_numpy()
            y = np.where((y >= 0) & (y < classes), y, -1).astype(int)
            born = None if adapt is None else piece.column("_fresh").drop_null().to_pylist()[0]
            yield (run, block), piece, *forest.block(x, y, folds.matrix(piece, quantiles)[0] if quantiles else None, born)

    def predictions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from folds.batched(
            piece.select(["run", "seq", "y"]).append_column("p", pa.array(p, pa.int32())).append_column("block", piece.column("block")) for _, piece, p, _ in passed(batches)
        )

    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, block), piece, _, found in passed(batches):
            if found:
                run = piece.column("run").take(pa.array([0] * len(found))).combine_chunks()
                yield pa.RecordBatch.from_arrays([run, pa.array([block] * len(found), pa.int64()), *(pa.array(x, t) for x, t in zip(zip(*found), (pa.int32(), pa.string())))], names=["run", "block", "learner", "event"])

    ordered = rows.sortWithinPartitions("run", "block")
    return ordered.mapInArrow(predictions, f"run {kinds['run']}, seq {kinds['seq']}, y {kinds['y']}, p int, block long"), ordered.mapInArrow(events, f"run {kinds['run']}, block long, learner int, event string")
