"""Hoeffding trees and ensembles of them, grown level by level from counts.

Rows are binned once. A level counts all rows by run, learner, leaf, feature, bin and class in one aggregation,
which serves all leaves of all learners of all runs; running sums over the bins give the gain of every cut. A leaf
splits where its best cut beats the best cut of any other feature by Hoeffding's bound, or the bound is below the
tie limit. The learners of an ensemble differ in their features (patches) and in the weights that a row's hash
gives it (a Poisson number). A run's model is one row of at most learners x 2^depth nodes; nodes are numbered from
1 at the root, with children 2n and 2n + 1.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small, stored
from ..sources.generators import uniform
from .ranking import layer1_bin


#: Models of at most this many nodes together (some 10 MB) are broadcast to the rows.
BROADCAST_NODES = 200_000


@dataclass(frozen=True)
class Growth:
    depth: int = 5
    bins: int = 32
    #: A leaf of less weight than this does not split.
    grace: int = 200
    delta: float = 0.01
    tie: float = 0.05
    learners: int = 1
    #: Features of each learner; all of them where None.
    subspace: int | None = None
    #: Mean of the Poisson number that weighs a row for a learner; every row weighs 1 where 0.
    rate: float = 0.0
    seed: int = 1

    def __post_init__(self) -> None:
        if not (self.depth >= 1 and self.bins >= 2 and 0 < self.delta < 1 and self.learners >= 1 and self.rate >= 0):
            raise ValueError("depth and learners from 1, bins from 2, delta in (0, 1), rate from 0")

    def broadcast_runs(self) -> int:
        """So many runs' models can be broadcast."""
        return BROADCAST_NODES // (self.learners * 2 ** (self.depth + 1))


@dataclass(frozen=True)
class Model:
    """trees: run, trees. Rows to predict are binned over the span of the training rows."""

    trees: DataFrame
    features: tuple[str, ...]
    spans: tuple[tuple[float, float], ...]
    classes: int
    growth: Growth

    def bins(self) -> Column:
        pairs = zip(self.features, self.spans, strict=True)
        return F.array(*[layer1_bin(F.col(f).cast("double"), F.lit(low), F.lit(high), self.growth.bins) for f, (low, high) in pairs])


def forest(n_features: int, learners: int = 10, **other) -> Growth:
    """Trees on reweighted rows, each of the root of the number of features, rounded up, plus one."""
    return Growth(learners=learners, subspace=min(n_features, math.ceil(math.sqrt(n_features)) + 1), rate=6.0, **other)


def patches(n_features: int, learners: int = 10, share: float = 0.6, **other) -> Growth:
    """Trees on reweighted rows, each of a random share of the features."""
    return Growth(learners=learners, subspace=max(1, round(share * n_features)), rate=6.0, **other)


def subspaces(n_features: int, growth: Growth) -> list[list[int]]:
    """The feature numbers of each learner."""
    size = n_features if growth.subspace is None else min(growth.subspace, n_features)
    return [sorted(random.Random(growth.seed * 1000 + j).sample(range(n_features), size)) for j in range(growth.learners)]


def poisson_steps(rate: float) -> list[float]:
    """The shares of Poisson numbers of 0, of 1 at most, and so on."""
    upto, mass, k = [], math.exp(-rate), 0
    while not upto or 1 - upto[-1] > 1e-9 and k < 200:
        upto.append((upto[-1] if upto else 0.0) + mass)
        k += 1
        mass *= rate / k
    return upto


def poisson(rate: float, u: Column) -> Column:
    """The Poisson number at the quantile u."""
    return F.size(F.filter(F.array(*map(F.lit, poisson_steps(rate))), lambda c: c <= u))


def split_gains(counts: DataFrame, classes: int, *by: str) -> DataFrame:
    """by, feature, cut, gain (bits), n: the best cut of each feature; values of bins above `cut` go right.

    counts: by, feature, bin and c0, c1, ... (the weight of each class). Equal gains take the lowest cut.
    """
    part = Window.partitionBy(*by, "feature")
    upto = part.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    names = [f"c{c}" for c in range(classes)]
    df = counts.select(*by, "feature", "bin", *[F.sum(c).over(upto).cast("double").alias(f"l{c}") for c in names], *[F.sum(c).over(part).cast("double").alias(f"t{c}") for c in names])
    df = df.withColumns({f"r{c}": F.col(f"t{c}") - F.col(f"l{c}") for c in names})

    def spread(side: str) -> Column:
        """n times the entropy of a side: n ln n - sum of c ln c."""
        n = sum((F.col(f"{side}{c}") for c in names), F.lit(0.0))
        logs = [F.when(x > 0, x * F.log2(x)).otherwise(0.0) for x in [n, *[F.col(f"{side}{c}") for c in names]]]
        return logs[0] - sum(logs[1:], F.lit(0.0))

    n = sum((F.col(f"t{c}") for c in names), F.lit(0.0))
    gain = F.round(F.greatest((spread("t") - spread("l") - spread("r")) / n, F.lit(0.0)), 9)
    best = F.max(F.struct(gain.alias("gain"), (-F.col("bin")).alias("at"), n.alias("n")))
    return df.groupBy(*by, "feature").agg(best.alias("b")).select(*by, "feature", (-F.col("b.at")).alias("cut"), F.col("b.gain").alias("gain"), F.col("b.n").alias("n"))


def _leaf(splits: Column, bins: Column, depth: int) -> Column:
    def step(node: Column, _: Column) -> Column:
        s = F.try_element_at(splits, node)
        return F.when(s.isNull(), node).otherwise(node * 2 + (F.get(bins, s["feature"]) > s["cut"]).cast("int"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), step)


def _assembled(runs: DataFrame, splits: DataFrame, leaves: DataFrame | None, spaces: list[list[int]]) -> DataFrame:
    """run, trees: learner, features, splits (node -> feature, cut) and leaves (node -> weights of the classes)."""
    learners = F.array(*[F.struct(F.lit(j).alias("learner"), F.array(*map(F.lit, s)).alias("features")) for j, s in enumerate(spaces)])
    df = runs.join(splits.groupBy("run").agg(F.collect_list(F.struct("learner", "node", "feature", "cut")).alias("s")), "run", "left")
    if leaves is not None:
        df = df.join(leaves.groupBy("run").agg(F.collect_list(F.struct("learner", "node", "votes")).alias("l")), "run", "left")
    own = lambda of, j: F.filter(of, lambda x: x["learner"] == j)

    def tree(t: Column) -> Column:
        found = F.map_from_entries(F.transform(own(F.coalesce("s", F.array().cast(df.schema["s"].dataType)), t["learner"]), lambda x: F.struct(x["node"], F.struct(x["feature"].alias("feature"), x["cut"].alias("cut")))))
        parts = [t["learner"].alias("learner"), t["features"].alias("features"), found.alias("splits")]
        if leaves is not None:
            parts.append(F.map_from_entries(F.transform(own(F.col("l"), t["learner"]), lambda x: F.struct(x["node"], x["votes"]))).alias("leaves"))
        return F.struct(*parts)

    return df.select("run", F.transform(learners, tree).alias("trees"))


def fit(train: DataFrame, features: Sequence[str], classes: int, growth: Growth = Growth(), warm_up: DataFrame | None = None) -> Model:
    """One model per run of rows run, seq, y (class index) and the features.

    Bins span the values of the warm-up rows, of all rows where none are given. Rows whose label is NULL or out of range teach nothing; a NULL feature falls in bin 0.
    """
    rows = train.where(F.col("y").between(0, classes - 1))
    ends = (rows if warm_up is None else warm_up).agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("a", F.min), ("b", F.max))]).first()
    spans = []
    for i in range(len(features)):
        a, b = ends[f"a{i}"], ends[f"b{i}"]
        a, b = (0.0, 1.0) if a is None else (a, b)
        spans.append((a, a + 1.0) if a == b else (a - 0.05 * (b - a), b + 0.05 * (b - a)))
    model = Model(train, tuple(features), tuple(spans), classes, growth)
    rows = stored(rows.select("run", "seq", "y", model.bins().alias("bins")), "binned")
    runs = stored(rows.select("run").distinct(), "runs")
    spaces = subspaces(len(features), growth)
    splits = runs.select("run", F.lit(0).alias("learner"), F.lit(0).alias("node"), F.lit(0).alias("feature"), F.lit(0).alias("cut")).where("false")
    sums = [F.coalesce(F.sum(F.when(F.col("y") == c, F.col("w"))), F.lit(0)).alias(f"c{c}") for c in range(classes)]

    def placed(splits: DataFrame) -> DataFrame:
        """Each row once per learner, in its leaf."""
        trees = small(stored(_assembled(runs, splits, None, spaces), "trees"), growth.broadcast_runs())
        each = rows.join(trees, "run").select("run", "seq", "y", "bins", F.explode("trees").alias("t"))
        w = poisson(growth.rate, uniform(growth.seed + 31, F.col("t.learner"), F.col("run"), F.col("seq"))) if growth.rate else F.lit(1)
        return each.select("run", "y", "bins", F.col("t.learner").alias("learner"), F.col("t.features").alias("features"), _leaf(F.col("t.splits"), F.col("bins"), growth.depth).alias("node"), w.alias("w")).where("w > 0")

    key = ["run", "learner", "node"]
    for level in range(growth.depth):
        fresh = placed(splits).where(F.col("node") >= 2**level)  # a leaf that did not split has no new rows
        cells = fresh.select(*key, "y", "w", "bins", F.explode("features").alias("feature")).withColumn("bin", F.get("bins", F.col("feature")))
        gains = split_gains(cells.groupBy(*key, "feature", "bin").agg(*sums), classes, *key)
        ranked = gains.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("gain", (-F.col("feature")).alias("f"), "cut")), False).alias("g"), F.max("n").alias("n"))
        first, second = F.col("g")[0], F.coalesce(F.get("g", F.lit(1))["gain"], F.lit(0.0))
        bound = F.sqrt(F.log2(F.lit(float(max(classes, 2)))) ** 2 * math.log(1 / growth.delta) / (2 * F.col("n")))
        chosen = ranked.where((F.col("n") >= growth.grace) & (first["gain"] > 0) & ((first["gain"] - second > bound) | (bound < growth.tie)))
        new = stored(chosen.select(*key, (-first["f"]).alias("feature"), first["cut"].alias("cut")), f"level_{level}")
        if new.isEmpty():
            break
        splits = splits.unionByName(new)
    leaves = placed(splits).groupBy(*key).agg(*sums).select(*key, F.array(*[F.col(f"c{c}").cast("double") for c in range(classes)]).alias("votes"))
    trees = stored(_assembled(runs, splits, leaves, spaces), "trees")
    return Model(trees, model.features, model.spans, classes, growth)


def predict(model: Model, rows: DataFrame, weights: Sequence[float] | None = None) -> DataFrame:
    """rows with p, the class of most votes (the lowest of equals); class 0 where a run has no model.

    A tree votes with the class shares of its leaf, times its weight if any weight is above 0.
    """
    weigh = weights is not None and any(w > 0 for w in weights)
    w = F.array(*[F.lit(float(x)) for x in weights]) if weigh else None

    def votes(t: Column) -> Column:
        found = F.try_element_at(t["leaves"], _leaf(t["splits"], F.col("_bins"), model.growth.depth))
        total = F.aggregate(found, F.lit(0.0), lambda a, x: a + x)
        return F.transform(found, lambda x: F.coalesce(F.try_divide(x, total), F.lit(0.0)) * (F.get(w, t["learner"]) if weigh else 1.0))

    zero = F.array(*[F.lit(0.0)] * model.classes)
    added = F.aggregate("_trees", zero, lambda a, t: F.zip_with(a, F.coalesce(votes(t), zero), lambda x, y: x + y))
    trees = small(model.trees, model.growth.broadcast_runs()).withColumnRenamed("trees", "_trees")
    df = rows.withColumn("_bins", model.bins()).join(trees, "run", "left")
    df = df.withColumn("_sums", F.transform(added, lambda x: F.round(x, 9)))
    p = F.coalesce(F.array_position("_sums", F.array_max("_sums")) - 1, F.lit(0)).cast("int")
    return df.withColumn("p", p).select(*rows.columns, "p")


def by_blocks(stream: DataFrame, features: Sequence[str], classes: int, size: int, growth: Growth = Growth()) -> DataFrame:
    """Test-then-train by blocks of `size` values of seq: a block is predicted by the model of the block before.

    The first block of a run has no model yet and gets class 0. Bins span the first blocks, later values beyond fall in the end bins. Each row teaches one model, so nothing is
    repeated, and a change of concept is forgotten after a block.
    """
    block = F.floor(F.col("seq") / size)
    keyed = stream.withColumnRenamed("run", "_run")
    train = keyed.withColumn("run", F.struct("_run", (block + 1).alias("block")))
    test = keyed.withColumn("run", F.struct("_run", block.alias("block")))
    out = predict(fit(train, features, classes, growth, stream.where(block == 0)), test)
    return out.drop("run").withColumnRenamed("_run", "run").select(*stream.columns, "p")
