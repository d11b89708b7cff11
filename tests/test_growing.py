"""Growing trees and adaptive forests against a plain version that goes row by row."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestream.operators import growing, trees
from lodestream.sources import generators

FEATURES = ["x0", "x1", "x2"]


class Plain:
    """One run's trees, block by block."""

    def __init__(self, classes, growth, features_of, weight_of, adapt):
        self.classes, self.growth, self.features_of, self.weight_of, self.adapt = classes, growth, features_of, weight_of, adapt
        self.trees = {j: self.tree(j, 0) for j in range(growth.learners)}
        self.seen = {}
        self.events = []

    def tree(self, learner, born):
        return {"features": self.features_of(learner, born), "splits": {}, "votes": defaultdict(lambda: [0] * self.classes), "counts": defaultdict(lambda: [0] * self.classes)}

    def leaf(self, t, bins):
        node = 1
        while node in t["splits"]:
            f, cut = t["splits"][node]
            node = 2 * node + (bins[f] > cut)
        return node

    def block(self, number, rows):
        n, predicted, wrong = self.growth.learners, [], defaultdict(int)
        for bins, y, seq in rows:
            sums = [0.0] * self.classes
            for j, t in self.trees.items():
                votes = t["votes"][self.leaf(t, bins)]
                wrong[j] += votes.index(max(votes)) != y
                if j < n and sum(votes):
                    sums = [a + v / sum(votes) for a, v in zip(sums, votes)]
            sums = [round(x, 9) for x in sums]
            predicted.append(sums.index(max(sums)))
        for j, t in self.trees.items():
            for bins, y, seq in rows:
                w, node = self.weight_of(j, seq), self.leaf(t, bins)
                t["votes"][node][y] += w
                for f in t["features"]:
                    t["counts"][node, f, bins[f]][y] += w
            self.split(t)
        if self.adapt:
            self.watch(number, len(rows), wrong)
        return predicted

    def split(self, t):
        g = self.growth
        for node in {k[0] for k in t["counts"]}:
            if node in t["splits"] or node >= 2**g.depth:
                continue
            found = []
            for f in t["features"]:
                bins = {b: c for (m, x, b), c in t["counts"].items() if m == node and x == f and sum(c)}
                whole = [sum(c) for c in zip(*bins.values())] if bins else [0] * self.classes
                entropy = lambda c: sum(c) * math.log2(sum(c)) - sum(x * math.log2(x) for x in c if x) if sum(c) else 0.0
                best, left = None, [0] * self.classes
                for b in sorted(bins):
                    left = [a + x for a, x in zip(left, bins[b])]
                    gain = round(max((entropy(whole) - entropy(left) - entropy([a - x for a, x in zip(whole, left)])) / sum(whole), 0), 9)
                    if best is None or gain > best[0]:
                        best = (gain, b)
                if best:
                    found.append((-best[0], f, best[1], sum(whole)))
            if not found:
                continue
            found.sort()
            gain, second, n = -found[0][0], -found[1][0] if len(found) > 1 else 0.0, found[0][3]
            bound = math.sqrt(math.log2(max(self.classes, 2)) ** 2 * math.log(1 / g.delta) / (2 * n))
            if n >= g.grace and gain > 0 and (gain - second > bound or bound < g.tie):
                f, cut = found[0][1:3]
                t["splits"][node] = (f, cut)
                for (m, x, b), c in t["counts"].items():
                    if m == node and x == f:
                        own = t["votes"][2 * node + (b > cut)]
                        own[:] = [a + y for a, y in zip(own, c)]
                for key in [k for k in t["counts"] if k[0] == node]:
                    del t["counts"][key]

    def watch(self, number, size, wrong):
        n, a = self.growth.learners, self.adapt
        for j in range(n):
            total, s, n_min, s_min = self.seen.get(j, (0, 0, 0, 0))
            total, s = total + size, s + wrong[j]
            eps = lambda k: math.sqrt(math.log(1 / a.drift) / (2 * k))
            if not n_min or s / total + eps(total) <= s_min / n_min + eps(n_min):
                n_min, s_min = total, s
            self.seen[j] = (total, s, n_min, s_min)
            over = lambda alpha: total > n_min and s / total - s_min / n_min >= math.sqrt((total - n_min) / (total * n_min) / 2 * math.log(2 / alpha))
            if over(a.drift):
                self.events.append((number, j, "SWAP" if j + n in self.trees else "RESET"))
                self.trees[j] = self.trees.pop(j + n, None) or self.tree(j, number + 1)
                del self.seen[j]
            elif over(a.warn) and j + n not in self.trees:
                self.events.append((number, j, "WARNING"))
                self.trees[j + n] = self.tree(j + n, number + 1)


def compare(spark, stream, size, growth, adapt=None, classes=2):
    """The plain version's predictions and events for every run, and what differs."""
    stream = stream.cache()
    first = stream.where(F.col("seq") < size).groupBy("run").agg(*[f(x).alias(n + x) for x in FEATURES for n, f in (("a", F.min), ("b", F.max))]).collect()
    spans = {r.run: [(r["a" + x] - 0.05 * (r["b" + x] - r["a" + x]), r["b" + x] + 0.05 * (r["b" + x] - r["a" + x])) for x in FEATURES] for r in first}
    rows = defaultdict(list)
    for r in stream.orderBy("run", "seq").collect():
        bins = [min(max(math.floor((r[x] - lo) / ((hi - lo) / growth.bins)), 0), growth.bins - 1) for x, (lo, hi) in zip(FEATURES, spans[r.run])]
        rows[r.run].append((bins, r.y, r.seq))
    learners = spark.range(2 * growth.learners).select(F.col("id").cast("int").alias("learner"))
    weights = {(r.run, r.learner, r.seq): r.w for r in stream.select("run", "seq").crossJoin(learners).withColumn("w", growing.weight(growth, F.col("learner"))).collect()}
    blocks = max(len(v) for v in rows.values()) // size + 2
    born = learners.crossJoin(spark.range(blocks).withColumnRenamed("id", "born"))
    features = {(r.learner, r.born): r.f for r in born.select("learner", "born", growing.own_features(F.col("learner"), F.col("born"), 3, growth).alias("f")).collect()}
    predicted, events = growing.grown(stream, FEATURES, classes, size, growth, adapt)
    got = {(r.run, r.seq): r.p for r in predicted.collect()}
    happened = sorted((r.run, r.block, r.learner, r.event) for r in events.collect())
    want, wanted = {}, []
    for run, own in rows.items():
        plain = Plain(classes, growth, lambda j, b: features[j, b], lambda j, s: weights[run, j, s], adapt)
        for at in range(0, len(own), size):
            piece = own[at : at + size]
            want |= {(run, r[2]): p for r, p in zip(piece, plain.block(at // size, piece))}
        wanted += [(run, *e) for e in plain.events]
    stream.unpersist()
    return got, want, happened, sorted(wanted), {(run, r[2]): r[1] for run, own in rows.items() for r in own}


def test_a_tree_grows_as_row_by_row(spark):
    growth = trees.Growth(depth=4, bins=16, grace=100)
    got, want, events, _, labels = compare(spark, generators.sea(spark, 3, 1250, seed=11), 250, growth)
    assert got == want and events == [] and len(got) == 3750
    late = [k for k in got if k[1] >= 750]
    assert sum(got[k] == labels[k] for k in late) > 0.65 * len(late)  # the floor is 0.6


def test_it_remembers_what_the_tree_of_a_block_forgets(spark):
    """Small blocks of one concept: gathered counts split where those of one block cannot."""
    stream = generators.sea(spark, 2, 4000, seed=5).where("seq < 1000")
    growth = trees.Growth(depth=4, bins=16, grace=300, tie=0.1)  # a block's 250 rows never split
    share = lambda df: df.where("seq >= 500").agg(F.avg((F.col("y") == F.col("p")).cast("double"))).first()[0]
    assert share(growing.grown(stream, FEATURES, 2, 250, growth)[0]) > share(trees.by_blocks(stream, FEATURES, 2, 250, growth)) + 0.03


def test_a_forest_swaps_its_trees_as_row_by_row(spark):
    stream = generators.sea(spark, 2, 1600, seed=21).withColumn("y", F.when((F.col("seq") >= 800) & (F.col("run") == 0), 1 - F.col("y")).otherwise(F.col("y")))
    growth = trees.forest(3, 3, depth=3, bins=16, grace=100)
    got, want, events, wanted, labels = compare(spark, stream, 200, growth, growing.Adapt(0.2, 0.05))
    assert got == want and events == wanted
    assert {e for run, *_, e in events if run == 0} >= {"WARNING", "SWAP"} or {e for run, *_, e in events if run == 0} >= {"RESET"}
    assert any(run == 0 and 4 <= block <= 6 and e in ("SWAP", "RESET") for run, block, _, e in events)
    after = [k for k in got if k[0] == 0 and k[1] >= 1300]
    assert sum(got[k] == labels[k] for k in after) > 0.7 * len(after)


def test_later_extremes_change_nothing_before_them(spark):
    stream = generators.sea(spark, 1, 600, seed=2)
    growth = trees.Growth(depth=3, bins=16, grace=100)
    extreme = stream.withColumns({x: F.when(F.col("seq") >= 400, 1e6 * F.col(x)).otherwise(F.col(x)) for x in FEATURES})
    before = [{(r.seq, r.p) for r in growing.grown(s, FEATURES, 2, 200, growth)[0].where("seq < 400").collect()} for s in (stream, extreme)]
    assert before[0] == before[1]


def test_odd_rows(spark):
    rows = [(0, s, None if s % 5 == 0 else s % 3, None if s % 4 == 0 else float(s)) for s in range(40)] + [(None, 0, 1, 1.0)]
    stream = spark.createDataFrame(rows, "run int, seq long, y int, x0 double")
    p, events = growing.grown(stream, ["x0"], 2, 10, trees.Growth(depth=2, grace=5))
    assert p.where("run = 0").count() == 40 and p.where("p IS NULL").count() == 0 and events.count() == 0
    assert growing.grown(stream.where("false"), ["x0"], 2, 10)[0].count() == 0
    with pytest.raises(ValueError):
        growing.Adapt(0.01, 0.05)


def test_jobs_do_not_grow_with_the_blocks(spark):
    """A run of many blocks is read once; its rounds are no jobs."""
    stream = generators.sea(spark, 1, 1000, seed=3)
    growth = trees.forest(3, 2, depth=2, bins=8, grace=20)
    jobs = []
    for size in (500, 10):
        spark.sparkContext.setJobGroup(f"blocks of {size}", "")
        predicted, events = growing.grown(stream, FEATURES, 2, size, growth, growing.Adapt(0.3, 0.1))
        assert predicted.count() == 1000 and events.where("block >= 1000 / {}".format(size)).count() == 0
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"blocks of {size}")))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[0] == jobs[1] > 0


def test_values_that_are_no_numbers(spark):
    rows = [(0, s, s % 2, float("nan") if s % 4 == 0 else float("inf") if s == 25 else float(s % 7)) for s in range(40)]
    p, _ = growing.grown(spark.createDataFrame(rows, "run int, seq long, y int, x0 double"), ["x0"], 2, 10, trees.Growth(depth=2, grace=5))
    assert sorted(r.seq for r in p.where("p IS NOT NULL").collect()) == list(range(40))
