"""The discretiser of streams against a plain version that goes update by update."""

import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lodestream.operators import discretiser, ranking
from lodestream.session import stored


def plain(rows, resets, bins, groups, warm_up):
    """{(run, update, feature): (edges, [Counter by class of each bin])} of rows (run, update, feature, value, cls)."""
    by = defaultdict(list)
    for run, update, feature, value, cls in rows:
        by[run, feature, update].append((value, cls))
    out = {}
    for run, feature in {k[:2] for k in by}:
        held, span, waiting = Counter(), None, []
        for update in sorted(u for r, f, u in by if (r, f) == (run, feature)):
            waiting.append(by[run, feature, update])
            if span is None and len(waiting) == warm_up:
                values = [v for own in waiting for v, _ in own if v is not None]
                a, b = min(values), max(values)
                span = (a, a + 1) if a == b else (a - 0.05 * (b - a), b + 0.05 * (b - a))
            if span:
                width = (span[1] - span[0]) / bins
                for own in waiting:
                    held.update((0 if v is None else min(max(math.floor((v - span[0]) / width), 0), bins - 1), c) for v, c in own)
                waiting = []
                classes = sorted({c for _, c in held})
                parts = [([b], [held[b, c] for c in classes]) for b in range(bins)]
                while len(parts) > groups:
                    costs = []
                    for (_, x), (_, y) in zip(parts, parts[1:]):
                        gap = sum(abs((p + 1) / (sum(x) + len(x)) - (q + 1) / (sum(y) + len(y))) for p, q in zip(x, y))
                        costs.append(round(0.5 * gap * (min(sum(x), sum(y)) + 1), 9))
                    at = min(range(len(costs)), key=lambda i: costs[i])
                    parts[at : at + 2] = [(parts[at][0] + parts[at + 1][0], [p + q for p, q in zip(parts[at][1], parts[at + 1][1])])]
                for number, (own, counts) in enumerate(parts):
                    for c, n in zip(classes, counts):
                        if n:
                            out[run, update, feature, number, c] = (round(span[0] + (own[-1] + 1) * width, 9), n)
            if (run, update, feature) in resets:
                held, span, waiting = Counter(), None, []
    return out


def stream(seed):
    rng, rows = random.Random(seed), []
    for run in (1, 2):
        for update in range(8):
            for _ in range(60):
                c = rng.choice("xy")
                rows.append((run, update, "a", rng.gauss(2 * (c == "x"), 1) + 5 * (update > 4), c))
                rows.append((run, update, "b", None if rng.random() < 0.1 else float(rng.randint(0, 3)), c))
                rows.append((run, update, "same", 7.0, c))
    return rows, {(1, 4, "a"), (2, 0, "b"), (2, 5, "same"), (1, 7, "b")}


def test_cut_points_against_a_plain_version(spark):
    rows, resets = stream(1)
    long = spark.createDataFrame(rows, "run int, update long, feature string, value double, cls string").repartition(4)
    marks = spark.createDataFrame(sorted(resets), "run int, update long, feature string")
    for warm_up in (1, 2):
        counts = stored(discretiser.gathered(long, 10, warm_up, marks), "gathered")
        got = {(r.run, r.update, r.feature, r.bin, r.cls): (round(r.upto, 9), r.n) for r in discretiser.merged(counts, 10, 3).collect()}
        want = plain(rows, resets, 10, 3, warm_up)
        assert set(got) == set(want)
        assert all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-6 for k in want)


def test_a_reset_touches_one_feature(spark):
    rows, _ = stream(2)
    long = spark.createDataFrame(rows, "run int, update long, feature string, value double, cls string")
    mark = spark.createDataFrame([(1, 3, "a")], "run int, update long, feature string")
    totals = lambda df: {(r.run, r.update, r.feature): r.n for r in df.groupBy("run", "update", "feature").agg(F.sum("n").alias("n")).collect()}
    one, none = totals(discretiser.gathered(long, 10, 1, mark)), totals(discretiser.gathered(long, 10))
    changed = {k for k in none if one.get(k) != none[k]}
    assert changed == {(1, u, "a") for u in range(4, 8)} and one[1, 4, "a"] == 60 and none[1, 4, "a"] == 300


def test_rows_are_placed_by_earlier_cut_points_alone(spark):
    rows, _ = stream(3)
    extreme = [(run, u, f, v * 1000 if v is not None and u >= 6 else v, c) for run, u, f, v, c in rows]
    found = []
    for own in (rows, extreme):
        long = spark.createDataFrame(own, "run int, update long, feature string, value double, cls string")
        second = discretiser.merged(stored(discretiser.gathered(long, 10), "gathered"), 10, 3)
        placed = discretiser.placed(long, second)
        assert placed.where("update = 0 AND bin IS NOT NULL").count() == 0 and placed.where("update > 0 AND bin NOT BETWEEN 0 AND 2").count() == 0
        found.append(Counter(tuple(r) for r in placed.where("update < 6").collect()))
    assert found[0] == found[1]
    empty = spark.createDataFrame([], "run int, update long, feature string, value double, cls string")
    assert discretiser.gathered(empty, 10).count() == 0


def test_merging_joins_nothing(spark):
    """The gathered counts' file is small, but their rows are many: no join may broadcast them."""
    rows, _ = stream(4)
    long = spark.createDataFrame(rows, "run int, update long, feature string, value double, cls string")
    second = discretiser.merged(stored(discretiser.gathered(long, 10), "gathered"), 10, 3, 2)
    assert "Join" not in second._jdf.queryExecution().optimizedPlan().toString()
    assert second.agg(F.sum("n")).first()[0] == 2 * 3 * 60 * sum(range(1, 9))


def test_merging_of_histograms_of_unlike_classes(spark):
    """Histograms that show one, two and no named class, merged together, as they are merged alone."""
    cells = {"a": [(b, "x", b % 3 + 1) for b in range(6)], "b": [(b, c, 1 + b * (c == "y")) for b in (0, 2, 5) for c in "yz"], "c": [(1, None, 4), (4, None, 2), (4, "z", 2)]}
    counts = spark.createDataFrame([(f, *cell) for f, own in cells.items() for cell in own], "feature string, bin int, cls string, n long")
    found = {(r.feature, r.bin): r.to for r in ranking.merged_bins(counts, 6, 3).collect()}
    for f in cells:
        alone = {(r.feature, r.bin): r.to for r in ranking.merged_bins(counts.where(F.col("feature") == f), 6, 3).collect()}
        assert alone == {k: v for k, v in found.items() if k[0] == f} and sorted(set(alone.values())) == [0, 1, 2]
    assert [found["b", b] for b in range(6)] == [0, 0, 1, 1, 1, 2]
