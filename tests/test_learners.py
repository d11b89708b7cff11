"""Models that follow a selection of features, against a plain version."""

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from lodestream.operators import learners

FEATURES = ["a", "b", "c"]


def plain(rows, remap):
    """p by seq of one run's rows (seq, y, values, selected)."""
    out, prior, seen, before = {}, defaultdict(int), {}, None
    for seq, y, values, selected in rows:
        selected = sorted(selected or FEATURES)
        if before is not None and selected != before:
            if not remap:
                prior, seen = defaultdict(int), {}
            else:
                seen = {k: v for k, v in seen.items() if k[0] in selected}
        before = selected
        scores = []
        for c in (0, 1):
            s = math.log(prior[c] + 1)
            for f in selected:
                own = seen.get((f, c), [])
                m = sum(own) / len(own) if own else 0.0
                v = max(sum(x * x for x in own) / len(own) - m * m, 0) + 1e-3 if own else 1.0
                s += -0.5 * math.log(v) - (values[f] - m) ** 2 / (2 * v)
            scores.append(round(s, 9))
        out[seq] = scores.index(max(scores))
        prior[y] += 1
        for f in selected:
            seen.setdefault((f, y), []).append(values[f])
    return out


def test_a_model_follows_its_selection(spark):
    rng = random.Random(3)
    rows = []
    for run in range(3):
        selected = None
        for seq in range(200):
            if seq % 40 == 20:
                selected = rng.choice([None, ["a"], ["b", "a"], ["c"], ["b", "c"], ["c", "b"]])
            y = rng.randrange(2)
            rows.append((run, seq, y, *[float(rng.randint(0, 8) + 3 * y * (f != "c")) for f in FEATURES], selected))
    stream = spark.createDataFrame(rows, "run int, seq long, y int, a double, b double, c double, selected array<string>").repartition(5)
    for remap in (False, True):
        got = {(r.run, r.seq): r.p for r in learners.naive_bayes(stream, FEATURES, 2, selected=F.col("selected"), remap=remap).collect()}
        want = {(run, s): p for run in range(3) for s, p in plain([(r[1], r[2], dict(zip(FEATURES, r[3:6])), r[6]) for r in rows if r[0] == run], remap).items()}
        assert got == want


def test_predictions_change_from_the_row_of_the_selection_on(spark):
    rows = [(0, s, s % 2, float(s % 2 * 5), float(s % 3)) for s in range(60)]
    stream = spark.createDataFrame(rows, "run int, seq long, y int, a double, b double")
    at = lambda chosen: [r.p for r in learners.naive_bayes(stream, ["a", "b"], 2, selected=F.when(F.col("seq") >= 30, F.array(F.lit(chosen))).otherwise(F.array(F.lit("a")))).orderBy("seq").collect()]
    same, other = at("a"), at("b")
    assert same[:30] == other[:30] and same[30:] != other[30:] and same[4:] == [s % 2 for s in range(4, 60)]
