"""Hard negatives against all exact scores, by brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    taking = []
    for vec_id, vector, label in rows:
        if vec_id is None or vector is None or label is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        x = [math.floor(256 * float(np.float32(c))) for c in vector]
        if sum(c * c for c in x) <= 2**62:
            taking.append((vec_id, x, (label + 1) % 10 if vec_id % 7 == 0 else label))
    out = []
    for i, (a, x, label) in enumerate(taking):
        if a % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), b, other) for j, (b, y, other) in enumerate(taking) if j != i]
        for p, positive, _ in sorted(s for s in scored if s[2] == label)[:5]:
            fits = sorted((s, b) for s, b, other in scored if other != label and 30 * -p <= 100 * -s <= 90 * -p)
            out += [(a, positive, n, b, -p, -s) for n, (s, b) in enumerate(fits[:10], 1)]
    return sorted(out)


def mined(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("row_no", "x", "low", "n", "score", "nth", "own")}).repartition(parts)
    return sorted(tuple(r) for r in hard_negatives.mining_report(df).collect())


def vectors(seed, n, dim=16, scale=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, scale) for _ in range(dim)] for _ in range(4)]
    return [(i, [c + rng.gauss(0, scale) for c in centres[i % 4]], rng.choice([i % 4, rng.randrange(6)])) for i in range(n)]


def test_every_row_is_found(spark):
    rows = vectors(1, 700)
    rows += [(700, None, 1), (800, [0.5] * 16, None), (None, [0.5] * 16, 1), (900, [math.nan] + [0.1] * 15, 1), (901, [math.inf] * 16, 1), (902, [None] * 16, 1)]
    rows += [(1000, [], 1), (1001, [1.0, 2.0], 2), (1100, [0.3] * 40, 3), (1200, [1e30] * 16, 0)]
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 100


def test_ties_and_repeated_rows(spark):
    hot = [(i, [0.5, -0.25, 0.125], 1 + (i % 3 == 0)) for i in range(300)]
    rows = hot + vectors(2, 60, 3) + [hot[100]] * 3 + [hot[7]] * 2
    assert mined(spark, rows) == brute(rows)


@pytest.mark.parametrize("scale", [1e-4, 30.0, 1e5, 2e6])
def test_any_magnitude(spark, scale):
    rows = vectors(3, 320, 5, scale)
    assert mined(spark, rows, 2) == brute(rows)


def test_few_rows(spark):
    assert mined(spark, [], 1) == []
    assert mined(spark, [(0, [1.0], 1)], 1) == []
    assert mined(spark, [(0, [1.0], 1), (1, [2.0], 1), (2, [0.5], 2), (100, [-1.0], 1)], 1) == brute([(0, [1.0], 1), (1, [2.0], 1), (2, [0.5], 2), (100, [-1.0], 1)])


def test_planes_give_the_components_back():
    x = np.array([[-8, 7, 0], [3, -1, 5]])
    planes, bits = hard_negatives.bit_planes(x)
    back = sum((-(1 << j) if j == planes - 1 else 1 << j) * hard_negatives._plane(bits, j, planes, 2, 3, np.int64).T for j in range(planes))
    assert planes == 4 and (back == x).all()
