"""Rows around alarms against a plain version, in both forms; the plan's work grows with the rows."""

import random

from lodestream.operators import adaptive


def test_rows_around_alarms(spark):
    rng = random.Random(3)
    rows = [(run, i, rng.choice("AB"), rng.random(), None if i % 5 == 0 else rng.random()) for run, n in ((1, 40), (2, 90), (3, 7), (None, 20)) for i in range(1, n + 1)]
    alarms = [(run, at) for run, n in ((1, 40), (2, 90)) for at in sorted(rng.sample(range(1, n + 1), 6))] + [(1, 40), (2, 1), (2, 2), (2, 2), (None, 4), (2, None)]
    stream = spark.createDataFrame(rows, "run int, i int, cls string, a double, b double").repartition(3)
    marks = spark.createDataFrame(alarms, "run int, at int")
    ats = {run: sorted({at for r, at in alarms if r == run and at is not None}) for run in (1, 2)}
    want = []
    for run, i, *_ in rows:
        last, following = ([f(x for x in ats.get(run, []) if ok(x)) for f, ok in ((lambda s: max(s, default=None), lambda x: x <= i), (lambda s: min(s, default=None), lambda x: x > i))])
        want += [(run, i, last, 1)] if last is not None and i < last + 9 else []
        want += [(run, i, following, 0)] if following is not None and i >= following - 9 else []
    key = lambda x: tuple(map(str, x))
    found = adaptive.around_alarms(stream, marks, 9)
    assert sorted(map(tuple, found.select("run", "i", "at", "side").collect()), key=key) == sorted(want, key=key)
    assert adaptive.around_alarms(stream, marks, 9, before=False).where("side = 0").count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString().lower()
    assert "unboundedfollowing" not in plan and "join" not in plan  # such a frame goes through the rest of a run for each row


def test_both_forms_of_a_stream_agree(spark):
    rng = random.Random(4)
    rows = [(run, i, rng.choice("ABC"), rng.random(), rng.random() + i / 100) for run in (1, 2) for i in range(1, 121)]
    wide = spark.createDataFrame(rows, "run int, i int, cls string, a double, b double")
    long = wide.unpivot(["run", "i", "cls"], ["a", "b"], "feature", "value")
    marks = spark.createDataFrame([(1, 30), (1, 70), (2, 50)], "run int, at int")
    order = ["run", "at", "feature"]
    for f in (lambda s, **k: adaptive.drifting_features(s, marks, 20, **k), lambda s, **k: adaptive.selection_after_alarms(s, marks, 20, 1, **k)):
        own = f(wide, features=["a", "b"]).orderBy(*order).collect()
        assert own and own == f(long).orderBy(*order).collect()
