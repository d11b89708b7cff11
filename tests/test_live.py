"""Live sample windows: any cut into micro-batches gives what the whole stream gives in order of time."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lodestream.operators import drift
from lodestream.session import shared_folder
from lodestream.streaming import live

SCHEMA = "run long, seq long, ts timestamp, value double"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def events(seed):
    """Three runs in order of time; each changes at half time; run 2 is silent for a day in between."""
    rng, rows = random.Random(seed), []
    for i in range(900):
        run = i % 3
        late = 86_400 * (run == 2 and i >= 450)
        value = None if i % 50 == 7 else rng.gauss(3 * (i >= 450), 1)
        rows.append((run, i, START + dt.timedelta(seconds=20 * (i // 2) + late), value))  # two rows of one time
    return rows


def plain(rows, idle):
    """Alarms of the rows that the last watermark has passed, by run."""
    end = max(r[2] for r in rows if r[3] is not None) - dt.timedelta(minutes=10)
    out = set()
    for run in {r[0] for r in rows}:
        window, last = drift.SampleWindow(25, 0.01, 5), None
        for _, seq, ts, value in sorted((r for r in rows if r[0] == run and r[3] is not None and r[2] <= end), key=lambda r: (r[2], r[1])):
            if last is not None and (ts - last).total_seconds() * 1000 > idle:
                window.reset()
            if window.add(value):
                out.add((run, seq))
            last = ts
    return out


def test_any_cut_and_a_restart(spark):
    rows = events(1)
    ordered = sorted(rows, key=lambda r: r[2])
    for seed, idle in ((2, 1 << 40), (3, 3_600_000)):
        rng = random.Random(seed)
        moved = sorted(rows, key=lambda r: (r[2] + dt.timedelta(seconds=rng.uniform(0, 500)), r[1]))  # arrival: within the watermark
        cuts = sorted(rng.sample(range(1, len(moved)), 3))
        folder = shared_folder(spark)
        for a, b in zip([0, *cuts], [*cuts, len(moved)]):  # each batch by a query of its own that goes on from the state
            spark.createDataFrame(moved[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/landed")
            stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/landed")
            found = live.finished(live.sample_windows(stream, "10 minutes", 25, 0.01, 5, idle), "append", folder)
        got = [tuple(r) for r in found.select("run", "seq").collect()]
        assert len(got) == len(set(got)) and set(got) == plain(ordered, idle) and got


def test_slices_land_one_after_the_other(spark):
    rows = events(4)
    df = spark.createDataFrame(rows, SCHEMA)
    found = live.slices(spark, df, "ts", 2, lambda s: live.sample_windows(s, "10 minutes", 25, 0.01, 5))
    assert {tuple(r) for r in found.collect()} == plain(rows, 1 << 40)
