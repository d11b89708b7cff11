"""Measured runs: counts by class against the metrics of all rows, drifts and recovery at batches' ends."""

import pytest
from pyspark.sql import functions as F

from lodestream.operators import prequential
from lodestream.session import shared_folder
from lodestream.sources import generators
from lodestream.streaming import measured


def test_a_run_in_batches(spark):
    rows = prequential.no_change(generators.sea(spark, 1, 900, seed=8).select("run", "seq", "y"))
    folder = shared_folder(spark)
    named = rows.withColumn("before", F.when(F.col("seq") > 0, F.col("p"))).cache()
    for k in range(3):
        named.where(F.floor(F.col("seq") / 300) == k).coalesce(1).write.mode("append").parquet(f"{folder}/landed")
    stream = spark.readStream.schema(named.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/landed")
    got = measured.run(stream, "no_change", 2, f"{folder}/run").orderBy("instance_num").collect()
    want = {r.seq + 1: r for r in prequential.metrics(rows, 2).where("seq % 300 = 299").collect()}
    assert [r.instance_num for r in got] == [300, 600, 900]
    for r in got:
        w = want[r.instance_num]
        assert (r.accuracy, r.kappa, r.kappa_per) == pytest.approx((w.accuracy, w.kappa, w.kappa_temporal))
        assert r.run == "no_change" and r.seconds > 0 and r.micros_per_instance > 0 and r.ram_hours >= 0 and r.feature_stability_ratio == 1
    assert [r.seconds for r in got] == sorted(r.seconds for r in got)
    assert spark.read.parquet(f"{folder}/run/rows").count() == 900


def batch(at, n, hits, mb=1024.0):
    return (at, 2.0, mb, {"n": n, "hits": hits, "y0": n, "p0": hits, "y1": 0, "p1": n - hits})


def test_drift_recovery_and_memory():
    batches = {i: batch(3600.0 * i, 1000, hits) for i, hits in enumerate([900, 905, 895, 300, 310, 890, 900])}
    rows = measured.table(batches, "r", 2)
    drifts, back, gb = [r[8] for r in rows], [r[9] for r in rows], [r[6] for r in rows]
    assert drifts == [0, 0, 0, 1, 1, 1, 1] and back[:5] == [None] * 5
    assert back[5:] == [2000, 2000]  # back within the tolerance of the best prefix
    assert gb == pytest.approx([0, 1, 2, 3, 4, 5, 6])  # a GB for an hour between the ends of batches
    assert measured.table({}, "r", 2) == [] and measured.table({0: batch(0.0, 0, 0)}, "r", 2) == []
