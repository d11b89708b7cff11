"""Sweeps: bounded runs, results by run, and a second start that does what is missing."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.operators import drift, prequential, sweep
from lodestream.plans import experiments
from lodestream.sources import generators, tables

SETTINGS = {"experiment_group": "g", "datasets": ["s0", "s1"], "seeds": [1, 2], "warmup": 50, "log_every": 300, "max_instances": 700}
VARIANTS = [{"name": "same", "model": "NO_CHANGE", "selector": "S1", "detector": "HOEFFDING"}, {"name": "nb", "model": "NAIVE_BAYES", "selector": "S1", "detector": "ADAPTIVE_WINDOW"}]


@pytest.fixture(scope="module")
def data(spark):
    rows = generators.sea(spark, 2, 1000, seed=4)
    return rows.select(F.concat(F.lit("s"), "run").alias("dataset"), "seq", "y", "x0", "x1").cache()


def runs(spark, folder, **other):
    (folder / "config.json").write_text(json.dumps(SETTINGS | {"model_variants": VARIANTS} | other))
    return tables.runs(tables.config(spark, str(folder)))


def test_runs_end_where_their_limit_is(spark, data, tmp_path):
    out = sweep.results(data, runs(spark, tmp_path), ["x0", "x1"], 2)
    rows = {(r.dataset, r.variant, r.seed, r.instance_num): r for r in out.collect()}
    assert {k[3] for k in rows} == {300, 600, 700} and len(rows) == 2 * 2 * 2 * 3
    whole = sweep.results(data, runs(spark, tmp_path, max_instances=0, seeds=[1]), ["x0", "x1"], 2)
    assert {r.instance_num for r in whole.collect()} == {300, 600, 900, 1000}
    own = prequential.no_change(data.where("dataset = 's0' AND seq < 700").withColumn("run", F.lit(0)))
    want = prequential.metrics(own, 2).where("seq = 699").first()
    got = rows["s0", "same", 1, 700]
    assert (got.accuracy, got.kappa, got.kappa_per) == pytest.approx((want.accuracy, want.kappa, want.kappa_temporal))
    errors = own.where("seq >= 50").select("run", "seq", (F.col("p") != F.col("y")).cast("double").alias("error"))
    assert got.drift_count == drift.alarms(errors, "run", "seq", "error", drift.HoeffdingMean).count()


def test_a_second_start_does_what_is_missing(spark, data, tmp_path):
    (tmp_path / "configs").mkdir()
    path = str(tmp_path / "results")
    first = runs(spark, tmp_path / "configs", seeds=[1])
    n = sweep.run(data, first, ["x0", "x1"], 2, path).count()
    assert n == 12 and sweep.missing(spark, first, path).isEmpty()
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "results").rglob("*.parquet")}
    both = runs(spark, tmp_path / "configs")
    assert {r.seed for r in sweep.missing(spark, both, path).collect()} == {2}
    assert sweep.run(data, both, ["x0", "x1"], 2, path).count() == 24
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())  # what was there has not been done again


def test_unknown_names_are_errors(spark, data, tmp_path):
    odd = runs(spark, tmp_path, model_variants=[VARIANTS[0] | {"model": "ORACLE"}])
    with pytest.raises(ValueError, match="ORACLE"):
        sweep.results(data, odd, ["x0", "x1"], 2)


def test_random_predictions_of_long_runs(spark):
    """Positions and seeds whose multiples are beyond 32 bits."""
    rows = spark.createDataFrame([(300_000, 3), (2_000_000_000, 30_000)], "seq int, seed int")
    got = {r.seq: r.p for r in sweep.MODELS["RANDOM"](rows, [], 3).collect()}
    assert got == {q: (q * 7919 + s * 104729) % 1000003 % 3 for q, s in ((300_000, 3), (2_000_000_000, 30_000))}


@pytest.mark.parametrize("cores", [2, 5, 12])
def test_every_configuration_is_read_under_any_parallelism(spark, monkeypatch, cores):
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", property(lambda _: cores))
    _, found, _ = experiments._sweep(spark, "/root/testdata/sf0.001")
    assert {r.experiment_group: r["count"] for r in found.groupBy("experiment_group").count().collect()} == {"short": 8, "whole": 6}


def test_rows_are_not_copied_for_each_run(spark, data, tmp_path):
    """Eight seeds of a data set shuffle hardly more rows than one."""
    store, moved = spark.sparkContext._jsc.sc().statusStore(), []

    def records():
        none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    for seeds in ([1], list(range(8))):
        before = records()
        assert sweep.results(data, runs(spark, tmp_path, model_variants=[VARIANTS[0]], seeds=seeds), ["x0", "x1"], 2).count() == 6 * len(seeds)
        moved.append(records() - before)
    assert moved[1] < moved[0] + 700


@pytest.mark.parametrize("piece", [7, 4096])
def test_pieces_of_odd_rows(spark, monkeypatch, tmp_path, piece):
    """Gaps, NULL labels and labels out of range, against windows over the whole runs."""
    monkeypatch.setattr(sweep, "PIECE", piece)
    y = F.when(F.col("id") % 11 == 3, None).when(F.col("id") % 13 == 5, 7).otherwise(F.abs(F.xxhash64("id")) % F.when(F.col("id") < 500, 2).otherwise(3))
    rows = spark.range(900).where("id % 17 <> 4 AND id NOT BETWEEN 200 AND 260").select(F.lit("s0").alias("dataset"), F.col("id").alias("seq"), y.cast("int").alias("y"), (F.col("id") % 5).cast("double").alias("x0")).cache()
    variants = [{"name": m, "model": m, "selector": "S1", "detector": "HOEFFDING"} for m in sorted(sweep.MODELS)]
    got = {(r.variant, r.instance_num): r for r in sweep.results(rows, runs(spark, tmp_path, model_variants=variants, datasets=["s0"], seeds=[3], log_every=100, max_instances=800), ["x0"], 3).collect()}
    for m in sweep.MODELS:
        found = sweep.MODELS[m](rows.where("seq < 800").withColumns({"run": F.lit(0), "seed": F.lit(3)}), ["x0"], 3)
        errors = found.where("seq >= 50").select("run", "seq", (F.col("p") != F.col("y")).cast("double").alias("error"))
        fired = {r.seq for r in drift.alarms(errors, "run", "seq", "error", drift.HoeffdingMean).collect()}
        want = sorted(prequential.metrics(found, 3).collect(), key=lambda r: r.seq)
        assert {k[1] for k in got if k[0] == m} == {*range(100, len(want), 100), len(want)}
        for (_, n), r in ((k, r) for k, r in got.items() if k[0] == m):
            assert (r.accuracy, r.kappa, r.kappa_per) == pytest.approx((want[n - 1].accuracy, want[n - 1].kappa, want[n - 1].kappa_temporal))
            assert r.drift_count == len(fired & {w.seq for w in want[:n]})


def test_changes_of_many_values_are_those_one_by_one():
    rng = np.random.default_rng(5)
    values = np.concatenate([(rng.random(3000) < p).astype(float) for p in (0.1, 0.6, 0.2, 0.9, 0.05)])
    one = drift.HoeffdingMean()
    want = [i for i, x in enumerate(values.tolist()) if one.add(x)]
    many, got = drift.HoeffdingMean(), []
    for a in range(0, len(values), 700):
        got += [a + i for i in drift.changes(many, values[a : a + 700])]
    assert got == want and len(want) >= 2 and vars(many) == vars(one)


def test_positions_by_ranges(spark, monkeypatch):
    rows = spark.range(3000).select((F.col("id") % 2).alias("g"), F.xxhash64("id").alias("a"), F.col("id"))
    want = {(r.id, r.seq) for r in drift.positions(rows.select("*", F.col("a").alias("b")), ["g"], ["a"]).collect()}
    monkeypatch.setattr(drift, "FEW", 100)
    assert {(r.id, r.seq) for r in drift.positions(rows.repartition(5), ["g"], ["a"]).collect()} == want and max(s for _, s in want) == 1499
