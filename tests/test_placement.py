"""Rows dealt by run once: later steps keep them in their tasks, and give what the plain forms give."""

import pytest
from pyspark.sql import functions as F

from lodestream import session
from lodestream.operators import discretiser, drift, ensembles, ranking

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(900).select((F.col("id") % 3).alias("run"), F.floor(F.col("id") / 3).alias("seq"), (F.xxhash64("id") % 7).alias("h"))
    df = df.select("run", "seq", (F.abs("h") % 3).cast("int").alias("y"), F.when(F.col("h") != 0, F.col("h").cast("double")).alias("a"), (F.col("h") * F.col("seq") % 50).cast("double").alias("b"))
    df = df.where("run <> 1 OR seq NOT BETWEEN 100 AND 149")  # a block is missing
    df.cache().count()
    return df


def same(left, right):
    got, want = (sorted(map(repr, df.select(*sorted(df.columns)).collect())) for df in (left, right))
    assert got == want and got


def test_distances_of_blocks(rows):
    blocked = ensembles.blocks(rows, 50)
    sides = ensembles._long(blocked, FEATURES).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("block", F.col("block") + 1 - F.col("side"))
    same(ensembles.block_distances(blocked, FEATURES), drift.distance(sides, "run", "block", "feature").where("n0 > 0 and n1 > 0"))


def test_histogram_over_own_first_rows(rows):
    blocked = ensembles.blocks(rows, 50)
    long = ranking.long_form(blocked, FEATURES, "y", "run", "block")
    want = ranking.histogram(long, ranking.ranges(long.where("block = 0"), "run"), 10, "run", "block")
    same(ranking.own_histogram(blocked, FEATURES, "y", F.col("block") == 0, 10, "block"), want)


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_rows_dealt_by_run_are_not_shuffled_again(spark, rows, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    tasks = session.tasks_of(rows)
    assert tasks == 9 and session.keyed(rows, "run").rdd.getNumPartitions() == 9
    blocked = ensembles.blocks(session.keyed(rows, "run"), 50)
    assert shuffles(ensembles.block_scores(blocked, FEATURES)) == 1  # that of `keyed`
    long = ranking.long_form(blocked.withColumnRenamed("block", "update"), FEATURES, "y", "run", "update")
    same(discretiser.gathered(long, 12, tasks=tasks), discretiser.gathered(ranking.long_form(ensembles.blocks(rows, 50).withColumnRenamed("block", "update"), FEATURES, "y", "run", "update"), 12))
