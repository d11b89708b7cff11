"""A sweep from its configuration file to its results, over whole line items by status."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import drift, sweep
from ..session import shared_folder
from ..sources import tables
from ..sources.tables import table
from .catalogue import CLASSES, query, rounded

#: The first experiment ends its runs early, the second has all rows.
CONFIGS = [
    {"experiment_group": "short", "datasets": ["F", "O"], "seeds": [1, 2], "warmup": 100, "log_every": 400, "max_instances": 1500, "model_variants": [{"name": n.lower(), "model": n, "selector": "S1", "detector": "HOEFFDING"} for n in ("NO_CHANGE", "RANDOM")]},
    {"experiment_group": "whole", "datasets": ["F", "O"], "seeds": [3], "warmup": 100, "log_every": 1000, "model_variants": [{"name": n.lower(), "model": n, "selector": "S1", "detector": "HOEFFDING"} for n in ("NO_CHANGE", "MAJORITY", "RANDOM")]},
]


def _sweep(spark, sf_dir):
    folder = shared_folder(spark)
    for c in CONFIGS:  # a file for each: of several in one file only the first is read
        spark.createDataFrame([(json.dumps(c),)], "line string").coalesce(1).write.text(f"{folder}/configs/{c['experiment_group']}")
    runs = tables.runs(tables.config(spark, f"{folder}/configs/*"))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    y = F.expr(f"CASE l_returnflag {' '.join(f"WHEN '{c}' THEN {n}" for c, n in CLASSES.items())} END")
    labelled = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("dataset"), *order, y.alias("y"), F.col("l_quantity").alias("quantity"))
    data = drift.positions(labelled, ["dataset"], order)
    return data, runs, f"{folder}/results"


def _variants_sql() -> str:
    rows = [(c["experiment_group"], v["name"], s, c["log_every"], c.get("max_instances", 2**62)) for c in CONFIGS for v in c["model_variants"] for s in c["seeds"]]
    return "(VALUES " + ", ".join(f"('{g}', '{v}', {s}, {e}, {m})" for g, v, s, e, m in rows) + ") v(experiment_group, variant, seed, log_every, most)"


COUNTS = ", ".join(f"count(*) FILTER (y = {c}) OVER u AS y{c}, count(*) FILTER (p = {c}) OVER u AS p{c}" for c in range(3))
CHANCE = "(" + " + ".join(f"y{c}::DOUBLE * p{c}" for c in range(3)) + ") / (n::DOUBLE * n)"


@query(
    f"""WITH d AS (SELECT l_linestatus AS dataset, row_number() OVER w - 1 AS seq, list_position(['A', 'N', 'R'], l_returnflag) - 1 AS y FROM lineitem WINDOW w AS (PARTITION BY l_linestatus ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice)),
    b AS (SELECT *, lag(y) OVER (PARTITION BY dataset ORDER BY seq) AS before, {", ".join(f"count(*) FILTER (y = {c}) OVER q AS c{c}" for c in range(3))} FROM d WINDOW q AS (PARTITION BY dataset ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    r AS (SELECT *, CASE variant WHEN 'no_change' THEN coalesce(before, 0) WHEN 'majority' THEN CASE WHEN c0 >= c1 AND c0 >= c2 THEN 0 WHEN c1 >= c2 THEN 1 ELSE 2 END ELSE (seq * 7919 + seed * 104729) % 1000003 % 3 END AS p FROM b, {_variants_sql()} WHERE seq < most),
    m AS (SELECT experiment_group, dataset, variant, seed, log_every, count(*) OVER u AS n, sum((y = p)::INT) OVER u AS h, sum(coalesce((before = y)::INT, 0)) OVER u AS l, {COUNTS}, count(*) OVER (PARTITION BY experiment_group, dataset, variant, seed) AS whole FROM r WINDOW u AS (PARTITION BY experiment_group, dataset, variant, seed ORDER BY seq ROWS UNBOUNDED PRECEDING)),
    k AS (SELECT *, h / n::DOUBLE AS a, {CHANCE} AS pe, CASE WHEN n > 1 THEN l / (n - 1)::DOUBLE ELSE 0 END AS pt FROM m WHERE n % log_every = 0 OR n = whole)
    SELECT experiment_group, dataset, variant, seed, n AS instance_num, round(a, 6) AS accuracy, round(CASE WHEN abs(1 - pe) < 1e-12 THEN 0 ELSE (a - pe) / (1 - pe) END, 6) AS kappa, round(CASE WHEN abs(1 - pt) < 1e-12 THEN 0 ELSE (a - pt) / (1 - pt) END, 6) AS kappa_per FROM k"""
)
def sweep_results(spark, sf_dir):
    """The logged rows of every run of two configurations, read back from their folders."""
    data, runs, path = _sweep(spark, sf_dir)
    return rounded(sweep.run(data, runs, ["quantity"], 3, path).select(*sweep.RUN, "instance_num", "accuracy", "kappa", "kappa_per"))


@query(
    f"""WITH d AS (SELECT l_linestatus AS dataset, count(*) AS n FROM lineitem GROUP BY ALL) SELECT experiment_group, dataset, variant, seed, least(n, most) AS n_rows FROM d, {_variants_sql()}"""
)
def sweep_runs(spark, sf_dir):
    """The rows that each run of the sweep has."""
    data, runs, _ = _sweep(spark, sf_dir)
    return sweep.streams(data, runs).groupBy("run").agg(F.count(F.lit(1)).alias("n_rows")).select("run.*", "n_rows")
