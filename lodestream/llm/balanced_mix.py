"""Mixing sources to target weights by the cube method.

Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share the corpus's words by weight; a
target stops at `max_repeats` times its source's words, and what is above is shared again by weight. The
shares are the level L of a water filling, sum(min(L w, cap)) = total, found from prefix sums.

Every document of a source is taken floor(target / words) times, and once more with the remaining
fraction as inclusion probability. The cube method decides these fractions: the vector of probabilities moves
through the null space of the balancing constraints (number of documents and number of words), each step
making at least one probability 0 or 1, until as many units are left as there are constraints.

Flights run in blocks of a few thousand units of one source, dealt by a hash of the row and, where rows are equal, of
its number among them, so that no block is much longer than others. Each leaves two undecided
units at most; these form the next round's blocks, so every round is a thousand times smaller, and the last block
of a source ends with the landing: the document constraint is dropped, then the last unit is drawn. A source of any size is
so many blocks, and its totals stay within about two documents of its target.

Runs agree: blocks, orders and draws follow hashes and the seed. Defined results: null and blank texts
have size 0, count as documents and take 0 words; a null source is a source and the last; equal rows are
interchangeable and each is a unit; a very long text is one unit of its size; an empty table gives an empty table. Other columns pass through `mix`.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
BLOCK = 4096
EPS = 1e-9


def targets(sizes: DataFrame, max_repeats: int = 3) -> DataFrame:
    """source, source_size, target from rows of source, size."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(by_name) - 1) % len(WEIGHTS)) + 1)
    sources = sources.withColumn("weight", weight).withColumn("cap", max_repeats * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    sources = sources.withColumn("place", F.row_number().over(order)).withColumn(
        "level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(on)
    )
    capped = F.col("cap") <= F.col("level") * F.col("weight")
    final = F.min(F.when(~capped, F.struct("place", "level"))).over(everything)["level"]
    target = F.when(final.isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), final * F.col("weight")))
    return sources.select("source", "source_size", "n_docs", target.alias("target"))


def flight(pi: list[float], size: list[float], rng: random.Random, land: bool) -> list[float]:
    """Inclusion probabilities after the flight phase; with `land` all are 0 or 1.

    Balanced are sum(pi) and sum(pi * size). At most two are left strictly between 0 and 1.
    """
    pi = list(pi)
    active: list[int] = []

    def step(ids: list[int], u: list[float]) -> None:
        up = min((1 - pi[i]) / x if x > 0 else pi[i] / -x for i, x in zip(ids, u) if x)
        down = min(pi[i] / x if x > 0 else (1 - pi[i]) / -x for i, x in zip(ids, u) if x)
        move = up if rng.random() * (up + down) < down else -down
        for i, x in zip(ids, u):
            p = pi[i] + move * x
            pi[i] = 0.0 if p < EPS else 1.0 if p > 1 - EPS else p

    def open_(i: int) -> bool:
        return 0.0 < pi[i] < 1.0

    for k in range(len(pi)):
        if not open_(k):
            continue
        active.append(k)
        if len(active) == 3:
            a, b, c = (size[i] for i in active)
            u = [c - b, a - c, b - a]
            top = max(map(abs, u))
            step(active, [x / top for x in u] if top else [1.0, -1.0, 0.0])
            active = [i for i in active if open_(i)]
    if len(active) == 2 and size[active[0]] == size[active[1]]:
        step(active, [1.0, -1.0])
        active = [i for i in active if open_(i)]
    if land:
        while len(active) > 1:
            a, b = size[active[0]], size[active[1]]
            top = max(abs(a), abs(b))
            step(active[:2], [b / top, -a / top] if top else [1.0, -1.0])
            active = [i for i in active if open_(i)]
        for i in active:
            pi[i] = 1.0 if rng.random() < pi[i] else 0.0
    return pi


def mixed(docs: DataFrame, max_repeats: int = 3, seed: int = 1) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (times taken) and the hashes _key1 and _key2 of every row of docs."""
    rows = common.numbered(docs.select("doc_id", "source", common.n_words(F.col("text")).alias("size"), *common.whole_key(docs.columns)))
    rows = common.stored(rows, "rows")
    shares = common.small(common.stored(targets(rows, max_repeats), "targets")).withColumnRenamed("source", "_source")
    rows = rows.join(shares, rows["source"].eqNullSafe(F.col("_source"))).drop("_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("base", F.floor(ratio + EPS).cast("int")).withColumn("pi", ratio - F.col("base"))
    rows = rows.withColumn("pi", F.when(F.col("pi") < EPS, 0.0).otherwise(F.col("pi"))).withColumnRenamed("n_docs", "n")
    decided, rest, kept = [], rows, [c for c in rows.columns if c not in ("n", "pi")]

    def fly(units: pa.Table) -> pa.Table:
        units = units.sort_by([("h", "ascending"), ("size", "ascending")])
        first = {c: units.column(c)[0].as_py() for c in ("h", "round", "blocks")}
        rng = random.Random(f"{seed} {first['h']} {units.num_rows} {first['round']}")
        pi = flight(units.column("pi").to_pylist(), units.column("size").to_pylist(), rng, first["blocks"] == 1)
        return units.set_column(units.schema.get_field_index("pi"), "pi", pa.array(pi, pa.float64()))

    number = 0
    while True:
        blocks = F.ceil(F.col("n") / BLOCK)
        dealt = rest.withColumn("round", F.lit(number)).withColumn("blocks", blocks).withColumn("h", F.xxhash64(F.lit(seed), F.lit(number), "_key1", "nth"))
        dealt = dealt.withColumn("block", F.pmod("h", "blocks"))
        flown = common.stored(dealt.groupBy("source", "block").applyInArrow(fly, dealt.schema), f"flight{number}")
        done = F.col("pi").isin(0.0, 1.0)
        decided.append(flown.where(done).select(*kept, "pi"))
        if flown.where(~done).limit(1).count() == 0:
            break
        rest = flown.where(~done)
        left = rest.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("source", "_source")
        rest = rest.select(*kept, "pi").join(left, rest["source"].eqNullSafe(F.col("_source"))).drop("_source")
        number += 1
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out.withColumn("copies", F.col("base") + F.col("pi").cast("int")).drop("base", "pi")


def mix_report(docs: DataFrame, max_repeats: int = 3, seed: int = 1) -> DataFrame:
    out = mixed(docs, max_repeats, seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source", "copies")


def mix(docs: DataFrame, max_repeats: int = 3, seed: int = 1) -> DataFrame:
    """The mixture: each row of docs as many times as it is taken; columns as in docs."""
    copies = mixed(docs, max_repeats, seed).where("copies > 0").select("_key1", "_key2", "copies")
    out = common.deal(docs, copies)
    return out.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*common.unpacked(docs.columns))
