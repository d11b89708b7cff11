"""Reactions to alarms: which features drifted, what to select afterwards, and what to do with each learner.

Streams are in long form (run, i, feature, value, cls), or have a column for each feature, i counting the rows of a run from 1; alarms are rows
run, at (an i). Rows find their alarm by a window over their run, so a run's alarms never meet all its rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import drift, ranking


def around_alarms(stream: DataFrame, alarms: DataFrame, width: int, before: bool = True, tasks: int | None = None) -> DataFrame:
    """Rows of the `width` before an alarm (side 0; not without `before`) and the `width` from it on (side 1), with the alarm `at`.

    stream: run, i and any other columns. A row within reach of two alarms counts for both. Alarms stand among the rows they are for, so one shuffle by run serves all; each row
    takes the last one before it in either direction, so the work grows with the rows, whatever the length of a run. tasks: as many as the stream
    has been dealt to by run; then the alarms alone are shuffled.
    """
    marks = alarms.where("run IS NOT NULL AND at IS NOT NULL").select("run", F.col("at").cast(stream.schema["i"].dataType).alias("i")).withColumn("_alarm", F.col("i"))
    rows = stream.unionByName(marks if tasks is None else marks.repartition(tasks, "run"), allowMissingColumns=True)
    mark, run = F.col("_alarm").isNotNull(), Window.partitionBy("run")
    upto = run.orderBy("i", F.desc(mark)).rowsBetween(Window.unboundedPreceding, 0)  # an alarm comes before the row it is for
    beyond = run.orderBy(F.desc("i"), mark).rowsBetween(Window.unboundedPreceding, 0)  # and here after it
    near = lambda at, side: F.struct(at.alias("at"), F.lit(side).alias("side"))
    last, following = F.col("_last"), F.col("_next")
    found = {"_last": F.last("_alarm", True).over(upto)} | ({"_next": F.last("_alarm", True).over(beyond)} if before else {})
    reach = [F.when(F.col("i") < last + width, near(last, 1)), *([F.when(F.col("i") >= following - width, near(following, 0))] if before else [])]
    marked = rows.withColumns(found).where(~mark).withColumn("_near", F.explode(F.array_compact(F.array(*reach))))
    return marked.select(*stream.columns, "_near.at", "_near.side")


def _long(stream: DataFrame, features: Sequence[str] | None, *by: str) -> DataFrame:
    """The stream in long form, which it has already where no features are given."""
    return stream if features is None else ranking.long_form(stream, features, "cls", *by)


def drifting_features(stream: DataFrame, alarms: DataFrame, width: int, q: float = 0.05, features: Sequence[str] | None = None) -> DataFrame:
    """run, at, feature, ks, p, drift: two-sample tests at each alarm, under one false discovery rate per alarm.

    features: the columns of a stream (run, i, cls) that is not in long form; only its rows around alarms are brought into it.
    """
    d = drift.distance(_long(around_alarms(stream, alarms, width), features, "run", "at", "side").select("run", "at", "feature", "side", "value"), "run", "at", "feature")
    tests = d.where("n0 > 0 and n1 > 0").select("run", "at", "feature", "ks", drift.p_value(F.col("ks"), F.col("n0").cast("double"), F.col("n1").cast("double")).alias("p"))
    mine = Window.partitionBy("run", "at")
    tests = tests.withColumn("_r", F.row_number().over(mine.orderBy("p", "feature"))).withColumn("_m", F.count(F.lit(1)).over(mine))
    cut = F.max(F.when(F.col("p") <= F.col("_r") * q / F.col("_m"), F.col("_r"))).over(mine)
    return tests.withColumn("drift", F.col("_r") <= F.coalesce(cut, F.lit(0))).drop("_r", "_m")


def selection_after_alarms(stream: DataFrame, alarms: DataFrame, width: int, k: int, bins: int = 20, score: str = "chi2", warm_up: int = 200, features: Sequence[str] | None = None, tasks: int | None = None) -> DataFrame:
    """run, at, feature, rank: the k best features on the `width` rows from each alarm on, binned over the first `warm_up` rows of the runs.

    features: as in `drifting_features`; tasks: as in `around_alarms`.
    """
    after = _long(around_alarms(stream, alarms, width, False, tasks), features, "run", "at")
    first = _long(stream.where(F.col("i") <= warm_up), features)
    counts = ranking.histogram(after, ranking.ranges(first), bins, "run", "at")
    return ranking.top(ranking.scores(counts, "run", "at"), score, k, "run", "at").select("run", "at", "feature", "rank")


def actions(subspaces: DataFrame, drifting: DataFrame, full: float = 0.5) -> DataFrame:
    """learner, overlap, action: KEEP without a drifting feature, SURGICAL below the share `full` of them, else FULL.

    subspaces: learner, feature; drifting: feature.
    """
    hit = subspaces.join(F.broadcast(drifting.select("feature", F.lit(1).alias("_d")).distinct()), "feature", "left")  # a row per feature
    share = F.count("_d") / F.count(F.lit(1))
    action = F.when(F.col("overlap") == 0, "KEEP").when(F.col("overlap") < full, "SURGICAL").otherwise("FULL")
    return hit.groupBy("learner").agg(share.alias("overlap")).withColumn("action", action)


def voted(votes: DataFrame, weights: DataFrame) -> DataFrame:
    """run, seq, p: the class with the greatest weighted sum of votes, the lowest of equals.

    votes: run, seq, learner, cls, vote; weights: learner, weight. Where all weights are 0 votes count equally.
    """
    total = weights.agg(F.sum("weight").alias("_t"))
    joined = votes.join(F.broadcast(weights), "learner").crossJoin(F.broadcast(total))  # a row per learner; one row
    sums = joined.groupBy("run", "seq", "cls").agg(F.sum(F.when(F.col("_t") > 0, F.col("weight")).otherwise(1.0) * F.col("vote")).alias("s"))
    return sums.groupBy("run", "seq").agg(F.max_by("cls", F.struct("s", -F.col("cls"))).alias("p"))


def learner_weights(subspaces: DataFrame, importance: DataFrame) -> DataFrame:
    """learner, weight: mean importance over its features, summing to 1; equal where all are 0."""
    means = subspaces.join(F.broadcast(importance), "feature", "left").groupBy("learner").agg(F.avg(F.coalesce("importance", F.lit(0.0))).alias("_m"))
    everything = Window.partitionBy()  # a row per learner
    total = F.sum("_m").over(everything)
    return means.select("learner", F.when(total > 0, F.col("_m") / total).otherwise(1 / F.count(F.lit(1)).over(everything)).alias("weight"))


def evolving_selection(scored: DataFrame, k: int, score: str = "chi2", most: int | None = None, tenure: int = 1, warm_up: int = 1) -> DataFrame:
    """run, period, selected (sorted), n_swapped: a selection that changes by few swaps from period to period.

    scored: run, period, feature, the score and, optionally, `drift` (boolean). The first `warm_up` periods of a run
    give nothing but the last of them, whose k best features start the selection. Later, drifting selected features
    go, worst first, for the best others that do not drift, without limit; then the worst that have stayed `tenure`
    periods go for the best others, at most `most` (0.3 k, rounded up). Either pairing stops at the first pair that
    gains nothing; ties go by name, a NULL score is 0.

    The scores of a period are one row; a task reads them in order and holds one run's selection.
    """
    limit = max(1, -int(-0.3 * k // 1)) if most is None else most
    drifts = F.coalesce("drift", F.lit(False)) if "drift" in scored.columns else F.lit(False)
    rows = scored.groupBy("run", "period").agg(F.collect_list(F.struct("feature", F.coalesce(score, F.lit(0.0)).cast("double").alias("score"), drifts.alias("drift"))).alias("found"))
    out = f"run {scored.schema['run'].dataType.simpleString()}, period {scored.schema['period'].dataType.simpleString()}, selected array<string>, n_swapped long"

    def swapped(since: dict, leaving: list, entering: list, value: dict, now: int) -> int:
        n = 0
        for a, b in zip(sorted(leaving, key=lambda f: (value.get(f, 0.0), f)), sorted(entering, key=lambda f: (-value[f], f))):
            if value[b] <= value.get(a, 0.0):
                break
            del since[a]
            since[b] = now
            n += 1
        return n

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, since, now = object(), {}, 0
        for pdf in frames:
            made = []
            for run, period, found in zip(pdf["run"], pdf["period"], pdf["found"]):
                if run != current:
                    current, since, now = run, {}, 0
                now += 1
                value = {x["feature"]: x["score"] for x in found}
                drifting = {x["feature"] for x in found if x["drift"]}
                if now < warm_up:
                    continue
                if now == warm_up:
                    since = dict.fromkeys(sorted(value, key=lambda f: (-value[f], f))[:k], now)
                    made.append((run, period, sorted(since), 0))
                    continue
                n = swapped(since, [f for f in since if f in drifting], [f for f in value if f not in since and f not in drifting], value, now)
                others = sorted((f for f in value if f not in since), key=lambda f: (-value[f], f))[:limit]
                n += swapped(since, [f for f in since if now - since[f] >= tenure], others, value, now)
                made.append((run, period, sorted(since), n))
            yield pd.DataFrame(made, columns=["run", "period", "selected", "n_swapped"]).astype({"run": pdf["run"].dtype, "period": pdf["period"].dtype, "n_swapped": "int64"})

    return rows.repartition("run").sortWithinPartitions("run", "period").mapInPandas(fold, out)
