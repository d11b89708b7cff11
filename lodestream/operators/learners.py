"""Test-then-train learning as window aggregates: each row is predicted from the rows before it, then learned.

The state of Gaussian naive Bayes is counts, sums and sums of squares by class, so a running window holds it, and
all of them share one sort of a run. `restart` cuts a run into sessions, each learned afresh; a changed selection of features
makes a new version of the model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def naive_bayes(stream: DataFrame, features: Sequence[str], classes: int, restart: Column | None = None, eps: float = 1e-3, selected: Column | None = None, remap: bool = False) -> DataFrame:
    """p, the class of greatest posterior; ties and first rows take the lowest class.

    stream: run, seq, y (class index) and the features, not NULL. Classes get a count of one in advance; a
    class's variance has eps added, and a class not seen yet has mean 0 and variance 1.

    selected: the features (an array) that a row's model has; NULL is all of them. Where it differs from the row before, a new version of
    the model begins at this row: it learns afresh or, with `remap`, features that stay keep what they have learned and features that come
    begin. A feature learns while it is selected.
    """
    by = Window.partitionBy("run").orderBy("seq")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    df, held = stream, {f: F.lit(True) for f in features}
    begins = None if restart is None else restart.cast("int")
    if selected is not None:
        df = df.withColumn("_selected", F.sort_array(F.coalesce(selected, F.array(*map(F.lit, features)))))
        held = {f: F.array_contains("_selected", f) for f in features}
        if not remap:
            changed = F.coalesce(F.col("_selected") != F.lag("_selected").over(by), F.lit(False)).cast("int")
            begins = changed if begins is None else F.greatest(begins, changed)
    df = df.withColumn("_session", F.lit(0) if begins is None else F.sum(begins).over(upto))
    versions: dict[str, list[str]] = {f: [] for f in features}
    if remap and selected is not None:
        df = df.withColumns({f"_comes_{f}": (held[f] & ~F.coalesce(F.array_contains(F.lag("_selected").over(by), f), F.lit(False))).cast("int") for f in features})
        df = df.withColumns({f"_version_{f}": F.sum(f"_comes_{f}").over(upto) for f in features})
        versions = {f: [f"_version_{f}"] for f in features}
    before = lambda *more: Window.partitionBy("run", "_session", *more).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    state = {}
    for c in range(classes):
        own = F.col("y") == c
        state[f"_n{c}"] = F.count_if(own).over(before())
        for f in features:
            x = F.when(own & held[f], F.col(f).cast("double"))
            state[f"_s{c}_{f}"], state[f"_q{c}_{f}"] = F.sum(x).over(before(*versions[f])), F.sum(x * x).over(before(*versions[f]))
            if selected is not None:
                state[f"_n{c}_{f}"] = F.count(x).over(before(*versions[f]))
    df = df.withColumns(state)
    scores = {}
    for c in range(classes):
        score = F.ln(F.coalesce(f"_n{c}", F.lit(0)) + 1.0)
        for f in features:
            n = F.coalesce(f"_n{c}" if selected is None else f"_n{c}_{f}", F.lit(0))
            mean = F.when(n > 0, F.col(f"_s{c}_{f}") / n).otherwise(0.0)
            variance = F.when(n > 0, F.greatest(F.col(f"_q{c}_{f}") / n - mean * mean, F.lit(0.0)) + eps).otherwise(1.0)
            term = -0.5 * F.ln(variance) - (F.col(f) - mean) * (F.col(f) - mean) / (2 * variance)
            score = score + (term if selected is None else F.when(held[f], term).otherwise(0.0))
        scores[f"_l{c}"] = F.round(score, 9)
    df = df.withColumns(scores)
    best = F.greatest(*[F.col(f"_l{c}") for c in range(classes)])
    p = F.coalesce(*[F.when(F.col(f"_l{c}") == best, c) for c in range(classes)])
    return df.withColumn("p", p).select(*stream.columns, "p")


def swaps(scored: DataFrame, selected: Column, score: str, most: int | None = None) -> DataFrame:
    """out, in, gain: the worst selected features paired with the best others, as long as the other is better.

    scored: a row per feature. At most `most` pairs; ties go by name.
    """
    worst = scored.where(selected).select(F.col("feature").alias("out"), F.col(score).alias("a"), F.row_number().over(Window.orderBy(score, "feature")).alias("i"))
    best = scored.where(~selected).select(F.col("feature").alias("in"), F.col(score).alias("b"), F.row_number().over(Window.orderBy(F.desc(score), "feature")).alias("i"))
    pairs = worst.join(best, "i").withColumn("gain", F.col("b") - F.col("a"))
    good = F.min(F.when(F.col("gain") > 0, 1).otherwise(0)).over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    pairs = pairs.withColumn("_good", good).where("_good = 1")
    return (pairs if most is None else pairs.where(F.col("i") <= most)).select("out", "in", "gain")
