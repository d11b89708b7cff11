"""A discretiser of streams in two layers: histograms that are carried on, and second-layer bins merged anew after every update.

A run's rows come in updates of equal length. Of each feature, the first updates are its warm-up: they give the range of its first-layer bins.
From then on the counts of each update are added to those before it, and the second layer is merged from all that has been
gathered. An alarm of a feature resets that feature alone: with the update after, it warms up again and gathers afresh.

Counts are mergeable, so an update's are made by one aggregation of all runs, and what is gathered is their running sum: a row for
each cell of a histogram and update, whatever the number of rows. Merging sees the cells of some histograms at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from . import ranking

KEY = ["run", "update", "feature"]


def sessions(long: DataFrame, resets: DataFrame | None = None) -> DataFrame:
    """run, update, feature, session (from 0) and age: the number of updates since the session began, this one left out.

    long: run, update, feature; resets: run, update, feature, those after whose update a feature begins afresh.
    """
    seen = stored(long.select(*KEY).distinct(), "seen")
    grid = seen.select("run", "feature").distinct().join(seen.select("run", "update").distinct(), "run").select(*KEY)
    if resets is None:
        grid = grid.withColumn("_reset", F.lit(0))
    else:
        grid = grid.join(resets.select(*KEY, F.lit(1).alias("_reset")).distinct(), KEY, "left")
    before = Window.partitionBy("run", "feature").orderBy("update").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("session", F.coalesce(F.sum("_reset").over(before), F.lit(0)).cast("long"))
    began = F.min("update").over(Window.partitionBy("run", "feature", "session"))
    return grid.select(*KEY, "session", (F.col("update") - began).alias("age"))


def gathered(long: DataFrame, bins: int = 100, warm_up: int = 1, resets: DataFrame | None = None, margin: float = 0.05, tasks: int | None = None) -> DataFrame:
    """run, update, feature, session, low, high, bin, cls, n: the first-layer counts gathered up to the end of each update.

    long: run, update, feature, value, cls. The updates of a warm-up before its last give no rows: the feature is not ready. tasks: what
    long is dealt into by run, if it is; what it meets is then dealt likewise, and its rows stay where they are.
    """
    place = Window.partitionBy("run", "feature")
    own = sessions(long, resets).withColumn("_at", F.row_number().over(place.orderBy("update")))
    own = stored(own.withColumn("_last", F.max("_at").over(Window.partitionBy("run", "feature", "session"))), "sessions")
    own = own if tasks is None else own.repartition(tasks, "run")
    of = Window.partitionBy("run", "feature", "session")
    early = F.when(F.col("age") < warm_up, F.col("value"))
    rows = long.join(own, KEY).withColumns({"_any": F.max((F.col("age") < warm_up).cast("int")).over(of), "_a": F.min(early).over(of), "_b": F.max(early).over(of)}).where("_any = 1")
    low, high = ranking.widened(F.col("_a"), F.col("_b"), margin)
    rows = rows.withColumns({"low": low, "high": high})
    binned = rows.select("run", "feature", "session", "low", "high", "_at", "_last", ranking.layer1_bin(F.col("value"), F.col("low"), F.col("high"), bins).alias("bin"), "cls")
    counts = binned.groupBy(*binned.columns).agg(F.count(F.lit(1)).alias("n"))
    cell = Window.partitionBy("run", "feature", "session", "bin", "cls").orderBy("_at")
    # a sum stands until the update before the cell's next one
    upto = {"n": F.sum("n").over(cell.rowsBetween(Window.unboundedPreceding, 0)), "_until": F.coalesce(F.lead("_at").over(cell) - 1, "_last")}
    standing = counts.withColumns(upto).withColumn("_at", F.explode(F.sequence("_at", "_until")))
    ready = own.where(F.col("age") >= warm_up - 1).select("run", "feature", "_at", "update")
    return standing.join(ready, ["run", "feature", "_at"]).select(*KEY, "session", "low", "high", "bin", "cls", "n")


def merged(counts: DataFrame, bins: int, groups: int, classes: int | None = None) -> DataFrame:
    """run, update, feature, bin (of the second layer), upto, cls, n; upto is the upper edge of the bin, that of the last has no meaning beyond.

    counts: what `gathered` gives.
    """
    cells = counts.groupBy(*KEY, "low", "high").agg(F.collect_list(F.struct("bin", "cls", "n")).alias("cells"))
    parts = ranking.second_layer(cells, bins, groups, classes).select(*KEY, "low", "high", F.explode("parts").alias("_part"))
    edge = F.col("low") + (F.col("_part.last") + 1) * ((F.col("high") - F.col("low")) / bins)
    return parts.select(*KEY, "_part.bin", edge.alias("upto"), "_part.cls", "_part.n")


def placed(long: DataFrame, second: DataFrame) -> DataFrame:
    """long with `bin`, the second-layer bin by the cut points that stood before the row's update; NULL where the feature was not ready.

    second: what `merged` gives.
    """
    edges = second.groupBy(*KEY).agg(F.array_sort(F.collect_set("upto")).alias("_edges")).withColumn("update", F.col("update") + 1)
    inner = F.slice("_edges", 1, F.size("_edges") - 1)
    bin_ = F.when(F.col("_edges").isNotNull(), F.when(F.col("value").isNull(), 0).otherwise(F.size(F.filter(inner, lambda e: e <= F.col("value")))))
    return long.join(edges, KEY, "left").withColumn("bin", bin_).drop("_edges")
