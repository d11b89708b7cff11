"""Measured runs: what a live run costs and how well it does, a row for each micro-batch.

Counts by class are observed while the rows pass (`DataFrame.observe`), so nothing is read twice and no row is gathered; a listener takes them
with the batch's time and the memory that its state holds. What reaches the driver is a few numbers a batch. Accuracy and the
kappas follow from sums of the counts, time and memory from the batch's progress, drifts from Hoeffding's bound at the batches' ends.
"""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..session import shared_folder

COLUMNS = "run string, batch long, instance_num long, kappa double, kappa_per double, accuracy double, ram_hours double, feature_stability_ratio double, drift_count long, recovery_time long, seconds double, mb double, micros_per_instance double"


class Samples(StreamingQueryListener):
    """Per query id: number of batch, end of batch, seconds it took, MB of state, and what was observed."""

    def __init__(self, observed: str) -> None:
        self.observed, self.rows = observed, {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        found = p.observedMetrics.get(self.observed)
        if p.numInputRows and found is not None:
            at = datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")).timestamp()
            took = p.durationMs.get("triggerExecution", 0) / 1000
            mb = sum(s.memoryUsedBytes for s in p.stateOperators) / 2**20
            self.rows.setdefault(str(p.id), {})[p.batchId] = (at + took, took, mb, found.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def counted(predicted: DataFrame, classes: int, name: str) -> DataFrame:
    """predicted (y, p and, optionally, before: the label before) with its counts observed under a name. Labels out of range count for nothing."""
    inside = F.col("y").between(0, classes - 1) & F.col("p").between(0, classes - 1)
    counts = {"n": inside, "hits": inside & (F.col("y") == F.col("p"))}
    for c in range(classes):
        counts |= {f"y{c}": inside & (F.col("y") == c), f"p{c}": inside & (F.col("p") == c)}
    if "before" in predicted.columns:
        counts |= {"stay": inside & (F.col("y") == F.col("before"))}
    return predicted.observe(name, *[F.count_if(c).alias(k) for k, c in counts.items()])


def _kappa(agree: float, chance: float) -> float:
    return 0.0 if abs(1 - chance) < 1e-12 else (agree - chance) / (1 - chance)


def table(batches: dict[int, tuple], run: str, classes: int, alpha: float = 0.001, tolerance: float = 0.01, stability: float = 1.0) -> list[tuple]:
    """The rows of a run's result table from its batches (see Samples). stability: of its selection of features, 1 without one.

    A drift is counted where the error since the last drift exceeds that of its best prefix by Hoeffding's bound; its recovery time is the
    instances until a batch's accuracy is back within the tolerance of that prefix's.
    """
    out, total, gb_hours, before, drifts = [], {}, 0.0, None, 0
    n = s = n_min = s_min = 0
    waiting, recovered = None, None
    bound = lambda k: math.sqrt(math.log(1 / alpha) / (2 * k))
    spent = 0.0
    for batch in sorted(batches):
        end, took, mb, own = batches[batch]
        total = {k: total.get(k, 0) + v for k, v in own.items()}
        spent += took
        gb_hours += mb / 1024 * (0.0 if before is None else (end - before) / 3600)
        before = end
        if not total["n"]:
            continue
        if waiting and own["n"] and own["hits"] / own["n"] >= waiting[1] - tolerance:
            recovered, waiting = total["n"] - waiting[0], None
        n, s = n + own["n"], s + own["n"] - own["hits"]
        if n and (not n_min or s / n + bound(n) <= s_min / n_min + bound(n_min)):
            n_min, s_min = n, s
        elif n > n_min and s / n - s_min / n_min >= math.sqrt((n - n_min) / (n * n_min) / 2 * math.log(2 / alpha)):
            drifts, waiting = drifts + 1, (total["n"], 1 - s_min / n_min)
            n = s = n_min = s_min = 0
        accuracy = total["hits"] / total["n"]
        chance = sum(total[f"y{c}"] * total[f"p{c}"] for c in range(classes)) / total["n"] ** 2
        temporal = None if "stay" not in total else _kappa(accuracy, total["stay"] / (total["n"] - 1) if total["n"] > 1 else 0.0)
        out.append((run, batch, total["n"], _kappa(accuracy, chance), temporal, accuracy, gb_hours, stability, drifts, recovered, spent, mb, 1e6 * spent / total["n"]))
    return out


def run(predicted: DataFrame, name: str, classes: int, folder: str | None = None, **options: float) -> DataFrame:
    """Write the rows of a stream to folder/rows and give its result table, which is written to folder/results as well.

    With the folder of an earlier call the query goes on from where that one ended; the table is that of this call's batches.
    """
    spark: SparkSession = predicted.sparkSession
    folder = folder or shared_folder(spark)
    samples = Samples(name)
    spark.streams.addListener(samples)
    try:
        writer = counted(predicted, classes, name).writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        query = writer.format("parquet").start(f"{folder}/rows")
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()  # the last batch's progress comes after its end
    finally:
        spark.streams.removeListener(samples)
    rows = table(samples.rows.get(str(query.id), {}), name, classes, **options)
    out = spark.createDataFrame(rows, COLUMNS)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{folder}/results")
    return spark.read.schema(COLUMNS).parquet(f"{folder}/results")
