"""Discretisation in two layers and filter scores of features, all from one contingency table.

Instances come in long form: feature, value, cls (a class). The table of counts has a row per feature, bin and
class, whatever the number of instances, and is made by one partial aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: So many histograms are merged at once.
HISTOGRAMS = 1_000


def long_form(df: DataFrame, features: list[str], cls: str, *keep: str) -> DataFrame:
    return unpivoted(df, features, F.col(cls).alias("cls"), *keep)


def unpivoted(df: DataFrame, features: Sequence[str], *keep: str | Column) -> DataFrame:
    """keep, feature, value (double): a row for each feature; rows stay in their partitions, of which Spark's unpivot forgets the key."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*keep, F.explode(cells).alias("_cell")).select("*", "_cell.feature", "_cell.value").drop("_cell")


def ranges(warm_up: DataFrame, *by: str, margin: float = 0.05) -> DataFrame:
    """by, feature, low, high: least and greatest value of the warm-up rows, widened by a margin of the span at each end."""
    found = warm_up.groupBy(*by, "feature").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    low, high = widened(F.col("a"), F.col("b"), margin)
    return found.select(*by, "feature", low.alias("low"), high.alias("high"))


def widened(a: Column, b: Column, margin: float) -> tuple[Column, Column]:
    """The ends a and b, apart by a margin of the span more at each end; a unit where they are equal."""
    span = b - a
    constant = span == 0
    return F.when(constant, a).otherwise(a - margin * span), F.when(constant, a + 1).otherwise(b + margin * span)


def layer1_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin from 0, clipped at both ends; NULL falls in bin 0."""
    at = F.floor((value - low) / ((high - low) / bins)).cast("int")
    return F.coalesce(F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)), F.lit(0))


def histogram(instances: DataFrame, found: DataFrame, bins: int = 100, *by: str) -> DataFrame:
    """feature, bin, cls, n (and the columns `by`). found: feature, low, high, and columns of `by` where each has ranges of its own."""
    on = [c for c in found.columns if c not in ("low", "high")]
    placed = instances.join(F.broadcast(found) if on == ["feature"] else found, on)  # broadcast: a row per feature
    binned = placed.select(*by, "feature", layer1_bin(F.col("value"), F.col("low"), F.col("high"), bins).alias("bin"), "cls")
    return binned.groupBy(*by, "feature", "bin", "cls").agg(F.count(F.lit(1)).alias("n"))


def own_histogram(rows: DataFrame, features: Sequence[str], cls: str, first: Column, bins: int, *by: str, margin: float = 0.05) -> DataFrame:
    """run, by, feature, bin, cls, n: rows (run, cls, by and the features) binned over the span of those rows of their own run that are `first`.

    As `histogram` and `ranges` by run give it, in one pass: the spans are a window over the run, and rows become cells only when they
    have their bins. Runs without a first row give nothing.
    """
    own = Window.partitionBy("run")
    df = rows.select("run", F.col(cls).alias("cls"), *by, first.alias("_first"), *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)])
    ends = {"_any": F.max(F.col("_first").cast("int")).over(own)}
    for i in range(len(features)):
        x = F.when(F.col("_first"), F.col(f"_x{i}"))
        ends |= {f"_a{i}": F.min(x).over(own), f"_b{i}": F.max(x).over(own)}
    df = df.withColumns(ends).where("_any = 1")

    def bin_of(i: int) -> Column:
        return layer1_bin(F.col(f"_x{i}"), *widened(F.col(f"_a{i}"), F.col(f"_b{i}"), margin), bins)

    cells = F.array(*[F.struct(F.lit(f).alias("feature"), bin_of(i).alias("bin")) for i, f in enumerate(features)])
    each = df.select("run", *by, "cls", F.explode(cells).alias("_cell")).select("run", *by, "_cell.feature", "_cell.bin", "cls")
    return each.groupBy("run", *by, "feature", "bin", "cls").agg(F.count(F.lit(1)).alias("n"))


def _merging(table: np.ndarray, width: np.ndarray, groups: int) -> np.ndarray:
    """histograms x bins: the second-layer bin of each bin. table: histograms x bins x classes; width: the classes of each histogram."""
    one = np.arange(len(table))
    to = np.tile(np.arange(table.shape[1], dtype=np.int32), (len(table), 1))
    real = (np.arange(table.shape[2]) < width[:, None])[:, None]
    while table.shape[1] > groups:
        total = table.sum(axis=2)
        shares = np.where(real, (table + 1) / (total + width[:, None])[..., None], 0.0)
        gap = np.abs(shares[:, :-1] - shares[:, 1:]).sum(axis=2)
        at = np.round(0.5 * gap * (np.minimum(total[:, :-1], total[:, 1:]) + 1), 9).argmin(axis=1)
        table[one, at] += table[one, at + 1]
        stays = np.ones(table.shape[:2], bool)
        stays[one, at + 1] = False
        table = table[stays].reshape(len(table), -1, table.shape[2])
        to -= to > at[:, None]
    return to


def _second_layer(cells: pa.ListArray, bins: int, groups: int, classes: int) -> tuple[pa.Array, pa.Array]:
    """`to` and `parts` of some histograms, as `second_layer` gives them."""
    flat, n = cells.flatten(), len(cells)
    own = np.repeat(np.arange(n), cells.value_lengths().to_numpy())
    bin_, weight, named = flat.field("bin").to_numpy(), flat.field("n").to_numpy(), flat.field("cls").dictionary_encode()
    order = pc.array_sort_indices(named.dictionary).to_numpy().astype(np.int64)
    known = len(order)
    rank = np.append(np.argsort(order), known)  # of NULL: a class of its own, the last
    code = rank[named.indices.fill_null(known).to_numpy()]
    pairs, at = np.unique(own * (known + 1) + code, return_inverse=True)
    first = np.searchsorted(pairs // (known + 1), np.arange(n + 1))
    width = np.maximum(np.diff(first), classes)
    table = np.zeros((n, bins, width.max()))
    np.add.at(table, (own, bin_, at - first[own]), weight)
    to = _merging(table, width, groups)
    merged, at = np.unique((own * bins + to[own, bin_]) * (known + 1) + code, return_inverse=True)
    sums = np.zeros(len(merged), np.int64)
    np.add.at(sums, at, weight)
    of, code = np.divmod(merged, known + 1)
    of, part = np.divmod(of, bins)
    last = (to[of] <= part[:, None]).sum(axis=1) - 1
    values = named.dictionary.take(pa.array(np.append(order, 0)[code], mask=code == known))
    fields = [pa.array(part, pa.int32()), pa.array(last, pa.int32()), values, pa.array(sums)]
    parts = pa.StructArray.from_arrays(fields, names=["bin", "last", "cls", "n"])
    ends = lambda counts: pa.array(np.append(0, np.cumsum(counts)), pa.int32())
    return pa.ListArray.from_arrays(ends(np.full(n, bins)), pa.array(to.ravel(), pa.int32())), pa.ListArray.from_arrays(ends(np.bincount(of, minlength=n)), parts)


def second_layer(histograms: DataFrame, bins: int, groups: int, classes: int | None = None) -> DataFrame:
    """histograms with `to`, the second-layer bin of each bin, and `parts` (bin, last, cls, n) for `cells` (bin, cls, n).

    Merges as `merged_bins` does. `last` is the last first-layer bin of a second-layer bin. A row is a histogram, of at most bins x classes cells;
    the rows of a batch are merged step by step together.
    """
    kinds = {f.name: f.dataType.simpleString() for f in histograms.schema if f.name != "cells"}
    cls = histograms.schema["cells"].dataType.elementType["cls"].dataType.simpleString()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, HISTOGRAMS):
                piece = batch.slice(at, HISTOGRAMS)
                found = _second_layer(piece.column("cells"), bins, groups, classes or 0)
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kinds), *found], names=[*kinds, "to", "parts"])

    return histograms.mapInArrow(merge, ", ".join(f"{c} {k}" for c, k in kinds.items()) + f", to array<int>, parts array<struct<bin: int, last: int, cls: {cls}, n: bigint>>")


def merged_bins(counts: DataFrame, bins: int, groups: int, *by: str, classes: int | None = None) -> DataFrame:
    """by, feature, bin, to: neighbouring bins merged, the pair of least weighted class distance first, until `groups` are left.

    classes: how many there are, if a feature's counts need not show all. The distance is half the sum of differences of the Laplace-smoothed class shares, times the smaller
    count plus one; of distances equal to nine digits the leftmost goes. Each feature is at most bins x classes rows.
    """
    cells = counts.groupBy(*by, "feature").agg(F.collect_list(F.struct("bin", "cls", "n")).alias("cells"))
    return second_layer(cells, bins, groups, classes).select(*by, "feature", F.posexplode("to").alias("bin", "to"))


def uniform_groups(bin_: Column, bins: int, groups: int) -> Column:
    return F.least(F.floor(bin_ * groups / bins).cast("int"), F.lit(groups - 1))


def regrouped(counts: DataFrame, to: DataFrame) -> DataFrame:
    """Counts by the second layer's bins."""
    return counts.join(F.broadcast(to), ["feature", "bin"]).groupBy("feature", F.col("to").alias("bin"), "cls").agg(F.sum("n").alias("n"))


def scores(counts: DataFrame, *by: str) -> DataFrame:
    """feature, info_gain (bits), mutual_info (nats), chi2 from counts; none is below zero.

    With o the cell, e = row * column / total: mutual information is the mean of ln(o / e), and the sum of
    (o - e)^2 / e over all cells, empty ones too, is that of o^2 / e less the total.
    """
    feature = Window.partitionBy(*by, "feature")
    row, col, total = (F.sum("n").over(w) for w in (Window.partitionBy(*by, "feature", "bin"), Window.partitionBy(*by, "feature", "cls"), feature))
    cells = counts.select(*by, "feature", F.col("n").cast("double").alias("o"), (row.cast("double") * col / total).alias("e"), total.alias("total"))
    mi = F.sum(F.col("o") * F.ln(F.col("o") / F.col("e"))) / F.max("total")
    out = cells.groupBy(*by, "feature").agg(mi.alias("mi"), (F.sum(F.col("o") * F.col("o") / F.col("e")) - F.max("total")).alias("x2"))
    zero = F.lit(0.0)
    return out.select(*by, "feature", F.greatest(F.col("mi") / F.ln(F.lit(2.0)), zero).alias("info_gain"), F.greatest("mi", zero).alias("mutual_info"), F.greatest("x2", zero).alias("chi2"))


def top(scored: DataFrame, score: str, k: int, *by: str) -> DataFrame:
    """The k best features, best first; of scores equal to nine digits the first by name."""
    order = Window.partitionBy(*by).orderBy(F.desc(F.round(score, 9)), "feature")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def default_k(n_features: int) -> int:
    return max(1, -int(-(n_features**0.5) // 1))


def selections(chosen: DataFrame, period: str) -> DataFrame:
    """period, selected (sorted), and stability: the share of the period before's features that stay."""
    sets = chosen.groupBy(period).agg(F.sort_array(F.collect_set("feature")).alias("selected"))
    before = F.lag("selected").over(Window.orderBy(period))  # a row per period
    return sets.withColumn("_before", before).select(period, "selected", F.when(F.size("_before") > 0, F.size(F.array_intersect("_before", "selected")) / F.size("_before")).alias("stability"))


def importance(scored: DataFrame, distance: DataFrame, w_score: float = 0.7, w_stable: float = 0.3, eps: float = 1e-6) -> DataFrame:
    """Blend of relevance and stability, summing to 1; a row per feature. distance: feature, ks."""
    everything = Window.partitionBy()
    df = scored.join(distance, "feature").withColumn("_stable", 1 / (F.col("ks") + eps))
    raw = w_score * F.try_divide(F.col("mutual_info"), F.max("mutual_info").over(everything)) + w_stable * F.col("_stable") / F.max("_stable").over(everything)
    df = df.withColumn("_raw", F.greatest(F.coalesce(raw, F.lit(0.0)), F.lit(0.0)))
    total, n = F.sum("_raw").over(everything), F.count(F.lit(1)).over(everything)
    return df.select("feature", F.when(total > 0, F.col("_raw") / total).otherwise(1 / n).alias("importance"))


def weighted_sample(df: DataFrame, weight: str, u: Column, k: int, *ties: str) -> DataFrame:
    """k rows drawn without replacement with chances that follow weight; u: uniform in (0, 1). Weights not above 0 never enter."""
    return df.where(F.col(weight) > 0).withColumn("_key", F.ln(u) / F.col(weight)).orderBy(F.desc("_key"), *ties).limit(k).drop("_key")


def updated_importance(before: DataFrame, scored: DataFrame | None = None, distance: DataFrame | None = None, **weights: float) -> DataFrame:
    """Importance after a partial update: features without a new score or distance keep the one of `before`.

    before: feature, mutual_info, ks; scored: feature, mutual_info; distance: feature, ks; a row per feature.
    """
    df = before.select("feature", F.col("mutual_info").alias("_m"), F.col("ks").alias("_k"))
    for new, column in ((scored, "mutual_info"), (distance, "ks")):
        df = df.join(new.select("feature", column), "feature", "left") if new is not None else df.withColumn(column, F.lit(None).cast("double"))
    df = df.select("feature", F.coalesce("mutual_info", "_m").alias("mutual_info"), F.coalesce("ks", "_k").alias("ks"))
    return importance(df.select("feature", "mutual_info"), df.select("feature", "ks"), **weights)


def projected(instances: DataFrame, importances: DataFrame, k: int) -> DataFrame:
    """Long-form instances of the k most important features alone."""
    best = top(importances, "importance", k).select("feature")
    return instances.join(F.broadcast(best), "feature", "left_semi")  # a row per feature
