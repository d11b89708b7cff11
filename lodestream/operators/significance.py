"""Comparison of methods over datasets: rows of dataset, method, score. Results are a few rows each."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import drift

# Studentised range statistics over sqrt(2) for 2, 3, ... 10 methods.
NEMENYI = {
    0.05: (1.960, 2.343, 2.569, 2.728, 2.850, 2.949, 3.031, 3.102, 3.164),
    0.10: (1.645, 2.052, 2.291, 2.459, 2.589, 2.693, 2.780, 2.855, 2.920),
}


def ranked(scores: DataFrame, higher_is_better: bool = True) -> DataFrame:
    """rank: 1 for the best method of a dataset; equal scores share their mean rank."""
    order = F.desc("score") if higher_is_better else F.asc("score")
    ties = F.count(F.lit(1)).over(Window.partitionBy("dataset", "score"))
    return scores.withColumn("rank", F.rank().over(Window.partitionBy("dataset").orderBy(order)) + (ties - 1) / 2)


def mean_ranks(ranks: DataFrame) -> DataFrame:
    return ranks.groupBy("method").agg(F.avg("rank").alias("mean_rank"), F.count(F.lit(1)).alias("n"))


def friedman(ranks: DataFrame) -> DataFrame:
    """n, k, chi2 and the F statistic (NULL where it is not defined)."""
    r = mean_ranks(ranks)
    n, k, squares = F.max("n"), F.count(F.lit(1)), F.sum(F.col("mean_rank") * F.col("mean_rank"))
    df = r.agg(n.cast("double").alias("n"), k.cast("double").alias("k"), squares.alias("s"))
    df = df.withColumn("chi2", 12 * F.col("n") / (F.col("k") * (F.col("k") + 1)) * F.col("s") - 3 * F.col("n") * (F.col("k") + 1))
    rest = F.col("n") * (F.col("k") - 1) - F.col("chi2")
    return df.select("n", "k", "chi2", F.when((F.col("n") > 1) & (rest > 1e-12), (F.col("n") - 1) * F.col("chi2") / rest).alias("f_stat"))


def nemenyi(ranks: DataFrame, alpha: float = 0.05) -> DataFrame:
    """a, b, difference of mean ranks, critical difference and significant, for each pair of methods."""
    r = mean_ranks(ranks).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy()))
    q = F.element_at(F.array(*[F.lit(x) for x in NEMENYI[alpha]]), (F.col("k") - 1).cast("int"))
    r = r.withColumn("cd", q * F.sqrt(F.col("k") * (F.col("k") + 1) / (6 * F.col("n"))))
    a, b = r.select(F.col("method").alias("a"), F.col("mean_rank").alias("ra"), "cd"), r.select(F.col("method").alias("b"), F.col("mean_rank").alias("rb"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.abs(F.col("ra") - F.col("rb")).alias("difference"), "cd", (F.abs(F.col("ra") - F.col("rb")) > F.col("cd")).alias("significant"))


def wilcoxon(scores: DataFrame, a: str, b: str) -> DataFrame:
    """n, wins, losses, ties of a over b, both rank sums of the absolute differences (zeros ranked too), and the normal z."""
    pairs = scores.where(F.col("method").isin(a, b)).groupBy("dataset").agg(F.max(F.when(F.col("method") == a, F.col("score"))).alias("x"), F.max(F.when(F.col("method") == b, F.col("score"))).alias("y"))
    pairs = pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull()).withColumn("d", F.col("x") - F.col("y")).withColumn("m", F.abs("d"))
    # equal differences are counted first and ranked by ranges: datasets may be many
    points = pairs.groupBy("m").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("d") > 0).alias("above"), F.count_if(F.col("d") < 0).alias("below"))
    rank = F.col("upto_c") - (F.col("c") - 1) / 2
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sums = drift.ranged_sums(points, [], ["m"], ["c"]).agg(
        count("c").alias("n"),
        count("above").alias("wins"),
        count("below").alias("losses"),
        count(F.col("c") - F.col("above") - F.col("below")).alias("ties"),
        F.coalesce(F.sum(F.col("above") * rank), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum(F.col("below") * rank), F.lit(0.0)).alias("w_minus"),
    )
    n = F.col("n").cast("double")
    return sums.withColumn("z", (F.greatest("w_plus", "w_minus") - n * (n + 1) / 4 - 0.5) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24))


def chi2_tail(x: float, df: int) -> float:
    """P(X >= x) of chi-squared with a whole number of degrees of freedom, by its finite sum."""
    if x <= 0:
        return 1.0
    half, a = x / 2, 1.0 if df % 2 == 0 else 0.5
    tail = math.exp(-half) if df % 2 == 0 else math.erfc(math.sqrt(half))
    while a < df / 2:
        tail += math.exp(a * math.log(half) - half - math.lgamma(a + 1))
        a += 1
    return min(tail, 1.0)


def beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction from the last term backwards."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    terms = 200 + int(4 * math.sqrt(max(a, b)))
    below = 1.0
    for j in range(terms, 0, -1):
        m = j // 2
        if j % 2:
            d = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        below = 1 + d / below
    front = a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    return math.exp(front) / (a * below)


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(X >= f) of the F distribution."""
    return 1.0 if f <= 0 else beta_share(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def signed_rank_tail(n: int, greater: float) -> float:
    """Two-sided chance that the greater rank sum of n untied pairs is at least `greater`: exact to 30 pairs, else normal."""
    if n == 0:
        return 1.0
    if n > 30:
        z = (greater - n * (n + 1) / 4 - 0.5) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
        return min(math.erfc(z / math.sqrt(2)), 1.0)
    ways = [1]  # subsets of the ranks by their sum
    for rank in range(1, n + 1):
        ways = [(ways[s] if s < len(ways) else 0) + (ways[s - rank] if s >= rank else 0) for s in range(len(ways) + rank)]
    return min(2 * sum(w for s, w in enumerate(ways) if s >= greater) / 2**n, 1.0)


def friedman_p(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """`friedman` rows with p_chi2, p_f (NULL without an F statistic), p (p_f first) and reject."""

    @F.pandas_udf("double")
    def chi2(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([chi2_tail(a, int(b) - 1) for a, b in zip(x, k)])

    @F.pandas_udf("double")
    def ratio(x: pd.Series, n: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else f_tail(a, c - 1, (b - 1) * (c - 1)) for a, b, c in zip(x, n, k)], dtype="float64")

    df = tests.withColumns({"p_chi2": chi2("chi2", "k"), "p_f": ratio("f_stat", "n", "k")}).withColumn("p_f", F.when(F.col("f_stat").isNotNull(), F.col("p_f")))
    return df.withColumn("p", F.coalesce("p_f", "p_chi2")).withColumn("reject", F.col("p") < alpha)


def wilcoxon_p(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """`wilcoxon` rows with the two-sided p and reject."""

    @F.pandas_udf("double")
    def tail(n: pd.Series, greater: pd.Series) -> pd.Series:
        return pd.Series([signed_rank_tail(int(a), b) for a, b in zip(n, greater)], dtype="float64")

    return tests.withColumn("p", tail("n", F.greatest("w_plus", "w_minus"))).withColumn("reject", F.col("p") < alpha)


def rejected(pairs: DataFrame) -> DataFrame:
    """n_pairs and n_rejected: of `nemenyi` rows, how many differ significantly."""
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if("significant").alias("n_rejected"))


def report(ranks: DataFrame, alpha: float = 0.05) -> DataFrame:
    """line: the mean rank of each method, the test of all of them with its verdict, and each two methods against the critical difference."""
    means = mean_ranks(ranks).select(F.format_string("%s: mean rank %.3f over %d datasets", "method", "mean_rank", "n").alias("line"))
    verdict = F.when(F.col("reject"), "methods differ").otherwise("no difference shown")
    whole = friedman_p(friedman(ranks), alpha).select(F.concat(F.format_string("Friedman: chi2 %.3f, F %.3f, p %.4f: ", "chi2", "f_stat", "p"), verdict).alias("line"))
    pairs = nemenyi(ranks, alpha).select(F.concat(F.format_string("%s and %s: mean ranks differ by %.3f, critical difference %.3f: ", "a", "b", "difference", "cd"), F.when(F.col("significant"), "significant").otherwise("not significant")).alias("line"))
    return means.unionByName(whole).unionByName(pairs)
