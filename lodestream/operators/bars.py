"""Price bars and technical indicators, all over windows of one symbol ordered by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import clean

#: Rows per block of the exponential means; (1 - alpha) ** BLOCK is below double precision for spans up to 27.
BLOCK = 512


def daily(events: DataFrame, key: str) -> DataFrame:
    """symbol, day, open, high, low, close, volume of the events of each key and day; one partial aggregation."""
    day = F.to_date("ts").alias("day")
    return events.groupBy(F.col(key).alias("symbol"), day).agg(
        F.min_by("value", "ts").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "ts").alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("day")


def last_n(c: Column, n: int, f) -> Column:
    """f over the last n rows, the current one included; NULL until n of them are not NULL."""
    frame = by_symbol().rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(frame) >= n, f(c).over(frame))


def moving(bars: DataFrame) -> DataFrame:
    """Moving averages, Bollinger width, and the stochastic oscillator."""
    close = F.col("close")
    df = bars.withColumns({"sma_5": last_n(close, 5, F.avg), "sma_20": last_n(close, 20, F.avg), "_std": last_n(close, 20, F.stddev_samp), "_low": last_n(F.col("low"), 14, F.min), "_high": last_n(F.col("high"), 14, F.max)})
    df = df.withColumn("bollinger_width", 4 * F.col("_std") / F.col("sma_20"))
    df = df.withColumn("stoch_k", 100 * (close - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)))
    return df.withColumn("stoch_d", last_n(F.col("stoch_k"), 3, F.avg)).drop("_std", "_low", "_high")


def returns(bars: DataFrame, lags: int = 5) -> DataFrame:
    """Momentum, change, logarithmic return, volatility, the volume's z-score, and lags of the change and the z-score."""
    w, close, volume = by_symbol(), F.col("close"), F.col("volume")
    df = bars.withColumns({"momentum_10": close - F.lag(close, 10).over(w), "change": close / F.lag(close).over(w) - 1, "log_return": F.ln(close / F.lag(close).over(w))})
    df = df.withColumns({"volume_z": (volume - last_n(volume, 20, F.avg)) / (last_n(volume, 20, F.stddev_samp) + 1e-9), "volatility_20": last_n(F.col("change"), 20, F.stddev_samp)})
    return df.withColumns({f"{c}_lag_{k}": F.lag(c, k).over(w) for c in ("change", "volume_z") for k in range(1, lags + 1)})


def on_balance_volume(bars: DataFrame) -> DataFrame:
    """Running volume, taken negative on days that close below the day before."""
    w = by_symbol()
    signed = F.when(F.col("close") < F.lag("close").over(w), -F.col("volume")).otherwise(F.col("volume"))
    return bars.withColumn("_signed", signed).withColumn("obv", F.sum("_signed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_signed")


def exponential_mean(df: DataFrame, value: str, alpha: float, out: str, min_rows: int = 1) -> DataFrame:
    """e(0) = x(0), e(t) = alpha x(t) + (1 - alpha) e(t - 1), in each symbol; NULL for the first min_rows - 1 rows.

    Within a block of rows it is a running sum of x / (1 - alpha) ** offset; what a block inherits is the
    last value of the block before it, itself a sum over two blocks. A symbol of any length never overflows.
    """
    keep, r = 1 - alpha, F.lit(1 - alpha)
    numbered = df.withColumn("_t", F.row_number().over(by_symbol()) - 1).withColumn("_block", F.floor(F.col("_t") / BLOCK)).withColumn("_o", F.col("_t") % BLOCK)
    weight = F.when(F.col("_t") == 0, 1.0).otherwise(alpha)
    own = Window.partitionBy("symbol", "_block").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    local = F.pow(r, F.col("_o")) * F.sum(weight * F.col(value) * F.pow(r, -F.col("_o"))).over(own)
    numbered = numbered.withColumn("_local", local)
    ends = numbered.groupBy("symbol", "_block").agg(F.max_by("_local", "_t").alias("_end"))
    blocks = Window.partitionBy("symbol").orderBy("_block")
    ends = ends.select("symbol", "_block", (F.coalesce(F.lag("_end", 1).over(blocks), F.lit(0.0)) + F.lit(keep**BLOCK) * F.coalesce(F.lag("_end", 2).over(blocks), F.lit(0.0))).alias("_carry"))
    joined = numbered.join(ends, ["symbol", "_block"])
    value_now = F.col("_local") + F.pow(r, F.col("_o") + 1) * F.col("_carry")
    return joined.withColumn(out, F.when(F.col("_t") >= min_rows - 1, value_now)).drop("_t", "_block", "_o", "_local", "_carry")


def macd(bars: DataFrame) -> DataFrame:
    df = exponential_mean(bars, "close", 2 / 13, "ema_12", 12)
    df = exponential_mean(df, "close", 2 / 27, "ema_26", 26)
    return df.withColumn("macd", F.col("ema_12") - F.col("ema_26"))


def relative_strength(bars: DataFrame, n: int = 14) -> DataFrame:
    """rsi: 100 - 100 / (1 + mean gain / mean loss), exponential means with alpha 1 / n from the first change on."""
    change = F.col("close") - F.lag("close").over(by_symbol())
    df = bars.withColumn("_change", F.coalesce(change, F.lit(0.0)))
    df = df.withColumns({"_gain": F.greatest("_change", F.lit(0.0)), "_loss": F.greatest(-F.col("_change"), F.lit(0.0))})
    df = exponential_mean(exponential_mean(df, "_gain", 1 / n, "_up", n), "_loss", 1 / n, "_down", n)
    rsi = F.when(F.col("_down") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("_up") / F.nullif(F.col("_down"), F.lit(0.0))))
    return df.withColumn("rsi", F.when(F.col("_up").isNotNull(), rsi)).drop("_change", "_gain", "_loss", "_up", "_down")


def true_range_mean(bars: DataFrame, n: int = 14) -> DataFrame:
    """atr: 0 for n - 1 rows, the mean of the first n true ranges, then smoothed with alpha 1 / n.

    The seed is the smoothing's first value, so the smoothing runs over the rows from the n-th on.
    """
    w = by_symbol()
    before = F.lag("close").over(w)
    span = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    df = bars.withColumn("_tr", span).withColumn("_n", F.row_number().over(w))
    seed = F.avg("_tr").over(w.rowsBetween(-(n - 1), 0))
    df = df.withColumn("_x", F.when(F.col("_n") == n, seed).otherwise(F.col("_tr")))
    late = exponential_mean(df.where(F.col("_n") >= n), "_x", 1 / n, "atr")
    early = df.where(F.col("_n") < n).withColumn("atr", F.lit(0.0))
    return early.unionByName(late).drop("_tr", "_n", "_x")


def next_day_label(bars: DataFrame, skip: int = 26, margin: float = 0.005) -> DataFrame:
    """label of the next day's change, without the first `skip` rows and the last of each symbol (and short symbols)."""
    w = by_symbol()
    df = bars.withColumns({"_n": F.row_number().over(w), "next_return": F.lead("close").over(w) / F.col("close") - 1})
    df = df.where((F.col("_n") > skip) & F.col("next_return").isNotNull())
    return df.withColumn("label", clean.direction(F.col("next_return"), margin)).drop("_n")
