"""Synthetic labelled streams with known drifts. Every value is a hash of (seed, run, seq): rows are made in parallel and alike each time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Thresholds of the four concepts of a SEA stream.
SEA = (8.0, 9.0, 7.0, 9.5)


def uniform(seed: int, *of: Column) -> Column:
    """In [0, 1), by hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 52)) / float(1 << 52)


def normal(seed: int, *of: Column) -> Column:
    return F.sqrt(-2 * F.ln(1 - uniform(seed, *of))) * F.cos(6.283185307179586 * uniform(seed + 7919, *of))


def _sea_columns(df: DataFrame, rows: int, seed: int, noise: float) -> DataFrame:
    at = [F.col("run"), F.col("seq")]
    df = df.withColumns({f"x{i}": 10 * uniform(seed + i, *at) for i in range(3)})
    concept = F.least(F.floor(F.col("seq") * len(SEA) / rows), F.lit(len(SEA) - 1)).cast("int")
    threshold = F.element_at(F.array(*map(F.lit, SEA)), concept + 1)
    clean = (F.col("x0") + F.col("x1") <= threshold).cast("int")
    return df.withColumn("y", F.when(uniform(seed + 99, *at) < noise, 1 - clean).otherwise(clean))


def sea(spark: SparkSession, runs: int, rows: int, seed: int = 1, noise: float = 0.1) -> DataFrame:
    """run, seq, x0, x1, x2, y: sums of two features against a threshold that changes at each quarter of a run."""
    ids = spark.range(runs * rows).select((F.col("id") % runs).cast("int").alias("run"), F.floor(F.col("id") / runs).alias("seq"))
    return _sea_columns(ids, rows, seed, noise)


def sea_live(spark: SparkSession, runs: int, rows: int, seed: int = 1, noise: float = 0.1) -> DataFrame:
    """The same rows as a stream, read from files in the shared folder."""
    from ..session import shared_folder

    path = f"{shared_folder(spark)}/sea"
    df = sea(spark, runs, rows, seed, noise)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def hyperplane(spark: SparkSession, runs: int, rows: int, features: int = 15, drifting: int = 5, magnitude: float = 0.01, seed: int = 1, noise: float = 0.05) -> DataFrame:
    """run, seq, x0.., y: a plane through the unit cube whose first weights move by `magnitude` per row."""
    ids = spark.range(runs * rows).select((F.col("id") % runs).cast("int").alias("run"), F.floor(F.col("id") / runs).alias("seq"))
    at = [F.col("run"), F.col("seq")]
    df = ids.withColumns({f"x{i}": uniform(seed + i, *at) for i in range(features)})
    weights = [uniform(seed + 1000 + i, F.col("run")) + (magnitude * F.col("seq") if i < drifting else 0.0) for i in range(features)]
    side = sum((w * (F.col(f"x{i}") - 0.5) for i, w in enumerate(weights)), F.lit(0.0)) >= 0
    return df.withColumn("y", F.when(uniform(seed + 99, *at) < noise, (~side).cast("int")).otherwise(side.cast("int")))


def radial(spark: SparkSession, runs: int, rows: int, features: int = 15, centres: int = 20, drifting: int = 5, speed: float = 0.001, classes: int = 2, seed: int = 1) -> DataFrame:
    """run, seq, x0.., y: points around centres in the unit cube, each of one class and as likely as any other.

    The first `drifting` centres move by `speed` per row in a direction of their own and turn back at the walls.
    """
    ids = spark.range(runs * rows).select((F.col("id") % runs).cast("int").alias("run"), F.floor(F.col("id") / runs).alias("seq"))
    at = [F.col("run"), F.col("seq")]
    df = ids.withColumn("_c", F.floor(centres * uniform(seed + 1, *at)).cast("int"))
    centre, step = [F.col("run"), F.col("_c")], F.when(F.col("_c") < drifting, speed * F.col("seq")).otherwise(0.0)

    def direction(key: int, *of: Column) -> list[Column]:
        return [2 * uniform(seed + key + i, *of) - 1 for i in range(features)]

    moves, offsets = direction(2000, *centre), direction(3000, *at)
    df = df.withColumns({f"_m{i}": c for i, c in enumerate(moves)} | {f"_o{i}": c for i, c in enumerate(offsets)})
    length = lambda p: F.sqrt(sum((F.col(f"{p}{i}") * F.col(f"{p}{i}") for i in range(features)), F.lit(1e-12)))
    df = df.withColumns({"_lm": length("_m"), "_lo": length("_o"), "_r": normal(seed + 5, *at) * uniform(seed + 6, *centre)})
    xs = {}
    for i in range(features):
        place = F.pmod(uniform(seed + 1000 + i, *centre) + step * F.col(f"_m{i}") / F.col("_lm"), F.lit(2.0))
        xs[f"x{i}"] = F.when(place > 1, 2 - place).otherwise(place) + F.col("_r") * F.col(f"_o{i}") / F.col("_lo")
    y = F.floor(classes * uniform(seed + 7, *centre)).cast("int").alias("y")
    return df.select("run", "seq", *[x.alias(n) for n, x in xs.items()], y)


def stagger(spark: SparkSession, runs: int, rows: int, seed: int = 1) -> DataFrame:
    """run, seq, size, colour, shape, y: three rules in turn, the first again at the end."""
    ids = spark.range(runs * rows).select((F.col("id") % runs).cast("int").alias("run"), F.floor(F.col("id") / runs).alias("seq"))
    at = [F.col("run"), F.col("seq")]
    names = {"size": ("small", "medium", "large"), "colour": ("red", "blue", "green"), "shape": ("circle", "square", "triangle")}
    df = ids.withColumns({n: F.element_at(F.array(*map(F.lit, v)), F.floor(3 * uniform(seed + i, *at)).cast("int") + 1) for i, (n, v) in enumerate(names.items())})
    rules = [(F.col("size") == "small") & (F.col("colour") == "red"), (F.col("colour") == "green") | (F.col("shape") == "circle"), F.col("size").isin("medium", "large")]
    quarter = F.floor(F.col("seq") * 4 / rows)
    return df.withColumn("y", F.when(quarter == 1, rules[1]).when(quarter == 2, rules[2]).otherwise(rules[0]).cast("int"))


def spliced(first: DataFrame, second: DataFrame, position: int, width: float, seed: int = 1) -> DataFrame:
    """Rows of first, then of second, with a sigmoid mixture of `width` rows around position; both have run and seq."""
    share = 1 / (1 + F.exp(-4 * (F.col("seq") - position) / width))
    late = uniform(seed + 555, F.col("run"), F.col("seq")) < share
    return first.where(~late).unionByName(second.where(late))


def with_noise(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """noise_i, uniform features that say nothing about the class."""
    return df.withColumns({f"noise_{i}": uniform(seed + i, F.col("run"), F.col("seq")) for i in range(n)})
