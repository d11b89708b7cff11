"""Scans and sinks for Parquet, CSV and JSON configuration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException


class MissingInput(FileNotFoundError):
    """An input that an earlier step should have written."""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def required(read, hint: str) -> DataFrame:
    """read(), or MissingInput with a hint about the step to run first."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() and "PATH_NOT_FOUND" in error.getCondition():
            raise MissingInput(hint) from error
        raise


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def first_available(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """The first of the names that is a column."""
    return next((c for c in candidates if c in df.columns), None)


def select_existing(df: DataFrame, wanted: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return df.select([c for c in dict.fromkeys([*keys, *wanted]) if c in df.columns])


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as NULL in all floating-point columns."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(f"`{c}`")) for c in floats})


def csv(spark: SparkSession, path: str, schema: str | None = None, renamed: dict[str, str] | None = None) -> DataFrame:
    """A CSV with its header in lower case; of columns with one name the first stays. Text columns unless a schema is given."""
    reader = spark.read.option("header", True)
    if schema:
        return reader.schema(schema).csv(path)
    df = reader.csv(path)
    header = spark.read.csv(path).limit(1).first()
    names = [str(x).lower() for x in header] if header else df.columns
    first = [i for i, n in enumerate(names) if n not in names[:i]]
    df = df.toDF(*[f"_{i}" for i in range(len(names))]).select(*[F.col(f"_{i}").alias(names[i]) for i in first])
    return df.withColumnsRenamed(renamed or {})


def monthly(spark: SparkSession, pattern: str, ts: str, columns: Sequence[str]) -> DataFrame:
    """Rows of monthly files, or folders of part files, (…YYYY-MM…) whose timestamp falls in their file's month; one job for all."""
    month = F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}-\d{2})[^/]*(?:/part-[^/]*)?$", 1)
    df = spark.read.parquet(pattern).select(*columns, month.alias("_month"))
    return df.where(F.date_format(ts, "yyyy-MM") == F.col("_month")).drop("_month")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_runs(df: DataFrame, path: str, keys: Sequence[str] = ("group", "dataset", "variant", "seed")) -> None:
    """Results of runs, one folder per run."""
    df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).option("header", True).csv(path)


def write_ranks(df: DataFrame, path: str, comments: Sequence[str] = (), keys: Sequence[str] = ()) -> None:
    """A table of ranks: path/header holds `#` comments and the column names, path/data its quoted rows, by the keys."""
    head = [*(f"# {c}" for c in comments), ",".join(df.columns)]
    df.sparkSession.createDataFrame([("\n".join(head),)], "line string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    df.orderBy(*(keys or df.columns[:1])).write.mode("overwrite").option("escape", '"').csv(f"{path}/data")


CONFIG = (
    "experiment_group string, datasets array<string>, seeds array<int>, output_dir string, warmup int, log_every int, refresh_every int, "
    "max_instances bigint, verbose boolean, model_variants array<struct<name:string,model:string,selector:string,detector:string>>"
)
DEFAULTS = {"output_dir": "results/", "warmup": 1500, "log_every": 1000, "refresh_every": 0, "max_instances": 2**63 - 1, "verbose": False}


def config(spark: SparkSession, path: str) -> DataFrame:
    """One row per experiment file, absent settings at their defaults."""
    df = spark.read.schema(CONFIG).option("multiLine", True).json(path)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items()})


def runs(configs: DataFrame) -> DataFrame:
    """dataset x variant x seed of each configuration."""
    df = configs.select("experiment_group", "warmup", "log_every", "max_instances", F.explode("datasets").alias("dataset"), "seeds", "model_variants")
    df = df.withColumn("variant", F.explode("model_variants")).withColumn("seed", F.explode("seeds"))
    return df.select("experiment_group", "dataset", F.col("variant.name").alias("variant"), "seed", F.col("variant.model").alias("model"), "warmup", "log_every", "max_instances", F.coalesce("variant.detector", F.lit("TWO_LEVEL")).alias("detector"))


def find_file(spark: SparkSession, folder: str, name: str) -> str | None:
    """Path of the entry of a folder with this name in any case; the first by name of several."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    entries = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    found = sorted(e.getPath().getName() for e in entries if e.getPath().getName().lower() == name.lower())
    return f"{folder.rstrip('/')}/{found[0]}" if found else None
