"""Session defaults shared by the queries, the tests and the benchmark."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTC keeps timestamps equal to naive ones; AQE sizes the shuffles at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}

ROWS_PER_TASK = 100_000


def local_session(cores: int = 8, app: str = "lodestream", **extra: str) -> SparkSession:
    """A local session for tests and the benchmark; on a cluster the submitter sets these."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": str(cores), "spark.driver.memory": "8g"} | extra
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir; only where that is unset, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_of(df: DataFrame) -> int | None:
    """How many tasks of some ROWS_PER_TASK rows a scan gives, counted from its files' footers; None where the cores suffice."""
    tasks = -(-df.count() // ROWS_PER_TASK)
    return tasks if tasks > df.sparkSession.sparkContext.defaultParallelism else None


def keyed(df: DataFrame, key: str) -> DataFrame:
    """A scan dealt by key, so that a task's memory does not grow with the input; as it is where the cores suffice.

    What is grouped or ordered by the key and more columns afterwards stays in its task without another shuffle.
    """
    tasks = tasks_of(df)
    return df if tasks is None else df.repartition(tasks, key)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast of df, a stored table, where it has at most max_rows rows; beyond that joins shuffle both sides."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
