"""ARFF: attribute-relation files, through the data source of `arff_format`.

The class column comes last. Text and boolean columns, and those listed, are nominal with the sorted distinct
values as their domain, numbers are numeric, and NULL is `?`. A nominal number that is whole is written
without a fraction in the domain and in the rows alike.

A schema can carry its declarations: `described` puts domains and the class in the metadata of the fields, where filters and
selections keep them, so that a header declares what the whole data had and needs no pass over the data. `read` gives such a schema.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arff_format import CLASS, DOMAIN, declarations, register
from .tables import require_columns


def is_nominal(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.StringType, T.BooleanType))


def _nominal(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.BooleanType):
        return c.cast("int").cast("string")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def _domains(df: DataFrame, named: Sequence[T.StructField]) -> dict[str, list[str]]:
    held = {f.name: list(f.metadata[DOMAIN]) for f in named if DOMAIN in f.metadata}
    rest = [f for f in named if f.name not in held]
    found = df.agg(*[F.sort_array(F.collect_set(_nominal(f))).alias(f.name) for f in rest]).first().asDict() if rest else {}
    return held | found


def described(df: DataFrame, class_col: str, nominal: Sequence[str] = ()) -> DataFrame:
    """df whose schema holds the domains of its nominal columns and which column is the class."""
    named = [f for f in df.schema if is_nominal(f) or f.name in (*nominal, class_col)]
    domains = _domains(df, named)
    columns = []
    for f in df.schema:
        metadata = f.metadata | ({DOMAIN: domains[f.name]} if f.name in domains else {}) | ({CLASS: True} if f.name == class_col else {})
        columns.append(F.col(f"`{f.name}`").alias(f.name, metadata=metadata))
    return df.select(*columns)


def class_column(df: DataFrame) -> str:
    """The class of a described schema."""
    found = [f.name for f in df.schema if f.metadata.get(CLASS)]
    if len(found) != 1:
        raise ValueError(f"one class column is needed, not {len(found)}")
    return found[0]


def reduced(df: DataFrame, selected: Sequence[str]) -> DataFrame:
    """The selected features, in their order, and the class; each keeps its declaration. Features that are not there are an error."""
    own = class_column(df)
    return require_columns(df, selected).select(*[F.col(f"`{c}`") for c in [*(c for c in selected if c != own), own]])


def header(df: DataFrame, relation: str, class_col: str, nominal: Sequence[str] = ()) -> str:
    """The declarations. Domains that the schema does not hold are small sets by nature: the distinct values of the nominal columns alone reach the driver."""
    own = described(df, class_col, nominal)
    return declarations([f for f in own.schema if f.name != class_col] + [own.schema[class_col]], relation)


def write(df: DataFrame, path: str, relation: str, class_col: str, nominal: Sequence[str] = ()) -> None:
    """A folder of whole ARFF files with one header, in place of what was there."""
    register(df.sparkSession)
    described(df, class_col, nominal).write.format("arff").mode("overwrite").option("relation", relation).save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a folder or a file, numeric columns as double and all others as text; the schema holds the declarations."""
    register(spark)
    return spark.read.format("arff").load(path)


def profile(df: DataFrame, class_col: str) -> DataFrame:
    """Rows and share of each class, most frequent first."""
    counts = df.groupBy(F.col(class_col).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return counts.join(F.broadcast(total)).select("class", "n", (100.0 * F.col("n") / F.col("total")).alias("percent")).orderBy(F.desc("n"), "class")
