"""Shared pieces: word splitting, the shared work folder, bounded broadcasts and row keys."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that separates words; everything else belongs to a word.
GAP_CHARS = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """array<string> of the words of a text; empty for null or blank text."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(GAP_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def n_words(text: Column) -> Column:
    """Number of words, counted without building the array."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once per row.

    The optimiser may move an expression into a lambda that names it, where it would be computed again for
    every element of an array. A value bound as a lambda's variable stays out.
    """
    return F.element_at(F.transform(F.array(value), f), 1)


def work_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent in a local session, as in tests, a temporary folder is set in its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by `stored` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _width(name: str, kind: T.DataType) -> Column:
    """Bytes of a value, about."""
    column = F.col(f"`{name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        width = F.octet_length(column)
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        width = F.octet_length(F.array_join(column, "")) + 16 * F.size(column)
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        width = 8 * F.size(column)
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        width = F.octet_length(F.to_json(F.struct(column)))
    else:
        width = F.lit(8)
    return F.coalesce(width, F.lit(0)) + 8


def small(df: DataFrame, max_rows: int = 500_000, max_bytes: int = 64 << 20) -> DataFrame:
    """Hint a broadcast where df, a stored table, has at most max_rows rows and max_bytes bytes, both counted.

    Beyond that the join shuffles both sides.
    """
    if df.count() > max_rows:
        return df
    width = sum((_width(f.name, f.dataType) for f in df.schema.fields), F.lit(0))
    n_bytes = df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if n_bytes <= max_bytes else df


def row_key(*columns: Column) -> Column:
    return F.xxhash64(*columns)


def packed(df: DataFrame) -> DataFrame:
    """df with all its columns in one struct `row`, so that added columns clash with none of them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unpacked(columns: list[str], **replaced: Column) -> list[Column]:
    """The columns of a struct `row`, some of them replaced."""
    return [(replaced[c] if c in replaced else F.col("row").getField(c)).alias(c) for c in columns]


#: Equal rows are numbered in pieces of this many.
PIECE = 4096


def numbered(rows: DataFrame) -> DataFrame:
    """The rows with `nth`, which numbers equal ones from 0; all columns must be comparable.

    Equal rows are counted before they are shuffled. Of a row that is there more than PIECE times, pieces are
    dealt to tasks before they are made rows again.
    """
    counted = rows.groupBy(*[F.col(f"`{c}`") for c in rows.columns]).agg(F.count(F.lit(1)).alias("_m"))
    single = counted.where(F.col("_m") <= PIECE).withColumn("_piece", F.lit(0).cast("long"))
    pieces = counted.where(F.col("_m") > PIECE).withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_m") - 1) / PIECE))))
    pieces = single.unionByName(pieces.repartition(*[F.col(f"`{c}`") for c in rows.columns], "_piece"))
    first = F.col("_piece") * PIECE
    return pieces.withColumn("nth", F.explode(F.sequence(first, F.least(first + PIECE, F.col("_m")) - 1))).drop("_m", "_piece")


def whole_key(columns: list[str], prefix: str = "") -> list[Column]:
    """Two hashes of a whole row: rows that agree in them are taken for equal (128 bits)."""
    all_columns = [F.col(f"{prefix}`{c}`") for c in columns]
    return [F.xxhash64(F.lit(k), *all_columns).alias(f"_key{k}") for k in (1, 2)]


def deal(rows: DataFrame, dealt: DataFrame) -> DataFrame:
    """Each entry of `dealt` with the row it is for: `row`, a struct of the columns of rows, and the columns of dealt.

    `dealt` has the columns _key1 and _key2 (see whole_key) and an entry for each of the rows. Equal rows are one
    row here, so no key's rows meet; the entries of a key are that many rows of a join, which Spark splits where skewed.
    """
    keyed = packed(rows).select("row", *whole_key(rows.columns, "row."))
    return keyed.dropDuplicates(["_key1", "_key2"]).join(dealt, ["_key1", "_key2"])
