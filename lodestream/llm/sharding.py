"""Sharding by proportional stratified interleaving (law `rows`).

Rows are put in a seeded random order within each source; a row of rank r of n gets the fraction
(r - 1/2) / n. Sorting all rows by this fraction spreads each source evenly over the order, and cutting
the order into equal runs gives shards whose mixture is that of the whole and whose counts differ by
at most one.

Equal rows, however many, are numbered (`common.numbered`), and the number is part of the hash, so that they
spread over the order and over tasks; law `rows` spreads a group of equal texts over the shards. Nothing is ranked in one task: ranks within a source are counts of earlier hash ranges plus a rank within
the range, and the global order is cut into ranges of the fraction, which hold equally many rows by
construction. Only the counts of the ranges, a bounded number, are summed in order.

Defined results: null text has 0 bytes (size 16, crc32 0); null source is a source; equal
rows are interchangeable; rows that agree in doc_id, source and text, and so in hash, are ordered by a hash of all columns;
a very long text is hashed where it is read and only its hash moves in `shard_slots`; empty tables give empty tables.
Other columns pass through `shard_rows`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Hash ranges within a source and ranges of the fraction: at 30 billion rows some 500,000 rows each.
SOURCE_RANGES, ORDER_RANGES = 4096, 65536


def _narrow(docs: DataFrame, seed: int) -> DataFrame:
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")
    df = common.numbered(docs.select("doc_id", "source", size.alias("size"), crc.alias("text_crc32"), *common.whole_key(docs.columns)))
    df = df.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size", "nth"))
    return df.withColumn("_bucket", F.pmod("_h", F.lit(SOURCE_RANGES)).cast("int"))


def shard_slots(docs: DataFrame, shards: int = 40, seed: int = 1) -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot and the hashes of the whole row (_key1, _key2) for each row of docs."""
    rows = common.stored(_narrow(docs, seed), "rows")
    counts = rows.groupBy("source", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    by_source = Window.partitionBy("source")
    earlier = by_source.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col("source").alias("_source"),
        F.col("_bucket").alias("_range"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(by_source).alias("_total"),
    )
    in_range = Window.partitionBy("source", "_bucket").orderBy("_h", "doc_id", "text_crc32", "size", "_key1", "_key2", "nth")
    ranked = rows.withColumn("_rank", F.row_number().over(in_range)).join(counts, rows["source"].eqNullSafe(counts["_source"]) & (rows["_bucket"] == counts["_range"]))
    ranked = ranked.select("doc_id", "source", "size", "text_crc32", "_key1", "_key2", "nth", "_h", ((F.col("_rank") + F.col("_before") - 0.5) / F.col("_total")).alias("_at"))
    ranked = common.stored(ranked.withColumn("_part", F.least(F.floor(F.col("_at") * ORDER_RANGES), F.lit(ORDER_RANGES - 1)).cast("int")), "ranked")
    parts = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    ordered = Window.orderBy("_part")
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"), F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    in_part = Window.partitionBy("_part").orderBy("_at", "source", "_h", "doc_id", "text_crc32", "size", "_key1", "_key2", "nth")
    placed = ranked.withColumn("_nth", F.row_number().over(in_part) - 1).join(F.broadcast(parts), "_part").withColumn("_pos", F.col("_first") + F.col("_nth"))
    placed = placed.withColumn("shard", F.expr(f"cast((_pos * {shards}L) div _all as int)"))
    start = F.expr(f"(shard * _all + {shards - 1}L) div {shards}L")
    return placed.select("doc_id", "source", "size", "text_crc32", "_key1", "_key2", "shard", (F.col("_pos") - start).cast("long").alias("slot"))


def shard_rows(docs: DataFrame, shards: int = 40, seed: int = 1) -> DataFrame:
    """The rows of docs with their shard and slot (columns of docs of these names are replaced)."""
    rows = docs.drop("shard", "slot")
    slots = shard_slots(rows, shards, seed)
    dealt = common.deal(rows, slots.select("_key1", "_key2", "shard", "slot"))
    return dealt.select(*common.unpacked(rows.columns), "shard", "slot")


def shard_report(docs: DataFrame, shards: int = 40, seed: int = 1) -> DataFrame:
    slots = shard_slots(docs, shards, seed)
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
