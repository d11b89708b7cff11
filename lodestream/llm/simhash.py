"""SimHash near-duplicates through deletion-variant signatures.

A text's fingerprint has bit b set if more than half of its shingles' XXH64 values have it set. Two
fingerprints are linked if they differ in at most three bits. The 64 bits are cut into two segments only:
of three differing bits one segment has at most one. Each segment is therefore indexed under its 32
one-wildcard variants (one bit struck out), two fingerprints that may be linked agree in a variant, and
an equality join of the variants finds them; the join condition verifies the whole distance and accepts
a pair at its first agreeing variant alone. Variants that many fingerprints share are refined by variants of the
other segment's halves, so that no bucket is compared with itself whole.

Only distinct fingerprints are indexed: equal ones, however many, are one row.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other; a text
of fewer words than a shingle is one shingle; repeated rows are rows with equal results; component_id
is null only where every doc_id of the component is null; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components

SEED = 42
MAX_BITS = 3
#: Buckets of more fingerprints than this are refined before pairs are compared.
LARGE_BUCKET = 512
#: Shingle hashes turned into bits at once.
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return 0
    if len(tokens) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(tokens), SEED)]
    else:
        joined = b" ".join(tokens)
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
        starts = np.concatenate(([0], ends[: -shingle] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist())]
    array = np.array(hashes, dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(array), CHUNK):
        part = array[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(array), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, text_key (hash of the text) and fp (the fingerprint as a signed long) of every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], names=["doc_id", "text_key", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text"), "text").mapInArrow(of, f"doc_id {kind}, text_key long, fp long")


def _found_at(diff: str, bit: str) -> str:
    """SQL: parts that differ by `diff` agree in the variant `bit`, and in no variant before it."""
    return f"({diff} = (1L << cast({bit} as int)) OR ({diff} = 0L AND {bit} = 0L))"


LOW = "(({0}) & 4294967295L)"
HIGH = "(shiftrightunsigned({0}, 32))"


def _variants(fps: DataFrame) -> DataFrame:
    """fp, key: 64 one-wildcard variants; key holds segment, struck bit and the rest of the segment."""
    low, high = LOW.format("fp"), HIGH.format("fp")
    variants = f"transform(sequence(0, 63), j -> (cast(j as bigint) << 32) | ((CASE WHEN j < 32 THEN {low} ELSE {high} END) & ~(1L << (j & 31))))"
    return fps.select("fp", F.explode(F.expr(variants)).alias("key"))


def _accept(x: str, key: str) -> str:
    """SQL: the fingerprints' difference x is at most three bits and first found under this key."""
    low, high, j = LOW.format(x), HIGH.format(x), f"({key} >> 32)"
    return f"bit_count({x}) <= {MAX_BITS} AND CASE WHEN {j} < 32 THEN {_found_at(low, f'({j} & 31L)')} ELSE bit_count({low}) > 1 AND {_found_at(high, f'({j} & 31L)')} END"


def links(fps: DataFrame) -> DataFrame:
    """(u, v): all pairs of the distinct fingerprints `fp` that differ in at most three bits, each once."""
    counted = _variants(fps).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key")))
    shared = common.stored(counted.where("n > 1"), "shared_variants")
    plain = shared.where(F.col("n") <= LARGE_BUCKET).select("key", "fp")
    a, b = plain.select("key", F.col("fp").alias("u")), plain.select("key", F.col("fp").alias("v"))
    pairs = a.join(b, "key").where("u < v").where(_accept("(u ^ v)", "key")).select("u", "v")
    # of the other segment, one half of 16 bits differs by at most one bit
    other = "(CASE WHEN (key >> 32) < 32 THEN shiftrightunsigned(fp, 32) ELSE (fp & 4294967295L) END)"
    half = f"(CASE WHEN k < 16 THEN ({other} & 65535L) ELSE shiftrightunsigned({other}, 16) END)"
    finer = f"transform(sequence(0, 31), k -> (cast(k as bigint) << 16) | ({half} & ~(1L << (k & 15))))"
    large = shared.where(F.col("n") > LARGE_BUCKET).select("key", "fp", F.explode(F.expr(finer)).alias("sub"))
    c, d = large.select("key", "sub", F.col("fp").alias("u")), large.select("key", "sub", F.col("fp").alias("v"))
    x = "(CASE WHEN (key >> 32) < 32 THEN shiftrightunsigned(u ^ v, 32) ELSE ((u ^ v) & 4294967295L) END)"
    first, second, k = f"({x} & 65535L)", f"(shiftrightunsigned({x}, 16))", "(sub >> 16)"
    once = f"CASE WHEN {k} < 16 THEN {_found_at(first, f'({k} & 15L)')} ELSE bit_count({first}) > 1 AND {_found_at(second, f'({k} & 15L)')} END"
    refined = c.join(d, ["key", "sub"]).where("u < v").where(_accept("(u ^ v)", "key")).where(once).select("u", "v")
    return pairs.unionByName(refined)


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, text_key, fp and component_id (the least doc_id of the linked group) of every row."""
    rows = common.stored(fingerprints(docs, shingle), "fingerprints")
    distinct = common.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"))).withColumnRenamed("u", "fp").withColumnRenamed("v", "root")
    roots = common.small(roots)
    own = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = own.join(least, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "text_key", "fp", "component_id")


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each linked group: that of the least doc_id (then of the least text hash); columns as in docs."""
    rows = common.stored(fingerprints(docs), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id"), F.col("text_key"))
    distinct = common.stored(rows.groupBy("fp").agg(F.min(order).alias("first")), "distinct")
    roots = common.small(components(links(distinct.select("fp"))).withColumnRenamed("u", "fp").withColumnRenamed("v", "root"))
    kept = distinct.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    kept = kept.select(F.col("first.doc_id").alias("id"), F.col("first.text_key").alias("text_key"))
    found = common.packed(docs).join(kept, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("row.text") == F.col("text_key")))
    one = Window.partitionBy("id", "text_key").orderBy("text_key")
    return found.withColumn("nth", F.row_number().over(one)).where("nth = 1").select(*common.unpacked(docs.columns))
