"""Document fingerprints: bottom-k sketches of word shingles.

A sketch is the k least distinct hashes of a text's shingles (five words, A-Z lower-cased; a text of fewer words is one
shingle), as an ascending array<long>. Sketches of parts merge into the sketch of the whole, exactly; two sketches give
resemblance, containment and, one alone, the number of distinct shingles. All are column expressions.

Each document is compared with an edited text, which ends in the beginning of the next document. Neighbours meet
without a global sort: documents go to buckets, ranges of the order by doc_id whose ends are counted first, and each bucket also
gets the first document of the bucket after it. Texts are shuffled once.

Defined results: null texts are empty; an empty or blank text has an empty sketch, which resembles another empty one by 1 and
any other by 0; rows of null doc_id come first; rows of equal doc_id are ordered by a hash of their text; equal rows are
interchangeable neighbours; a single row is its own next. A very long text is one row and is sketched whole. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .decontaminate import SHINGLE, shingle_hashes

#: Size of a sketch: resemblance r is met with a standard deviation of sqrt(r (1 - r) / K), 0.044 at most.
K = 128
#: Rows of a bucket of neighbours, and buckets at most; beyond so many rows buckets grow, and sort on disk.
BUCKET_ROWS, BUCKETS = 1024, 65536


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    words = common.words(common.lower_ascii(F.coalesce(text, F.lit(""))))
    return least(shingle_hashes(words, shingle), k)


def least(hashes: Column, k: int = K) -> Column:
    """The k least of distinct hashes."""
    return F.slice(F.sort_array(hashes), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    return least(F.array_union(a, b), k)


def merged_by(sketches: DataFrame, column: str, k: int = K, *by: str) -> DataFrame:
    """by, the merged sketch: one for each group of rows. Each task passes on k hashes of a group at most."""
    hashes = sketches.select(*by, F.explode(column).alias("_h")).distinct()
    order = Window.partitionBy(*by).orderBy("_h")
    kept = hashes.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    found = kept.groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias("_s"))
    groups = sketches.select(*by).distinct()
    same = [groups[c].eqNullSafe(found[c]) for c in by]
    return groups.join(found, same, "left").select(*[groups[c] for c in by], F.coalesce("_s", F.array().cast("array<bigint>")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of both texts that are in both; exact for texts of few shingles."""

    def of(both: Column) -> Column:
        return F.when(F.size(both) == 0, 1.0).otherwise(F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both))

    return common.let(merged(a, b, k), of)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that are in b; NULL where a is empty or no hash of a lies in b's range."""
    in_range = lambda last: F.when(F.size(b) < k, a).otherwise(F.filter(a, lambda h: h <= last))
    own = common.let(F.try_element_at(b, F.lit(-1)), in_range)
    return common.let(own, lambda own: F.when(F.size(own) > 0, F.size(F.array_intersect(own, b)) / F.size(own)))


def n_distinct(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.try_element_at(a, F.lit(-1)).cast("double") + float(1 << 63)) / float(1 << 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def printed(a: Column) -> Column:
    """A sketch as text: its hashes as eight bytes each, in base 64."""
    digits = F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")
    return F.translate(F.base64(F.unhex(digits)), "\r\n", "")


def _bucket(ends: Column, key: Column) -> Column:
    """The number of the last of the ascending ends that is not above key; 0 where all are."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(BUCKETS.bit_length()))])
    return common.let(key, lambda x: F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.coalesce(F.get(ends, at + s) <= x, F.lit(False)), at + s).otherwise(at)))


def with_next(docs: DataFrame, added: dict[str, Column]) -> DataFrame:
    """doc_id, text, the added columns, and `next`, a struct of text and the added columns of the next row by doc_id; the first follows the last.

    The added columns are made of doc_id and text, once for each row.
    """
    # a number tells equal rows apart, so that many of them spread over buckets; which is first does not matter
    key = [F.col("doc_id").alias("id"), F.xxhash64("text").alias("tie"), F.xxhash64(F.monotonically_increasing_id()).alias("no")]
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n_buckets = min(BUCKETS, -(-texts.count() // BUCKET_ROWS))
    if n_buckets == 0:
        n_buckets = 1
    ranges = texts.select(*key).repartitionByRange(n_buckets, "id", "tie", "no")
    starts = common.stored(ranges.groupBy(F.spark_partition_id().alias("_p")).agg(F.min(F.struct("id", "tie", "no")).alias("start")), "bucket_starts")
    ends = starts.agg(F.sort_array(F.collect_list("start")).alias("_ends"))
    ends = common.stored(ends, "bucket_ends")  # a row of BUCKETS entries at most
    placed = texts.select("doc_id", "text", *key).crossJoin(F.broadcast(ends))
    placed = placed.select(_bucket(F.col("_ends"), F.struct("id", "tie", "no")).alias("bucket"), F.lit(False).alias("after"), "tie", "no", "doc_id", "text")
    # each bucket's first row once more, behind the last of the bucket before
    firsts = ends.select(F.posexplode("_ends").alias("at", "e"), F.size("_ends").alias("n"))
    firsts = firsts.select(F.pmod(F.col("at") - 1, F.col("n")).cast("int").alias("bucket"), F.col("e.id").alias("_id"), F.col("e.tie").alias("_tie"))
    rows = texts.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    firsts = rows.join(F.broadcast(firsts), rows["doc_id"].eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie"))).dropDuplicates(["bucket"])
    firsts = firsts.select("bucket", F.lit(True).alias("after"), "tie", F.lit(0).cast("long").alias("no"), "doc_id", "text")
    together = placed.unionByName(firsts).repartition("bucket").withColumns(added)
    order = Window.partitionBy("bucket").orderBy("after", F.asc_nulls_first("doc_id"), "tie", "no")
    following = F.lead(F.struct("text", *added)).over(order)
    return together.withColumn("next", following).where(~F.col("after")).select("doc_id", "text", *added, "next")


def edited(text: Column, following: Column) -> Column:
    """text with its last half (rounded down) replaced by as many code points of the beginning of the following text."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprint_report(docs: DataFrame, k: int = K) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how like the edited text's and the next document's it is."""
    df = with_next(docs, {"sketch": sketch(F.col("text"), k)})
    df = df.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "sketch", F.col("next.sketch").alias("next_sketch"), edited(F.col("text"), F.col("next.text")).alias("edited"))
    df = df.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "sketch", "next_sketch", sketch(F.col("edited"), k).alias("edited_sketch"))
    # the sketches stay columns of their own, computed once
    df = df.select("doc_id", "n_chars", "edited_sha256", F.explode(F.array(F.struct("sketch", "edited_sketch", "next_sketch"))).alias("s"))
    own = F.col("s.sketch")
    return df.select(
        "doc_id", "n_chars", "edited_sha256", printed(own).alias("fingerprint"), printed(F.col("s.edited_sketch")).alias("edited_fingerprint"),
        resemblance(own, F.col("s.edited_sketch"), k).alias("near_edited"), resemblance(own, F.col("s.next_sketch"), k).alias("near_next"), n_distinct(own, k).alias("n_shingles"),
    )
