"""Benchmark decontamination: test items found inside long documents.

Texts become sets of five-word shingles (lower case, runs of letters and digits are words; a shorter text
is one shingle). A document is contaminated by an item if it contains at least `min_containment` of the
item's shingles.

Search: documents are partitioned by size into powers of two, and the signature of a document of a partition has a
number of minima in proportion to the partition's upper size: the hash space is cut into so many equal ranges, and
the least hash of each range is kept (one-permutation MinHash). An item's hashes that are a document's minima are
found by an equality join. How many ranges a shingle gets follows from the shortest item: as few as let one
of the shingles that it must share be a minimum with a chance of 0.999. Long items so need a third of a document's hashes,
items of one shingle nearly all.

Estimate: of the shingles that an item shares with a document of its partition, the share `p` is expected to be met.
A pair is a candidate if as many were met as min_containment demands, less four standard deviations, one at least.

Verification: candidates are compared as exact sets of shingle strings, of which only those that meet an item's are
moved.

Defined results: null, empty or wordless texts and items match nothing; repeated items and repeated rows
are each matched; ties of containment all appear; a very long text is one row and searched whole; a null doc_id or item_id is kept; empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .licenses import normal_words

SHINGLE = 5


def _n_shingles(words: Column, n: int) -> Column:
    return F.when(F.size(words) == 0, 0).otherwise(F.greatest(F.size(words) - (n - 1), F.lit(1)))


def shingle_hashes(words: Column, n: int = SHINGLE) -> Column:
    """Distinct hashed shingles of an array of words."""

    def of(w: Column) -> Column:
        hashes = F.transform(F.slice(w, 1, _n_shingles(w, n)), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, n)]))
        return F.array_distinct(hashes)

    return common.let(words, of)


def shingle_texts(words: Column, n: int = SHINGLE) -> Column:
    """The same shingles as strings."""

    def of(w: Column) -> Column:
        texts = F.transform(F.slice(w, 1, _n_shingles(w, n)), lambda x, i: F.concat_ws(" ", x, *[F.get(w, i + k) for k in range(1, n)]))
        return F.array_distinct(texts)

    return common.let(words, of)


def resolution(n_shared: int, miss: float = 1e-3) -> int:
    """e: with 2^e ranges for a hash, one of n_shared hashes is the least of its range but for this chance."""
    return next((e for e in range(-4, 10) if 1 - met_share(e) <= miss ** (1 / n_shared)), 10)


def met_share(e: int) -> float:
    """Expected share of a document's hashes that are minima with 2^e ranges for a hash, at the fullest of its partition."""
    load = 2.0**-e
    return (1 - math.exp(-load)) / load


def minima(hashes: Column, e: int = 0) -> Column:
    """The least of the distinct hashes in each of the equal ranges: 2^e times the upper size of the hashes' partition."""

    def first_of_ranges(h: Column, s: Column) -> Column:
        part = lambda x: F.call_function("shiftright", x, s)
        return F.filter(h, lambda x, i: (i == 0) | (s < 64) & (part(x) != part(F.get(h, i - 1))))

    bits = lambda h: F.greatest(F.ceil(F.log2(F.greatest(F.size(h), F.lit(1)))).cast("int") + e, F.lit(0))
    return common.let(F.sort_array(hashes), lambda h: common.let(F.lit(64) - bits(h), lambda s: first_of_ranges(h, s)))


def _exploded(df: DataFrame, hashes: Column) -> DataFrame:
    """text_key and h for every hash; the outer form keeps the optimiser from computing them once more to filter by."""
    return df.select("text_key", F.explode_outer(hashes).alias("h")).where(F.col("h").isNotNull())


def candidates(docs: DataFrame, tests: DataFrame, min_containment: float) -> DataFrame:
    """text_key, item_no: the pairs whose estimated containment may reach min_containment; tests: item_no and h, stored."""
    shortest = tests.agg(F.min(F.size("h"))).first()[0] or 1
    e = resolution(max(1, math.ceil(min_containment * shortest - 1e-9)))
    p = met_share(e)
    demanded = F.ceil(F.size("h") * min_containment - 1e-9)
    least = F.greatest(F.floor(demanded * p - 4 * F.sqrt(demanded * p * (1 - p))), F.lit(1)).cast("long")
    by_hash = common.small(common.stored(tests.select(F.explode("h").alias("h"), "item_no", least.alias("least")), "item_hashes"))
    keys = common.small(common.stored(by_hash.select("h").distinct(), "item_keys"))
    hashed = docs.select(F.xxhash64("text").alias("text_key"), shingle_hashes(normal_words(F.coalesce("text", F.lit("")))).alias("hs"))
    met = _exploded(hashed, minima(F.col("hs"), e)).join(keys, "h", "left_semi").distinct()
    met = met.join(by_hash, "h").groupBy("text_key", "item_no").agg(F.count(F.lit(1)).alias("n_met"), F.max("least").alias("least"))
    return met.where("n_met >= least").select("text_key", "item_no")


def contamination(docs: DataFrame, items: DataFrame, min_containment: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_item, n_shared and containment for each contaminated row of docs.

    items: item_id, text. Their hashes are broadcast only under a checked number of rows and bytes.
    """
    tests = items.select("item_id", normal_words(F.col("text")).alias("w")).where("size(w) > 0")
    w = F.col("w")
    tests = common.stored(tests.select("item_id", F.monotonically_increasing_id().alias("item_no"), shingle_hashes(w).alias("h"), shingle_texts(w).alias("s")), "items")
    found = common.stored(candidates(docs, tests.select("item_no", "h"), min_containment), "candidates")
    texts = common.small(common.stored(found.select("text_key").distinct(), "candidate_texts"))
    seen = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").join(texts, "text_key")
    seen = common.stored(seen, "candidate_rows")
    whole = seen.select("text_key", "text").dropDuplicates(["text_key"])
    shingles = whole.select("text_key", F.explode(shingle_texts(normal_words(F.col("text")))).alias("shingle"))
    asked = common.small(common.stored(tests.select("item_no", F.explode("s").alias("shingle")), "item_shingles"))
    shared = shingles.join(asked, "shingle").groupBy("text_key", "item_no").agg(F.count(F.lit(1)).alias("n_shared"))
    known = tests.select("item_no", "item_id", F.size("s").cast("long").alias("n_item"))
    pairs = shared.join(found, ["text_key", "item_no"], "left_semi").join(common.small(known), "item_no")
    pairs = pairs.withColumn("containment", F.col("n_shared") / F.col("n_item")).where(F.col("containment") >= min_containment)
    pairs = common.stored(pairs.drop("item_no"), "pairs")
    return seen.select("doc_id", "text_key").join(common.small(pairs), "text_key").select("doc_id", "item_id", "n_item", "n_shared", "containment")


def oracle_sql(min_containment: float = 0.8) -> str:
    """Exact containment of every item in every document, by brute force."""
    words = r"list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '')"
    grams = f"list_distinct(list_transform(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')))"
    return f"""
    WITH iw AS (SELECT item_id, {words} AS w FROM benchmark), dw AS (SELECT doc_id, {words} AS w FROM documents),
    ig AS (SELECT item_id, {grams} AS g FROM iw WHERE len(w) > 0),
    i AS (SELECT item_id, len(g)::BIGINT AS n_item, unnest(g) AS s FROM ig),
    d AS (SELECT doc_id, unnest({grams}) AS s FROM dw WHERE len(w) > 0),
    m AS (SELECT doc_id, item_id, n_item, count(*)::BIGINT AS n_shared FROM d JOIN i USING (s) GROUP BY ALL)
    SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM m WHERE n_shared / n_item >= {min_containment}
    """


def decontaminate(docs: DataFrame, items: DataFrame, min_containment: float = 0.8) -> DataFrame:
    """The rows of docs that contain no item; columns as in docs."""
    keyed = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    found = contamination(keyed, items, min_containment).select(F.col("doc_id").alias("text_key")).distinct()
    found = common.small(common.stored(found, "contaminated"))
    rest = common.packed(docs).withColumn("text_key", F.xxhash64("row.text")).join(found, "text_key", "left_anti")
    return rest.select(*common.unpacked(docs.columns))
