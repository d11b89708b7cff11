"""Near copies by five-word shingles, found by SimHash fingerprints and their deletion variants.

Two texts are near copies if their sets of five-word shingles have a Jaccard coefficient of at least 0.8. Five-word
shingles change too much with a few edits for a short Hamming distance, so fingerprints are taken of word pairs, of
which an edit changes two instead of five: at a coefficient of 0.8, 0.9 and 0.95, some 9, 6.5 and 4.5 % of the bits
differ. Three fingerprints of 64 bits are cut into three segments of 21 each; a segment that differs by at most one bit is
found under one of its 21 one-wildcard variants (see `simhash`). So short a segment is shared by many unrelated texts, so
each of the nine segments has a min-hash of the word pairs beside it, and a bucket is a variant and that min-hash: near
copies agree in nine of ten min-hashes, unrelated texts in hardly one. A bucket is sorted by a tenth min-hash, so that near
copies stand side by side in it too; each is paired with the first of its bucket and with the one before it. So the number
of candidates grows with the number of rows, not with the square of a group. The sort is by ranges, so a bucket of any size
spreads over tasks; where it does, the few rows at the tasks' borders are paired in the same way. Candidates are pruned by
the whole fingerprints' distance and by sketches of their shingle sets, and verified by those sets.

That finds 0.98 of single pairs at coefficients of 0.80 to 0.85 and 0.99 above (texts of 60 to 800 random words). The rest is found
by an exact search: of two texts at a coefficient of at least c, in any order of all shingles the first n - ceil(c n) + 1 of
either's n shingles have one in common. Shingles that are frequent in a sample of texts come last in that order, so that common passages make
no large buckets; the sample decides nothing but the order. Each text is dealt to its first shingles' buckets, and a bucket pairs what is
not in one group yet: the members outside its largest group with all others of like length. So the members of a large group are not paired
with each other, and no link between groups is lost. A pair is left out where too few shingles are left from the bucket's one on: the first
that two similar texts share leaves enough. A bucket with many pairs for each of its members, by a shingle that the sample did not know for frequent, is not paired: its texts alone
are dealt again in an order where such shingles, counted now over all texts, come later still, and with sketches that tell most pairs apart in their bucket; what is crowded
even so the last time is paired whole. Most of these pairs share a passage and no more. Their shingle sets stay where they are: a
text's signature has a bit or two for each shingle, which tells whether a shingle number of its own hashes is odd, so two signatures differ in no more bits
than the sets in shingles, and only pairs whose signatures are near enough are verified. There are no false links.

Defined results: a text of fewer than five words is one shingle, one of a single word is one pair; null, empty and blank
texts have no shingles and are copies of each other; equal texts are copies; a very long text is handled whole in its
task; of a group the row of the least doc_id stays (nulls last, then the least text hash), of equal ones any; an empty
table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components
from .ngram_lm import token_hashes

SHINGLE, MIN_SIMILARITY = 5, 0.8
#: Fingerprints of 64 bits, PER_WORD segments of SEGMENT bits each.
WORDS, PER_WORD, SEGMENT = 3, 3, 21
SEGMENTS = WORDS * PER_WORD
#: At a coefficient of 0.8 some 18 of 192 bits differ, with a deviation of 4: six of these are allowed.
MAX_DISTANCE = 42
CHUNK = 1 << 16
#: Texts whose shingles' frequencies order all; frequent shingles kept; text hashes a task remembers.
SAMPLE, FREQUENT, KNOWN = 5_000, 1 << 18, 1 << 20
#: A bucket is crowded with more pairs than these for each of its members; so many times crowded buckets' texts are dealt again, with sketches of these bits.
CROWDED, AGAIN, SKETCH = 16, 2, 512
ODD = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64)) for k in range(SHINGLE + WORDS + SEGMENTS)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(32))) * ODD[1]
    x = (x ^ (x >> np.uint64(29))) * ODD[2]
    return x ^ (x >> np.uint64(32))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words, from the words' hashes; of fewer words, one run."""
    if not len(words):
        return words
    n = min(n, len(words))
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total = _mixed(total + words[k : len(words) - n + 1 + k] * ODD[k])
    return total


def fingerprint(words: np.ndarray) -> list[int]:
    """WORDS fingerprints of the distinct pairs of words (so that frequent ones don't rule), a min-hash that orders, and one for each segment; signed."""
    pairs, out = np.unique(shingles(words, 2)), []
    for k in range(WORDS):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(pairs), CHUNK):
            hashed = _mixed(pairs[at : at + CHUNK] + ODD[SHINGLE + k])
            counts += np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(counts * 2 > len(pairs), bitorder="little").view("<i8")[0]))
    if not len(pairs):
        return [*out, *[0] * (1 + SEGMENTS)]
    masks = _mixed(np.array(ODD[SHINGLE + WORDS :]))
    least = np.array([pairs[0], *((pairs ^ m).min() for m in masks)])  # the pair nearest to each mask; pairs are in order
    return [*out, *_mixed(least + ODD[0]).view(np.int64).tolist()]


def _fingerprints(docs: DataFrame) -> DataFrame:
    """text_key, doc_id and fp (array<long>: fingerprint, number of shingles, sketch) of every row."""

    def whole(text: str | None) -> list[int]:
        words = token_hashes(text)
        grams = np.unique(shingles(words, SHINGLE))
        return [*fingerprint(words), len(grams), *np.frombuffer(sketch(grams), np.int64).tolist()]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [whole(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.list_(pa.int64()))], names=["text_key", "doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(_key("text"), "doc_id", "text").mapInArrow(of, f"text_key long, doc_id {kind}, fp array<long>")


def _key(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, id) in order: (a, b, border) for each id a with the first b of its key and the one before it.

    The first row of the task, and the first and the last of its last key, come as (id, null, key): a key may go on in another task.
    """

    def batch_of(a, b, border) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, border)], names=["a", "b", "border"])

    last = first_of_last = before = None
    for batch in batches:
        keys, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(keys):
            continue
        if last is None:
            last, first_of_last, before = keys[0] ^ 1, 0, 0
            yield batch_of(ids[:1], [None], keys[:1])
        fresh = keys != np.concatenate(([last], keys[:-1]))
        previous = np.concatenate(([before], ids[:-1]))
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), -1))
        first = np.where(start < 0, first_of_last, ids[start])
        apart = ~fresh & (first != previous)
        a = np.concatenate((ids[~fresh], ids[apart]))
        yield batch_of(a, np.concatenate((previous[~fresh], first[apart])), pa.nulls(len(a), pa.int64()))
        last, first_of_last, before = keys[-1], first[-1], ids[-1]
    if last is not None:
        yield batch_of([first_of_last, before], [None, None], [last, last])


def _candidates(fps: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """(a, b): each text with the first member of each of its buckets and the one before it, once, if their fingerprints are close and their sketches leave the coefficient possible.

    In buckets a text goes by an id of 24 bits of its min-hash and 40 of its hash: of texts that agree in both, all are candidates.
    """
    segment = f"(shiftrightunsigned(fp[cast(s div {PER_WORD} as int)], cast({SEGMENT} * (s % {PER_WORD}) as int)) & {(1 << SEGMENT) - 1}L)"
    key = f"(cast(s * {SEGMENT} + j as bigint) << {32 + SEGMENT}) | (({segment} & ~(1L << j)) << 32) | (fp[{WORDS + 1} + s] & 4294967295L)"
    keys = f"flatten(transform(sequence(0, {SEGMENTS - 1}), s -> transform(sequence(0, {SEGMENT - 1}), j -> {key})))"
    low = (1 << 40) - 1
    fps = fps.withColumn("id", F.expr(f"(fp[{WORDS}] & ~{low}L) | (text_key & {low}L)"))
    members = fps.select(F.explode(F.expr(keys)).alias("key"), "id").repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    met = common.stored(members.mapInArrow(_neighbours, "a long, b long, border long").distinct(), "neighbours")
    border = Window.partitionBy("border").orderBy("a")  # three rows a task at most
    across = met.where("border IS NOT NULL").select("a", F.array(F.first("a").over(border), F.lag("a").over(border)).alias("b")).select("a", F.explode("b").alias("b"))
    pairs = met.where("border IS NULL").select("a", "b").unionByName(across).where("a <> b").distinct()
    left, right = (fps.select(F.col("id").alias(x), F.col("text_key").alias(f"key_{x}"), F.col("fp").alias(f"fp_{x}")) for x in "ab")
    distance = " + ".join(f"bit_count(fp_a[{k}] ^ fp_b[{k}])" for k in range(WORDS))
    first = WORDS + 1 + SEGMENTS
    apart = " + ".join(f"bit_count(fp_a[{k}] ^ fp_b[{k}])" for k in range(first + 1, first + 1 + SKETCH // 64))
    may_be = f"{apart} <= (fp_a[{first}] + fp_b[{first}]) * {(1 - min_similarity) / (1 + min_similarity)!r}D + 1e-6D"
    return pairs.join(left, "a").join(right, "b").where(f"{distance} <= {MAX_DISTANCE} AND {may_be}").select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))


def _shingle_sets(texts: DataFrame) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(token_hashes(t.as_py()), SHINGLE)).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["text_key", "grams"])

    return texts.select("text_key", "text").mapInArrow(of, "text_key long, grams array<long>")


def signature(grams: np.ndarray) -> bytes:
    """Of each value of the distinct shingles' last bits, whether it is there an odd number of times: a power of two of bits, one a shingle at least."""
    bits = 1 << max(6, (len(grams) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """In how many shingles the sets of two signatures differ at least."""
    n, x, y = len(a), int.from_bytes(a, "little"), int.from_bytes(b, "little")
    if len(b) > n:
        n, x, y = len(b), y, x
    while n > min(len(a), len(b)):  # the longer one, as it would be of fewer bits
        n //= 2
        x = (x >> (8 * n)) ^ (x & ((1 << (8 * n)) - 1))
    return (x ^ y).bit_count()


def _near(docs: DataFrame, pairs: DataFrame, min_similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of text hashes, a stored table, whose signatures leave a Jaccard coefficient of at least min_similarity possible."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(token_hashes(t.as_py()), SHINGLE)) for t in batch.column(1)]
            columns = [batch.column(0), pa.array([len(g) for g in sets], pa.int32()), pa.array([signature(g) for g in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["text_key", "n", "signature"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, sa, sb = (c.to_pylist() for c in batch.columns)
            most = [m * (1 - min_similarity) / (1 + min_similarity) + 1e-6 for m in n]  # of so many shingles together, those of one set alone
            ok = pa.array([least_difference(x, y) <= m for x, y, m in zip(sa, sb, most)], pa.bool_())
            yield batch.select(["a", "b"]).filter(ok)

    asked = common.stored(pairs.select(F.explode(F.array("a", "b")).alias("text_key")).distinct(), "asked")
    texts = docs.select(_key("text").alias("text_key"), "text").join(common.small(asked), "text_key", "left_semi")
    signed = common.stored(texts.mapInArrow(sign, "text_key long, n int, signature binary").dropDuplicates(["text_key"]), "signatures")
    left, right = (signed.select(F.col("text_key").alias(x), F.col("n").alias(f"n{x}"), F.col("signature").alias(f"s{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "sa", "sb")
    return common.stored(both.mapInArrow(near, "a long, b long"), "near")


def _verified(docs: DataFrame, pairs: DataFrame, min_similarity: float) -> DataFrame:
    """(u, v): those of the pairs (a, b) of text hashes, a stored table, whose shingle sets have at least this Jaccard coefficient; stored."""
    asked = common.stored(pairs.select(F.explode(F.array("a", "b")).alias("text_key")).distinct(), "asked")
    texts = docs.select(_key("text").alias("text_key"), "text").join(common.small(asked), "text_key", "left_semi")
    sets = common.stored(_shingle_sets(texts).dropDuplicates(["text_key"]), "shingle_sets")
    both = pairs.join(sets.select(F.col("text_key").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("text_key").alias("b"), F.col("grams").alias("gb")), "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    close = shared >= min_similarity * (F.size("ga") + F.size("gb") - shared)
    alike = both.where(F.least(F.size("ga"), F.size("gb")) >= min_similarity * F.greatest(F.size("ga"), F.size("gb"))).where(close)
    links = common.stored(alike.select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    common.discard(sets)
    return links


def similar_texts(docs: DataFrame, fps: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """(u, v): hashes of different texts whose shingle sets have at least this Jaccard coefficient, as candidates found them."""
    return _verified(docs, common.stored(_candidates(fps, min_similarity), "candidates"), min_similarity)


def _frequent(docs: DataFrame, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of more than one row of a sample of about SAMPLE texts, in order, and in how many they are; at most FREQUENT, the most frequent ones."""
    every = max(1, n_texts // SAMPLE)
    sample = docs.select(_key("text").alias("text_key"), "text").where(F.pmod("text_key", F.lit(every)) == 0)
    counts = _shingle_sets(sample).select(F.explode("grams").alias("g")).groupBy("g").count().where("count > 1")
    found = counts.orderBy(F.desc("count"), "g").limit(FREQUENT).toPandas()  # of a sample of fixed size
    grams = found["g"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], found["count"].to_numpy(np.int64)[order]


def leading(grams: np.ndarray, min_similarity: float, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first of a text's distinct shingles, rare ones first, of which two similar texts share one."""
    n = len(grams)
    take = n - math.ceil(min_similarity * n - 1e-9) + 1
    known, counts = frequent
    times = np.zeros(n, np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        times = np.where(known[at] == grams, counts[at], 0)
    return grams[np.lexsort((grams, times))[:take]]


def sketch(grams: np.ndarray) -> bytes:
    """The signature of SKETCH bits, however many shingles there are."""
    return np.packbits((np.bincount((grams & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).astype(np.uint8), bitorder="little").tobytes()


def _leading(docs: DataFrame, min_similarity: float, frequent: tuple[np.ndarray, np.ndarray], sketches: bool = False) -> DataFrame:
    """gram, key, size and left: each text with its leading shingles, their number in all and from this one on, and perhaps its sketch.

    Of equal texts a task gives one at least.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, found, sizes, drawn = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key in seen:
                    continue
                if len(seen) >= KNOWN:
                    seen.clear()
                seen.add(key)
                grams = np.unique(shingles(token_hashes(text.as_py()), SHINGLE))
                if len(grams):
                    keys.append(key)
                    sizes.append(len(grams))
                    found.append(leading(grams, min_similarity, frequent))
                    drawn.append(sketch(grams) if sketches else b"")
            if keys:
                times = [len(f) for f in found]
                columns = [np.concatenate(found).view(np.int64), np.repeat(np.array(keys, np.int64), times), np.repeat(np.array(sizes, np.int32), times)]
                columns.append(np.concatenate([np.arange(n, n - t, -1, dtype=np.int32) for n, t in zip(sizes, times)]))
                columns = [pa.array(c) for c in columns]
                if sketches:
                    columns.append(pa.array([d for d, t in zip(drawn, times) for _ in range(t)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["gram", "key", "size", "left", *["sketch"] * sketches])

    return docs.select(_key("text"), "text").mapInArrow(of, "gram long, key long, size int, left int" + ", sketch binary" * sketches)


def bucket_pairs(root: np.ndarray, key: np.ndarray, size: np.ndarray, min_similarity: float, left: np.ndarray | None = None, *words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a bucket's members (in order of root) that are in different groups and of like size, in pieces.

    left: a member's shingles from the bucket's one on. Of the first shingle that two texts share, as many as they need to share are left in both.
    words: those of a member's sketch. Two texts' sketches differ in no more bits than their sets may in shingles.
    """
    starts = np.flatnonzero(np.diff(root, prepend=root[0] ^ 1))
    ends = np.append(starts[1:], len(root))
    largest = np.argmax(ends - starts)
    outside = np.concatenate((np.arange(starts[largest]), np.arange(ends[largest], len(root))))
    inside = root == root[starts[largest]]
    step = max(1, CHUNK // len(root))
    for at in range(0, len(outside), step):
        i = outside[at : at + step, None]
        like = np.minimum(size[i], size) >= min_similarity * np.maximum(size[i], size) - 1e-9
        if left is not None:
            like &= np.minimum(left[i], left) >= min_similarity / (1 + min_similarity) * (size[i] + size) - 1e-6
        a, b = np.nonzero(like & (root[i] != root) & (inside | (key[i] < key)))
        a = i[a, 0]
        if words:
            near = sum(np.bitwise_count(w[a] ^ w[b]).astype(np.int64) for w in (w.view(np.uint64) for w in words)) <= (size[a] + size[b]) * (1 - min_similarity) / (1 + min_similarity) + 1e-6
            a, b = a[near], b[near]
        yield key[a], key[b]


def _pairs(batches: Iterator[pa.RecordBatch], min_similarity: float, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Of rows (gram, root, key, size and perhaps left and sketch) in that order: (a, b), the pairs of each gram's bucket; a bucket is held at a time.

    most: (a, b, n) with n = 0 for pairs. Of a bucket with more pairs than these for each of its members come, instead, the gram and its members' number as a and n,
    and each member as a with n = -1.
    """
    held = np.zeros((0, 0), np.int64)

    def batch_of(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        width = 2 if most is None else 3
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)[:width]], names=["a", "b", "n"][:width])

    def of(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not rows.shape[1]:
            return
        rows = rows[:, np.append(True, (np.diff(rows[0]) != 0) | (np.diff(rows[2]) != 0))]  # without equal texts of other tasks
        gram, root = rows[0], rows[1]
        starts = np.flatnonzero(np.diff(gram, prepend=gram[0] ^ 1))
        ends = np.append(starts[1:], len(gram))
        several = root[starts] != root[ends - 1]
        if most is not None:
            runs = np.flatnonzero((np.diff(gram, prepend=gram[0] ^ 1) != 0) | (np.diff(root, prepend=root[0] ^ 1) != 0))
            alike = np.add.reduceat(np.diff(np.append(runs, len(gram))) ** 2, np.searchsorted(runs, starts))
            members = ends - starts
            crowded = members**2 - alike > 2 * most * members
            if crowded.any():
                yield batch_of(gram[starts[crowded]], gram[starts[crowded]], members[crowded])
                them = np.unique(rows[2, np.repeat(crowded, members)])
                yield batch_of(them, them, np.full(len(them), -1))
            several &= ~crowded
        found = [p for i, j in zip(starts[several].tolist(), ends[several].tolist()) for p in bucket_pairs(*rows[1:4, i:j], min_similarity, *rows[4:, i:j])]
        if found:
            a, b = map(np.concatenate, zip(*found))
            yield batch_of(a, b, np.zeros(len(a), np.int64))

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns[:5]])
        if batch.num_columns > 5:
            rows = np.concatenate((rows, np.frombuffer(b"".join(batch.column(5).to_pylist()), np.int64).reshape(batch.num_rows, -1).T))
        held = np.concatenate((held, rows), axis=1) if held.shape[1] else rows
        if held[0, 0] == held[0, -1]:
            continue
        cut = np.searchsorted(held[0], held[0, -1])  # the last bucket may go on
        yield from of(held[:, :cut])
        held = held[:, cut:]
    yield from of(held)


def _later(frequent: tuple[np.ndarray, np.ndarray], grams: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles and others, in order, each as often as it was found at most."""
    every, back = np.unique(np.concatenate((frequent[0], grams)), return_inverse=True)
    most = np.zeros(len(every), np.int64)
    np.maximum.at(most, back, np.concatenate((frequent[1], times)))
    return every, most


def missed_links(docs: DataFrame, groups: DataFrame, n_texts: int, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """(u, v): all pairs of different groups with at least this Jaccard coefficient. groups: u, v, a text's hash and its group's, where they differ; stored."""
    grams, times = _frequent(docs, n_texts)
    frequent, groups = (grams, times * max(1, n_texts // SAMPLE)), common.small(groups.withColumnRenamed("u", "key"))
    texts, found, name = docs, [], "missed"
    for turn in range(AGAIN + 1):
        most = CROWDED if turn < AGAIN else None

        def of(batches: Iterator[pa.RecordBatch], most: int | None = most) -> Iterator[pa.RecordBatch]:
            return _pairs(batches, min_similarity, most)

        members = _leading(texts, min_similarity, frequent, turn > 0).join(groups, "key", "left")
        members = members.select("gram", F.coalesce("v", "key").alias("root"), "key", "size", "left", *["sketch"] * (turn > 0)).repartition("gram").sortWithinPartitions("gram", "root", "key")
        met = members.mapInArrow(of, "a long, b long" + ", n long" * (most is not None))
        met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(0).cast("long").alias("n") if most is None else "n").distinct()
        met, name = common.stored(met, name), "missed_again"
        found.append(met.where("n = 0").select("a", "b"))
        crowded = met.where("n > 0").orderBy(F.desc("n"), "a").limit(FREQUENT).toPandas()
        if crowded.empty:
            break
        frequent = _later(frequent, crowded["a"].to_numpy(np.int64).view(np.uint64), crowded["n"].to_numpy(np.int64))
        again = common.small(common.stored(met.where("n = -1").select(F.col("a").alias("text_key")), "crowded"))
        texts = docs.select(_key("text").alias("text_key"), "text").join(again, "text_key", "left_semi")
    pairs = found[0] if len(found) == 1 else common.stored(reduce(DataFrame.unionByName, found).distinct(), "all_missed")
    return _verified(docs, _near(docs, pairs, min_similarity), min_similarity)


def deduplicate(docs: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """One row of each group of near copies; columns as in docs."""
    rows = common.stored(_fingerprints(docs), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id"), F.col("text_key"))
    distinct = common.stored(rows.groupBy("text_key").agg(F.min(order).alias("first"), F.min("fp").alias("fp")), "distinct")
    common.discard(rows)
    groups = components(similar_texts(docs, distinct.select("text_key", "fp"), min_similarity))
    missed = missed_links(docs, groups, distinct.count(), min_similarity)
    if not missed.isEmpty():
        groups = components(groups.unionByName(missed))
    groups = groups.withColumnRenamed("u", "text_key").withColumnRenamed("v", "root")
    kept = distinct.select("text_key", "first").join(common.small(groups), "text_key", "left").groupBy(F.coalesce("root", "text_key").alias("root")).agg(F.min("first").alias("first"))
    kept = kept.select(*_row_key(F.col("first.doc_id"), F.col("first.text_key")))
    # rows equal in doc_id and text are one before they are shuffled; the join finds them where the grouping has put them
    first = common.packed(docs).select("row", *_row_key(F.col("row.doc_id"), _key("row.text"))).dropDuplicates(["_none", "_id", "_text_key"])
    return first.join(kept, ["_none", "_id", "_text_key"]).select(*common.unpacked(docs.columns))


def _row_key(doc_id: Column, text_key: Column) -> list[Column]:
    """Columns without NULLs, so that a plain join compares them."""
    return [doc_id.isNull().alias("_none"), F.coalesce(doc_id.cast("string"), F.lit("")).alias("_id"), text_key.alias("_text_key")]
