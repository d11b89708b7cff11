"""Hard-negative mining by bit-sliced integer products.

Components are integers, floor(scale * x); the score of a row is its inner product with an anchor. Rows are packed,
some thousands together, into blocks that hold their components as bit planes of two's complement, most significant
first. A block is searched for a block of anchors plane by plane: after each plane the score of every pair lies in an
interval, whose width halves, and pairs go whose interval cannot qualify: it ends below the score of the last of the
best found so far, or outside the window of wanted scores. While most pairs are alive a plane is one product of
matrices; the rest goes on as a list of pairs. What is left after the last plane has exact scores.

Two searches are made of all blocks for the stated anchors: one for the best rows of the anchor's own label, the positives,
one for the best rows of other labels in the window that each positive sets. Blocks of anchors meet blocks of rows in a
block-wise product; a task keeps the best of one block of anchors over all its rows, so that what leaves it are
`k` entries an anchor, whatever the number of rows.

Defined results: rows with a null label, vec_id or vector, or with a null or non-finite component take no part, nor do
rows whose integer vector's squared length is over 2^62 (their scores exceed a long). A shorter vector is filled up with
zeros, an empty one scores 0. Repeated rows are rows of their own: each is an anchor, and a positive of its twin. Ties go to the smaller vec_id.
An anchor without positives, and a positive without a negative in its window, gives no row. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows and components of a block at most, and anchors of a block of anchors.
BLOCK_ROWS, BLOCK_CELLS, ANCHORS = 4096, 1 << 20, 256
#: Rows searched together; the first are few, so that the best found so far are known early.
STEPS = (64, 256, 1024)
#: Pairs go on as a list once at most this share of them is alive.
SPARSE = 1 / 16
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

BLOCK = "n int, dim int, planes int, bits binary, row_no binary, vec_id binary, label binary"
ANCHOR_BLOCK = "a_block long, a_n int, a_dim int, a_x binary, a_row_no binary, a_label binary, a_low binary, a_high binary"


def integer_vectors(vectors: DataFrame, label: Column | None = None, scale: int = 256) -> DataFrame:
    """row_no (unique), vec_id, label and x, the integer components, of the rows that take part. vectors: vec_id, embedding, label."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda c: F.floor(c * scale))
    finite = F.forall(F.col("embedding").cast("array<double>"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    length = F.aggregate(F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("double")), F.lit(0.0), lambda a, c: a + c * c)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & (length <= float(1 << 62)))
    return rows.select(F.monotonically_increasing_id().alias("row_no"), F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), x.alias("x"))


def _matrix(lists: pa.ListArray, rest: int = 0) -> np.ndarray:
    """The lists as rows of a matrix, filled up with `rest`."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.full((len(lists), max(int(sizes.max(initial=0)), 1)), rest, np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _widened(x: np.ndarray, dim: int) -> np.ndarray:
    return x if x.shape[1] == dim else np.pad(x, ((0, 0), (0, dim - x.shape[1])))


def bit_planes(x: np.ndarray) -> tuple[int, bytes]:
    """The number of planes and their bits, most significant (the sign) first, each with a row for a component and a bit for a row of x."""
    planes = int(max(int(x.max(initial=0)), -int(x.min(initial=0)) - 1, 0)).bit_length() + 1
    return planes, b"".join(np.packbits(((x >> j) & 1).astype(bool).T, axis=1).tobytes() for j in reversed(range(planes)))


def _plane(bits: bytes, j: int, planes: int, n: int, dim: int, kind: type) -> np.ndarray:
    size = dim * -(-n // 8)
    packed = np.frombuffer(bits, np.uint8, size, (planes - 1 - j) * size).reshape(dim, -1)
    return np.unpackbits(packed, axis=1, count=n).astype(kind)


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch["x"])
        row_no, ids, labels = (batch[c].to_numpy() for c in ("row_no", "vec_id", "label"))
        size = max(1, min(BLOCK_ROWS, BLOCK_CELLS // x.shape[1]))
        order = np.argsort(labels, kind="stable")
        for at in range(0, len(order), size):
            own = order[at : at + size]
            planes, bits = bit_planes(x[own])
            values = {"n": len(own), "dim": x.shape[1], "planes": planes, "bits": bits, "row_no": row_no[own].tobytes(), "vec_id": ids[own].tobytes(), "label": labels[own].tobytes()}
            yield pa.RecordBatch.from_pylist([values], pa.schema([("n", pa.int32()), ("dim", pa.int32()), ("planes", pa.int32()), *[(c, pa.binary()) for c in ("bits", "row_no", "vec_id", "label")]]))


def _to_anchor_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of anchors; low and high hold the windows of an anchor, one after the other; missing ones are closed."""
    kinds = [("a_block", pa.int64()), ("a_n", pa.int32()), ("a_dim", pa.int32()), *[(c, pa.binary()) for c in ("a_x", "a_row_no", "a_label", "a_low", "a_high")]]
    for batch in batches:
        if not batch.num_rows:
            continue
        x, low, high = _matrix(batch["x"]), _matrix(batch["low"], MOST), _matrix(batch["high"], LEAST)
        row_no, labels = batch["row_no"].to_numpy(), batch["label"].to_numpy()
        order = np.argsort(labels, kind="stable")
        for at in range(0, len(order), ANCHORS):
            own = order[at : at + ANCHORS]
            parts = {"a_x": x, "a_row_no": row_no, "a_label": labels, "a_low": low, "a_high": high}
            yield pa.RecordBatch.from_pylist([{"a_block": row_no[own[0]], "a_n": len(own), "a_dim": x.shape[1]} | {c: v[own].tobytes() for c, v in parts.items()}], pa.schema(kinds))


class Search:
    """The best k rows so far for each window of each anchor of one block of anchors."""

    def __init__(self, block: dict, k: int, same_label: bool) -> None:
        n = block["a_n"]
        read = lambda c: np.frombuffer(block[c], np.int64).reshape(n, -1)
        self.key, self.k, self.same = block["a_block"], k, same_label
        self.x, self.row_no, self.labels = read("a_x"), read("a_row_no")[:, 0], read("a_label")[:, 0]
        self.low, self.high = read("a_low"), read("a_high")
        shape = (*self.low.shape, k)
        self.scores, self.ids = np.full(shape, LEAST), np.full(shape, MOST)

    def least(self) -> np.ndarray:
        """The score from which a row can still enter, by anchor and window; equal ones enter by a smaller vec_id."""
        return np.maximum(self.low, self.scores[:, :, -1])

    def visit(self, block: dict) -> None:
        n = block["n"]
        read = lambda c: np.frombuffer(block[c], np.int64)
        labels, row_no, ids = read("label"), read("row_no"), read("vec_id")
        dim = max(block["dim"], self.x.shape[1])
        x = _widened(self.x, dim)
        size = int(np.abs(x).sum(1).max()) << block["planes"]  # no sum of planes is larger
        kind = np.float32 if size < 1 << 24 else np.float64 if size < 1 << 53 else np.int64
        planes = []
        for j in reversed(range(block["planes"])):
            plane = _plane(block["bits"], j, block["planes"], n, block["dim"], kind)
            planes.append((j, -(1 << j) if j == block["planes"] - 1 else 1 << j, np.pad(plane, ((0, dim - block["dim"]), (0, 0)))))
        if self.same:  # both sides are sorted by label
            pieces = [(np.searchsorted(self.labels, [v, v + 1]), np.searchsorted(labels, [v, v + 1])) for v in np.intersect1d(self.labels, labels)]
        else:
            pieces = [((0, len(x)), (0, n))]
        for (a, b), (start, end) in pieces:
            steps = iter(STEPS)
            step = next(steps)
            while start < end:
                to = min(start + step, end)
                allowed = row_no[None, start:to] != self.row_no[a:b, None]
                if not self.same:
                    allowed &= labels[None, start:to] != self.labels[a:b, None]
                q, r, s = self._pairs(x[a:b], slice(a, b), [(j, w, p[:, start:to]) for j, w, p in planes], allowed, kind, size < 1 << 53)
                self._enter(q + a, s, ids[start + r])
                start, step = to, next(steps, step)

    def _pairs(self, x: np.ndarray, own: slice, planes: list, allowed: np.ndarray, kind: type, bounded: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, row and exact score of the pairs that may enter."""
        least, most = self.least()[own], self.high[own]
        down, up = np.minimum(x, 0).sum(1), np.maximum(x, 0).sum(1)  # of all lower planes together, times 2^j - 1
        first, last = least.min(1)[:, None], most.max(1)[:, None]
        ints, sums = x.astype(kind), np.zeros(allowed.shape, kind)
        pairs = None
        for j, weight, plane in planes:
            rest = (1 << j) - 1
            if pairs is None:
                sums += weight * (ints @ plane)
                if not (bounded or j == 0):  # sums can leave the long in between; the last is right
                    continue
                alive = allowed & (sums + (rest * up)[:, None] >= first) & (sums + (rest * down)[:, None] <= last)
                if j == 0 or np.count_nonzero(alive) <= SPARSE * alive.size:
                    q, r = np.nonzero(alive)
                    pairs = q, r, sums[q, r].astype(np.int64)
            else:
                q, r, s = pairs
                s = s + weight * np.einsum("nd,nd->n", ints[q], plane.T[r]).astype(np.int64)
                keep = ((s + rest * up[q])[:, None] >= least[q]) & ((s + rest * down[q])[:, None] <= most[q])
                keep = keep.any(1)
                pairs = q[keep], r[keep], s[keep]
        return pairs

    def _enter(self, q: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
        fits = (s[:, None] >= self.least()[q]) & (s[:, None] <= self.high[q])
        pair, window = np.nonzero(fits)
        if not len(pair):
            return
        slots = self.low.shape[1]
        slot = q[pair] * slots + window
        touched = np.unique(slot)
        old_s, old_ids = self.scores.reshape(-1, self.k)[touched], self.ids.reshape(-1, self.k)[touched]
        slot = np.concatenate([slot, np.repeat(touched, self.k)])
        s, ids = np.concatenate([s[pair], old_s.ravel()]), np.concatenate([ids[pair], old_ids.ravel()])
        order = np.lexsort((ids, ~s, slot))
        slot, s, ids = slot[order], s[order], ids[order]
        nth = np.arange(len(slot)) - np.searchsorted(slot, slot)
        best = nth < self.k
        self.scores.reshape(-1, self.k)[slot[best], nth[best]] = s[best]
        self.ids.reshape(-1, self.k)[slot[best], nth[best]] = ids[best]

    def found(self) -> pa.RecordBatch:
        a, window, nth = np.nonzero(self.scores != LEAST)
        columns = [self.row_no[a], window.astype(np.int32), self.ids[a, window, nth], self.scores[a, window, nth]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row_no", "nth", "vec_id", "score"])


def _searched(k: int, same_label: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i].as_py() for c in batch.schema.names}
                if search is None or search.key != row["a_block"]:
                    if search is not None:
                        yield search.found()
                    search = Search(row, k, same_label)
                search.visit(row)
        if search is not None:
            yield search.found()

    return run


def best_rows(anchors: DataFrame, blocks: DataFrame, k: int, same_label: bool) -> DataFrame:
    """row_no, nth, rank, vec_id, score: for the nth window of each anchor the k best rows, of its own or of other labels.

    anchors: row_no, label, x, and low and high, arrays of the windows' ends. The block-wise product is of this stated query set with all rows.
    """
    asked = anchors.select("row_no", "label", "x", "low", "high").mapInArrow(_to_anchor_blocks, ANCHOR_BLOCK)
    met = asked.hint("shuffle_replicate_nl").crossJoin(blocks)
    found = met.mapInArrow(_searched(k, same_label), "row_no long, nth int, vec_id long, score long")
    order = Window.partitionBy("row_no", "nth").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 10, low: int = 3, high: int = 9, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, embedding, label. anchor: which rows are anchors; label: the label to use in place of `label`.
    Negatives score from low to high tenths of the positive's score.
    """
    rows = common.stored(integer_vectors(vectors, label, scale), "integer_vectors")
    blocks = common.stored(rows.mapInArrow(_to_blocks, BLOCK), "bit_sliced")
    whole = [F.array(F.lit(int(end))).alias(name) for name, end in (("low", LEAST), ("high", MOST))]
    anchors = common.stored(rows.where(anchor), "anchors")
    own = best_rows(anchors.select("*", *whole), blocks, positives, True)
    # tenths of a score, rounded inwards without leaving the long; a negative score has no window
    ends = {"low": f"CASE WHEN score < 0 THEN {MOST} ELSE (score div 10) * {low} + (score % 10 * {low} + 9) div 10 END", "high": f"CASE WHEN score < 0 THEN {-MOST} ELSE (score div 10) * {high} + (score % 10 * {high}) div 10 END"}
    own = own.withColumns({c: F.expr(e).cast("long") for c, e in ends.items()})
    own = own.groupBy("row_no").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score", "low", "high"))).alias("own"))
    asked = common.stored(anchors.join(own, "row_no").select("row_no", "vec_id", "label", "x", "own", F.col("own.low").alias("low"), F.col("own.high").alias("high")), "windows")
    found = best_rows(asked, blocks, negatives, False).withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score")
    joined = found.join(asked.select("row_no", F.col("vec_id").alias("anchor_id"), "own"), "row_no").withColumn("p", F.get("own", F.col("nth")))
    return joined.select("anchor_id", F.col("p.vec_id").alias("positive_id"), "rank", "negative_id", F.col("p.score").alias("positive_score"), "negative_score")


def mining_report(vectors: DataFrame) -> DataFrame:
    """Negatives for the rows whose vec_id is divisible by 100, with the labels of those divisible by 7 moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, moved)


def oracle_sql() -> str:
    """All pairs of an anchor and another row, by brute force."""
    return """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i]))::BIGINT AS score
        FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER w::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 10
    """
