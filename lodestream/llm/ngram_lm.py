"""N-gram language model scoring with Elias-Fano tries.

Training counts n-grams with Spark; words are known by the XXH64 of their lower-cased bytes. Level 1 holds
all words in hash order, so that a word's id is its rank: the hashes and the running sums of the counts are
Elias-Fano sequences. Level n holds, for every n-1-gram that is followed often enough, its
successors: the successor lists of a range of contexts stand one after the other in one Elias-Fano sequence, each list
raised by the last value of the list before it; a monotone sequence of pointers tells where a list begins. A
successor is found by a search for its id, relative to its context, between two pointers. With it stands its discounted
probability, and with each context the mass left for the shorter context, both as 16-bit logarithms.

    P(w | c) = max(n(c w) - D, 0) / n(c) + rest(c) P(w | c without its first word)

P(w) is the add-one estimate. n-grams of two and more words that occur less than min_count times are not listed (the registered
query has min_count = 1 and lists all); their mass is part of rest(c). An n-gram can only occur so often if its parts
do, so only such are counted.

Texts are read twice: to count the words, and to write each document as its words' ids, a table from which the
n-grams are counted and the documents scored.

Levels are cut into parts, level 1 of about PART entries by ranges of the hash, the others by ranges of (context,
word) that hold about PART tokens each: how often contexts and words occur is known from the level before, so a
pair's place is the tokens of earlier contexts, plus its own context's times the share of earlier words. The
successors of a very frequent context so spread over parts. Counted n-grams are shuffled as one row for each chunk
and part. The mass of the few contexts at the parts' ends is summed on the driver. Each part is a file
in the shared folder, written under a name of its own by the task that builds it and known to the model only once
that task has succeeded; scoring tasks map the files into memory.

Defined results: a very long text is one row in one task, its words an array of ids; a null or blank text is the end token alone; a null doc_id counts as empty text for the split; equal
rows score alike; with no training documents every token has probability 1. Other columns are ignored.
"""

from __future__ import annotations

import json
import math
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .elias_fano import EliasFano

SEED, FOLDS, HELD_OUT = 42, 7, 2
DISCOUNT, MIN_COUNT = 0.75, 2
PART = 1 << 20
#: Tokens handled at once; a longer document is handled whole.
CHUNK = 1 << 19
#: Bytes of text split into words at once; a longer text is split whole.
SLICE = 6 * CHUNK
#: Hashed words kept by a task.
KNOWN_WORDS = 1 << 20
#: Steps of the stored logarithms: 4096 a decade, over sixteen decades.
STEPS = 4096.0


@dataclass(frozen=True)
class Level:
    """Parts in order: file, and the number of entries and of tokens before them; but for words, first context and word.

    `shared`: contexts at the ends of parts, whose entries several parts may hold, with their rest.
    """

    paths: tuple[str, ...]
    firsts: tuple[int, ...]
    tokens: tuple[int, ...]
    entries: int
    first_pairs: tuple[tuple[int, int], ...] = ()
    shared: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.uint16))


@dataclass(frozen=True)
class Model:
    words: Level
    tokens: int
    docs: int
    levels: tuple[Level, ...] = field(default=())

    @property
    def end(self) -> int:
        """Id of the end token; as a context, of the beginning."""
        return self.words.entries

    def floor_mass(self) -> int:
        """N + 1 * (V + 1), where V includes the end token."""
        return self.tokens + self.words.entries + (self.docs > 0) + 1


# ---------------------------------------------------------------- files


def write_arrays(folder: str, name: str, arrays: dict[str, np.ndarray]) -> str:
    """Write arrays to one file of a new name; returns its URI."""
    uri = f"{folder}/{name}-{uuid.uuid4().hex}"
    fs, path = pa.fs.FileSystem.from_uri(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    heads, at = {}, 0
    for key, array in arrays.items():
        heads[key] = [array.dtype.str, at, len(array)]
        at += -(-array.nbytes // 8) * 8
    head = json.dumps(heads).encode()
    head += b" " * (-len(head) % 8)
    with fs.open_output_stream(path) as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for array in arrays.values():
            out.write(array.tobytes() + bytes(-array.nbytes % 8))
    return uri


_open: dict[str, dict[str, np.ndarray]] = {}


def map_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped; a file of a remote store is copied once and unlinked when mapped."""
    if uri not in _open:
        fs, path = pa.fs.FileSystem.from_uri(uri)
        local = path
        if not isinstance(fs, pa.fs.LocalFileSystem):
            handle, local = tempfile.mkstemp()
            with os.fdopen(handle, "wb") as out, fs.open_input_stream(path) as source:
                while block := source.read(1 << 22):
                    out.write(block)
        data = np.asarray(np.memmap(local, dtype=np.uint8, mode="r"))  # slices of a plain view are cheaper
        if local != path:
            os.unlink(local)
        start = 8 + int.from_bytes(data[:8].tobytes(), "little")
        heads = json.loads(data[8:start].tobytes())
        _open[uri] = {k: data[start + at : start + at + n * np.dtype(kind).itemsize].view(kind) for k, (kind, at, n) in heads.items()}
    return _open[uri]


_sequences: dict[tuple[str, str], EliasFano] = {}


def _sequence(uri: str, name: str) -> EliasFano:
    if (uri, name) not in _sequences:
        arrays = map_arrays(uri)
        _sequences[uri, name] = EliasFano.from_arrays({k: arrays[f"{name}.{k}"] for k in ("low", "high", "ones", "shape")})
    return _sequences[uri, name]


def _named(name: str, sequence: EliasFano) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": v for k, v in sequence.arrays().items()}


def quantised(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(x, 1e-15)) * STEPS), 0, 65535).astype(np.uint16)


RESTORED = 10.0 ** (np.arange(1 << 16) / -STEPS)


def restored(q: np.ndarray) -> np.ndarray:
    return RESTORED[q]


# ---------------------------------------------------------------- tokens


class _Hashes(dict):
    """Hash of each word, computed when first met; forgotten when there are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, SEED)
        return found


_hashes = _Hashes()


def token_hashes(text: str | None) -> np.ndarray:
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of the distinct words of texts, the place among them of each token, and the tokens of each text (null: none)."""
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    tokens = split.flatten().dictionary_encode()
    distinct, codes, lengths = _each(tokens.dictionary.cast(pa.binary())), tokens.indices.to_numpy(), pc.list_value_length(split).to_numpy()
    if b"" in distinct:  # all that a blank text is split into
        blank = distinct.index(b"")
        lengths = lengths - np.bincount(np.repeat(np.arange(len(lengths)), lengths)[codes == blank], minlength=len(lengths))
        codes = codes[codes != blank]
        codes = codes - (codes > blank)
        del distinct[blank]
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in distinct), np.uint64, len(distinct))
    return hashes, codes, lengths.astype(np.int64)


def _each(values: pa.BinaryArray) -> list[bytes]:
    """The values of an array without nulls, in a fraction of the time of to_pylist."""
    if not len(values):
        return []
    _, ends, data = values.buffers()
    ends, data = np.frombuffer(ends, np.int32)[values.offset : values.offset + len(values) + 1].tolist(), data.to_pybytes() if data else b""
    return [data[i:j] for i, j in zip(ends, ends[1:])]


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Rows with about SLICE bytes of text in the column together."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(upto // SLICE)) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(i, j - i) for i, j in zip(cuts, cuts[1:]) if i < j)


def _chunks(batches: Iterator[pa.RecordBatch], column: int, read: Callable, chunk: int = CHUNK) -> Iterator[tuple[list[tuple], list[np.ndarray]]]:
    """(other columns' rows, arrays read from the column) of documents with about `chunk` tokens together."""
    rows, tokens, n = [], [], 0
    for batch in batches:
        others = zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns) if i != column]) if batch.num_columns > 1 else iter([()] * batch.num_rows)
        for row, value in zip(others, batch.column(column)):
            own = read(value.as_py())
            rows.append(row)
            tokens.append(own)
            n += len(own) + 1
            if n >= chunk:
                yield rows, tokens
                rows, tokens, n = [], [], 0
    if rows:
        yield rows, tokens


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % FOLDS == HELD_OUT


# ---------------------------------------------------------------- look-ups


def word_ids(model: Model, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids (-1: unknown) and counts of words."""
    ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
    level = model.words
    if not level.entries:
        return ids, counts
    bits = (len(level.paths) - 1).bit_length()
    part = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    rest = hashes & ((np.uint64(1) << np.uint64(64 - bits)) - np.uint64(1)) if bits else hashes
    for p, own in _by_part(part):
        if level.paths[p]:
            at = _sequence(level.paths[p], "hash").find(rest[own])
            hit = at >= 0
            ids[own[hit]] = at[hit] + level.firsts[p]
            counts[own[hit]] = _run_lengths(_sequence(level.paths[p], "count"), at[hit])
    return ids, counts


def running(model: Model, depth: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens before each of a level's entries, and its own. Of words (depth 1), the end's id stands last."""
    level = model.words if depth == 1 else model.levels[depth - 2]
    before, own = np.full(len(ids), model.tokens - model.docs, np.int64), np.full(len(ids), model.docs, np.int64)
    part = np.searchsorted(np.array(level.firsts), ids, side="right") - 1
    for p, at in _by_part(np.where(ids == model.end, -1, part) if depth == 1 else part):
        if p >= 0:
            local = ids[at] - level.firsts[p]
            lo, hi = np.split(_sequence(level.paths[p], "count").get(np.concatenate((local, local + 1))).astype(np.int64), 2)
            before[at], own[at] = lo + level.tokens[p], hi - lo
    return before, own


def counts_of(model: Model, ids: np.ndarray) -> np.ndarray:
    """Counts of word ids; the end's id as a context is the beginning, which every document has."""
    return running(model, 1, ids)[1]


def _run_lengths(sums: EliasFano, at: np.ndarray) -> np.ndarray:
    """Differences of neighbours in a sequence of running sums that begins with 0."""
    both = sums.get(np.concatenate((at, at + 1))).astype(np.int64)
    return both[len(at) :] - both[: len(at)]


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(part):
        return
    if part[0] == part[-1] and (part == part[0]).all():
        yield int(part[0]), np.arange(len(part))
        return
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for own in np.split(order, cuts):
        yield int(part[own[0]]), own


def successors(level: Level, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Global index (-1: not listed), listed probability (0: none) and the context's rest, for each pair.

    Pairs repeat, and sorted look-ups read the level in order: each distinct pair is looked up once.
    """
    context, word, _, back = _distinct_pairs(context, word, True)
    return tuple(found[back] for found in _sorted_successors(level, context, word))


def _distinct_pairs(context: np.ndarray, word: np.ndarray, places: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """The distinct pairs in order, how often each occurs, and with `places` where each of the given pairs is among them."""
    radix = int(word.max(initial=0)) + 2
    wide = int(context.max(initial=0) + 1) * radix >= 1 << 63
    codes, contexts = pd.factorize(context, sort=True) if wide else (None, None)
    keys = (codes.astype(np.int64) if wide else context) * radix + (word + 1)
    back = None
    if places:
        order = np.argsort(keys)
        keys = keys[order]
    else:
        keys = np.sort(keys)
    fresh = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    if places:
        back = np.empty(len(keys), np.int64)
        back[order] = np.cumsum(fresh) - 1
    starts = np.flatnonzero(fresh)
    n = np.diff(np.append(starts, len(keys)))
    keys = keys[starts]
    context = keys // radix
    word = keys - context * radix - 1
    return contexts[context] if wide else context, word, n, back


def _in_parts(level: Level, context: np.ndarray, word: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each part, which of the sorted pairs are not before its first pair, nor behind the next one's."""
    if not len(level.paths):
        return
    first = np.array([c for c, _ in level.first_pairs], np.int64)
    cuts = np.searchsorted(context, first, side="left")
    for p in np.flatnonzero(cuts < np.searchsorted(context, first, side="right")):
        end = np.searchsorted(context, first[p], side="right")
        cuts[p] += np.searchsorted(word[cuts[p] : end], level.first_pairs[p][1])
    ends = np.append(cuts[1:], len(context))
    for p in np.flatnonzero(cuts < ends).tolist():
        yield p, np.arange(cuts[p], ends[p])


def _sorted_successors(level: Level, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    index, listed, rest = np.full(len(context), -1, np.int64), np.zeros(len(context)), np.ones(len(context))
    for p, own in _in_parts(level, context, word):
        arrays = map_arrays(level.paths[p])
        first, n = arrays["span"].tolist()
        # what belongs to a context is read once for its run of pairs
        starts = np.flatnonzero(np.diff(context[own], prepend=-1))
        lengths = np.diff(np.append(starts, len(own)))
        local = context[own[starts]] - first
        inside = local < n
        local = np.where(inside, local, 0)
        codes = np.where(inside, arrays["rest"][local], 0)
        rest[own] = np.repeat(restored(codes), lengths)
        some = np.flatnonzero(codes > 0)  # a context with successors leaves less than all
        pointers, values = _sequence(level.paths[p], "pointer"), _sequence(level.paths[p], "successor")
        lo, hi = np.split(pointers.get(np.concatenate((local[some], local[some] + 1))).astype(np.int64), 2)
        base = np.zeros(len(lo), np.uint64)
        late = lo > 0
        base[late] = values.get(lo[late] - 1) + np.uint64(1)
        within = np.repeat(codes > 0, lengths)
        own, lengths = own[within], lengths[some]
        at = values.find(np.repeat(base, lengths) + word[own].astype(np.uint64), np.repeat(lo, lengths), np.repeat(hi, lengths))
        hit = np.flatnonzero(at >= 0)
        index[own[hit]] = at[hit] + level.firsts[p]
        listed[own[hit]] = restored(arrays["prob"][at[hit]])
    contexts, codes = level.shared
    if len(contexts):
        at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
        hit = np.flatnonzero(contexts[at] == context)
        rest[hit] = restored(codes[at[hit]])
    return index, listed, rest


def _laid_out(model: Model, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids and previous ids of all tokens, ends included, and the number of tokens of each document."""
    lengths = np.array([len(t) + 1 for t in docs])
    ids = np.full(int(lengths.sum()), model.end, np.int64)
    inner = np.ones(len(ids), bool)
    inner[np.cumsum(lengths) - 1] = False
    ids[inner] = np.concatenate(docs)
    return ids, np.concatenate(([model.end], ids[:-1])), lengths  # what follows an end follows a beginning


def contexts_of(model: Model, ids: np.ndarray, before: np.ndarray, depth: int, prob: np.ndarray | None = None) -> list[np.ndarray]:
    """For level 2, 3, ... up to `depth` the id of each token's context there, -1 where the level has none.

    prob, the probabilities without a context, is raised in place to those of the whole model (which has `depth` levels).
    """
    out = [before]
    for n in range(depth if prob is not None else depth - 1):
        here = out[-1]
        asked = np.flatnonzero(here >= 0) if prob is not None else np.flatnonzero((here >= 0) & (ids >= 0) & (ids != model.end))
        index, listed, rest = successors(model.levels[n], here[asked], ids[asked])
        if prob is not None:
            prob[asked] = listed + rest * prob[asked]
        grams = np.full(len(ids), -1, np.int64)
        grams[asked] = np.where(ids[asked] == model.end, -1, index)
        out.append(np.concatenate(([-1], grams[:-1])))
    return out


# ---------------------------------------------------------------- training


def _parts(entries: int) -> int:
    """A power of two, so that parts of level 1 are ranges of the hash's leading bits."""
    return 1 << max(0, (-(-entries // PART) - 1).bit_length())


def _read_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, np.int32)


def _train_words(texts: DataFrame, folder: str) -> tuple[Level, int]:
    def merged(found: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        codes, distinct = pd.factorize(np.concatenate(found))
        sums = np.bincount(codes, np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(sums)], names=["h", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, counts = [], []
        for batch in _slices(batches, 0):
            hashes, codes, _ = _words(batch.column(0))
            found.append(hashes)
            counts.append(np.bincount(codes, minlength=len(hashes)))
            if sum(map(len, found)) >= KNOWN_WORDS:
                yield merged(found, counts)
                found, counts = [], []
        if found:
            yield merged(found, counts)

    counts = common.stored(texts.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "words")
    entries, tokens = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = _parts(entries)
    bits = parts.bit_length() - 1

    def build(rows: pa.Table) -> pa.Table:
        h, n = rows.column("h").to_numpy().view(np.uint64), rows.column("n").to_numpy()
        h = h & ((np.uint64(1) << np.uint64(64 - bits)) - np.uint64(1)) if bits else h
        order = np.argsort(h)
        sums = np.concatenate(([0], np.cumsum(n[order])))
        path = write_arrays(folder, "words", _named("hash", EliasFano.of(h[order])) | _named("count", EliasFano.of(sums)))
        return pa.table({"part": rows.column("part")[:1], "path": [path], "entries": pa.array([len(h)], pa.int64()), "tokens": pa.array(sums[-1:])})

    part = F.shiftrightunsigned("h", 64 - bits).cast("long") if bits else F.lit(0).cast("long")
    made = common.stored(counts.withColumn("part", part).groupBy("part").applyInArrow(build, "part long, path string, entries long, tokens long"), "word_parts")
    level = _level(made, parts)
    common.discard(counts)
    return level, tokens


def _before(sizes: list[int]) -> tuple[int, ...]:
    return tuple(np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(int).tolist()) if sizes else ()


def _level(made: DataFrame, parts: int) -> Level:
    """Level 1: the parts' files; their number is entries / PART, a few bytes each."""
    found = {r["part"]: r for r in made.collect()}
    paths, entries, tokens = ([found[p][k] if p in found else none for p in range(parts)] for k, none in (("path", ""), ("entries", 0), ("tokens", 0)))
    return Level(tuple(paths), _before(entries), _before(tokens), sum(entries))


def _encoded(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, ids (32-bit word ids, -1: unknown), n_known and base_score of every row: a stored table."""
    end = math.log10((model.docs + 1) / model.floor_mass()) if model.docs else math.log10(1 / model.floor_mass())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 2):
            hashes, codes, lengths = _words(batch.column(2))
            ids, counts = word_ids(model, hashes)
            ids, base = ids.astype(np.int32)[codes], np.log10((counts + 1) / model.floor_mass())[codes]
            stops = np.cumsum(lengths)
            hits = np.concatenate(([0], np.cumsum(ids >= 0)))
            ends = np.concatenate(([0], 4 * stops)).astype(np.int32)
            arrays = [
                batch.column(0),
                batch.column(1),
                pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(ids)]),
                pa.array(hits[stops] - hits[stops - lengths] + (model.docs > 0)),
                pa.array([float(base[stop - n : stop].sum()) + end for stop, n in zip(stops.tolist(), lengths.tolist())], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "ids", "n_known", "base_score"])

    if model.words.entries >= 1 << 31:
        raise ValueError("more than 2**31 distinct words")
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text")
    return common.stored(source.mapInArrow(encode, f"doc_id {kind}, held_out boolean, ids binary, n_known long, base_score double"), "encoded")


def _train_level(encoded: DataFrame, model: Model, folder: str, more: bool, min_count: int) -> Level:
    """The level after the last of the model; `more`: another one follows. encoded: the training documents."""
    depth = len(model.levels) + 1
    parts = _parts(max(1, model.tokens))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, docs in _chunks(batches, 0, _read_ids):
            ids, before, _ = _laid_out(model, docs)
            context = contexts_of(model, ids, before, depth)[-1]
            ok = np.flatnonzero((ids >= 0) & (context >= 0))
            context, word, n, _ = _distinct_pairs(context[ok], ids[ok], False)
            codes, words = pd.factorize(word)
            share = (running(model, 1, words)[0] / model.tokens)[codes]
            starts = np.flatnonzero(np.diff(context, prepend=-1))
            earlier, own = (np.repeat(x, np.diff(np.append(starts, len(context)))) for x in running(model, depth, context[starts]))
            part = np.minimum((earlier + own * share) * (parts / model.tokens), parts - 1).astype(np.int64)
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            ends = np.append(cuts[1:], len(part)).tolist()
            word, steps = word.astype(np.int32), np.diff(context, prepend=0)
            steps[cuts] = 0  # a row's contexts are its first one and steps from there
            columns = [pa.array([_bytes(x[i:j], small) for i, j in zip(cuts.tolist(), ends)], pa.binary()) for x, small in ((steps, np.uint32), (word, np.int32), (n, np.uint8))]
            sizes = pa.array(np.diff(np.append(cuts, len(part))))
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts]), pa.array(context[cuts]), sizes, *columns], names=["part", "first", "size", "c", "w", "n"])

    def build(rows: pa.Table) -> pa.Table:
        contexts, words, counts = [], [], []
        for first, size, c, w, m in zip(*(rows.column(k).to_pylist() for k in ("first", "size", "c", "w", "n"))):
            words.append(_numbers(w, np.int32, size))
            contexts.append(first + np.cumsum(_numbers(c, np.uint32, size), dtype=np.int64))
            counts.append(_numbers(m, np.uint8, size).astype(np.int64))
        context, word, n = np.concatenate(contexts), np.concatenate(words), np.concatenate(counts)
        order = _in_order(context, word)
        context, word, n = context[order], word[order], n[order]
        starts = np.flatnonzero((np.diff(context, prepend=-1) != 0) | (np.diff(word, prepend=-1) != 0))
        n = np.add.reduceat(n, starts)
        enough = n >= min_count
        context, word, n = context[starts][enough], word[starts][enough].astype(np.uint64), n[enough]
        if not len(n):
            return pa.table({k: pa.array([], kind) for k, kind in zip(made_names, made_types)})
        starts = np.flatnonzero(np.diff(context, prepend=-1))
        total = running(model, depth, context[starts])[1]
        sizes = np.diff(np.append(starts, len(word)))
        prob = (n - DISCOUNT) / np.repeat(total, sizes)
        first, width = int(context[0]), int(context[-1] - context[0]) + 1
        local, mass = context[starts] - first, np.add.reduceat(prob, starts)
        rest = np.zeros(width, np.uint16)
        rest[local] = _rest_code(mass)
        held = np.zeros(width, np.int64)
        held[local] = sizes
        pointers = np.concatenate(([0], np.cumsum(held)))
        lasts = word[np.append(starts[1:], len(word)) - 1] + np.uint64(1)
        raised = np.concatenate((np.zeros(1, np.uint64), np.cumsum(lasts)[:-1].astype(np.uint64)))
        arrays = _named("pointer", EliasFano.of(pointers)) | _named("successor", EliasFano.of(word + np.repeat(raised, sizes)))
        arrays |= {"span": np.array([first, width], np.int64), "rest": rest, "prob": quantised(prob)}
        if more:  # the next level's contexts are this level's entries
            arrays |= _named("count", EliasFano.of(np.concatenate(([0], np.cumsum(n)))))
        path = write_arrays(folder, f"grams{depth + 1}", arrays)
        ends = [first, int(word[0]), float(mass[0]), int(context[-1]), float(mass[-1]) if len(mass) > 1 else 0.0]
        return pa.table({k: pa.array([v], kind) for k, kind, v in zip(made_names, made_types, [path, len(word), int(n.sum()), *ends])})

    made_names = ["path", "entries", "tokens", "c", "w", "mass", "last", "last_mass"]
    made_types = [pa.string(), *[pa.int64()] * 4, pa.float64(), pa.int64(), pa.float64()]
    grams = encoded.select("ids").mapInArrow(count, "part long, first long, size long, c binary, w binary, n binary")
    made = grams.groupBy("part").applyInArrow(build, "path string, entries long, tokens long, c long, w long, mass double, last long, last_mass double")
    parts_made = sorted(common.stored(made, f"parts{depth + 1}").collect(), key=lambda r: (r["c"], r["w"]))
    mass: dict[int, float] = {}
    for r in parts_made:
        mass[r["c"]] = mass.get(r["c"], 0.0) + r["mass"]
        if r["last"] != r["c"]:
            mass[r["last"]] = mass.get(r["last"], 0.0) + r["last_mass"]
    ends = np.array(sorted(mass), np.int64)
    codes = _rest_code(np.array([mass[c] for c in ends.tolist()]))
    columns = {k: [r[k] for r in parts_made] for k in ("path", "entries", "tokens")}
    pairs = tuple((r["c"], r["w"]) for r in parts_made)
    return Level(tuple(columns["path"]), _before(columns["entries"]), _before(columns["tokens"]), sum(columns["entries"]), pairs, (ends, codes))


def _in_order(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The order of pairs: that of one number where one holds both, which sorts in a fraction of the time."""
    first, radix = int(context.min()), int(word.max()) + 1
    if (int(context.max()) - first + 1) * radix >= 1 << 63:
        return np.lexsort((word, context))
    return np.argsort((context - first) * radix + word)


def _bytes(values: np.ndarray, small: type) -> bytes:
    """The values compressed, of a small type if all fit, else of eight bytes each; the first byte tells the size."""
    fits = len(values) == 0 or int(values.max()) <= np.iinfo(small).max
    values = np.ascontiguousarray(values.astype(small if fits else np.int64))
    return bytes([values.itemsize]) + pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def _numbers(data: bytes, small: type, count: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[1:], count * data[0], codec="zstd", asbytes=True), small if data[0] == np.dtype(small).itemsize else np.int64)


def _rest_code(mass: np.ndarray) -> np.ndarray:
    return np.maximum(quantised(1.0 - mass), 1)


def train(docs: DataFrame, order: int = 2, min_count: int = MIN_COUNT) -> Model:
    """Counts and tries from all rows of docs (columns doc_id, text); order is 2 or more."""
    return _trained(docs, docs, lambda encoded: encoded, order, min_count)[0]


def _trained(docs: DataFrame, rated: DataFrame, training: Callable[[DataFrame], DataFrame], order: int, min_count: int) -> tuple[Model, DataFrame]:
    """A model of docs, and the rows of `rated` encoded by it; `training` gives those of docs among them."""
    folder = common.work_folder(docs.sparkSession)
    texts = docs.select("text")
    words, n_words = _train_words(texts, folder)
    n_docs = texts.count()
    model = Model(words, n_words + n_docs, n_docs)
    encoded = _encoded(rated, model)
    for n in range(2, order + 1):
        level = _train_level(training(encoded), model, folder, n < order, min_count)
        model = Model(words, model.tokens, n_docs, (*model.levels, level))
    return model, encoded


# ---------------------------------------------------------------- scoring


def log_probabilities(model: Model, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """log10 probabilities of all tokens of documents of word ids, and the tokens of each document."""
    ids, before, lengths = _laid_out(model, docs)
    codes, distinct = pd.factorize(ids)
    counts = np.zeros(len(distinct), np.int64)
    known = np.flatnonzero(distinct >= 0)
    counts[known] = counts_of(model, distinct[known])
    prob = ((counts + 1) / model.floor_mass())[codes]
    contexts_of(model, ids, before, len(model.levels), prob)
    return np.log10(prob), lengths


def _scored(encoded: DataFrame, model: Model) -> DataFrame:
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, docs in _chunks(batches, 0, _read_ids):
            prob, lengths = log_probabilities(model, docs)
            starts = np.cumsum(lengths) - lengths
            columns = [list(c) for c in zip(*rows)]
            arrays = [
                pa.array(columns[0], id_type),
                pa.array(columns[1], pa.bool_()),
                pa.array(lengths.astype(np.int64)),
                pa.array(columns[2], pa.int64()),
                pa.array(np.full(len(rows), model.tokens, np.int64)),
                pa.array(columns[3], pa.float64()),
                pa.array(np.add.reduceat(prob, starts)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    id_type = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    source = encoded.select("ids", "doc_id", "held_out", "n_known", "base_score")
    return source.mapInArrow(rate, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    return _scored(_encoded(docs, model), model)


def score_report(docs: DataFrame, order: int = 2, min_count: int = MIN_COUNT) -> DataFrame:
    """Scores of all rows of docs under a model of those not held out."""
    known = docs.where(~is_held_out(F.col("doc_id")))
    model, encoded = _trained(known, docs, lambda rows: rows.where("not held_out"), order, min_count)
    return _scored(encoded, model)
