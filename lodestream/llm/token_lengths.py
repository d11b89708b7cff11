"""Exact histogram of encoded document lengths.

Documents are encoded by a byte-level BPE tokenizer and counted by their number of tokens. Suffix sums over
the histogram then answer, for every length L taken as context limit: how many documents are at least L
long, the tokens they hold, the total after truncation to L, and the share of documents below L, by which
quantiles are found. Any limit lies at or between lengths of the histogram, where the
truncated total is linear.

Only the histogram is summed in order, in two levels: lengths within blocks of `BLOCK` lengths, then blocks.

Defined results: very long texts are encoded whole, piece by piece; null and empty texts have no tokens and count as documents of length 0; repeated rows
count each time; an empty table gives an empty histogram. Columns other than text are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Documents are counted in pieces of this many characters cut at a space before a letter, where no token crosses.
PIECE = 1 << 16
BLOCK = 1024
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pre-tokenisation pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _of_vocabulary(lines: bytes):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines.splitlines() if line.strip())}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> bytes:
    with open(path, "rb") as lines:
        return lines.read()


def _encoding(path: str):
    return _of_vocabulary(_vocabulary(path))


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Parts of a text that encode independently: cuts stand between a letter and a space before a letter."""
    at = 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isalpha()):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def count_tokens(text: str | None, encoding=None) -> int:
    if not text:
        return 0
    encode = (encoding or _encoding(TOKENIZER)).encode_ordinary
    return len(encode(text)) if len(text) <= PIECE else sum(len(encode(part)) for part in pieces(text))


def encoded_lengths(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """n_tokens of every row of docs. The vocabulary file, of about a megabyte, is read by the driver and shipped to the tasks."""
    shipped = docs.sparkSession.sparkContext.broadcast(_vocabulary(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _of_vocabulary(shipped.value)
        for batch in batches:
            lengths = [count_tokens(text, encoding) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64())], names=["n_tokens"])

    return docs.select("text").mapInArrow(count, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """The histogram of the column n_tokens with its suffix sums, one row per length.

    n_docs; docs_at_least and tokens_at_least (documents of this length or longer); truncated_tokens (all
    tokens after truncation to this length); docs_below; share_below; total_docs; total_tokens.
    """
    counts = common.stored(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "counts")
    counts = counts.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    after, whole = Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing), Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("later_tokens"),
        F.sum("bd").over(whole).alias("total_docs"),
        F.sum("bt").over(whole).alias("total_tokens"),
    )
    own = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(0, Window.unboundedFollowing)
    sums = counts.join(blocks, "block").withColumn("docs_at_least", F.sum("n_docs").over(own) + F.col("later_docs"))
    sums = sums.withColumn("tokens_at_least", F.sum("tokens").over(own) + F.col("later_tokens"))
    below = F.col("total_docs") - F.col("docs_at_least")
    return sums.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
        below.alias("docs_below"),
        (below / F.col("total_docs")).alias("share_below"),
        "total_docs",
        "total_tokens",
    )


def at_limits(histogram: DataFrame, limits: DataFrame) -> DataFrame:
    """For each row of limits (column context_limit): total, truncated total, and documents cut.

    Each limit is answered by the least length of the histogram that reaches it: in its own block of lengths, else
    the first of a later block. Only the blocks are put in one order.
    """
    block = lambda c: F.floor(F.col(c) / BLOCK).alias("block")
    sums = F.struct("docs_at_least", "tokens_at_least")
    known = histogram.select(block("n_tokens"), "n_tokens", sums.alias("sums"), "total_docs", "total_tokens")
    asked = limits.select(F.col("context_limit").cast("long").alias("context_limit"), block("context_limit")).distinct()
    inside = asked.join(known, "block").where(F.col("n_tokens") >= F.col("context_limit")).groupBy("context_limit").agg(F.min_by("sums", "n_tokens").alias("own"))
    blocks = known.groupBy("block").agg(F.min_by("sums", "n_tokens").alias("first")).unionByName(asked.select("block", F.lit(None).cast(known.schema["sums"].dataType).alias("first")))
    blocks = blocks.groupBy("block").agg(F.max("first").alias("first"))
    after = Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    blocks = blocks.select("block", F.first("first", ignorenulls=True).over(after).alias("later"))
    totals = known.agg(F.max("total_docs").alias("total_docs"), F.max("total_tokens").alias("total_tokens"))
    out = asked.join(blocks, "block").join(inside, "context_limit", "left").withColumn("sums", F.coalesce("own", "later")).join(F.broadcast(totals))
    docs, tokens = (F.coalesce(F.col("sums").getField(c), F.lit(0)) for c in ("docs_at_least", "tokens_at_least"))
    return out.select("context_limit", "total_docs", "total_tokens", docs.alias("docs_reaching"), (F.col("total_tokens") - tokens + F.col("context_limit") * docs).alias("truncated_tokens"))


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """quantile, n_tokens: the least length that at least this share of documents do not exceed."""
    upto = (F.col("docs_below") + F.col("n_docs")) / F.col("total_docs")
    return histogram.agg(*[F.min(F.when(upto >= q, F.col("n_tokens"))).alias(str(q)) for q in shares]).unpivot([], [f"`{q}`" for q in shares], "quantile", "n_tokens")
