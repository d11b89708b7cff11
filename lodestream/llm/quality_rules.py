"""Quality rules: per-document base rules and cross-document line frequency.

Lines are normalised (lower case, single spaces) and hashed together with their host (`source`).
For each hashed line the distinct documents are counted; a line above the limits is boilerplate.
Boilerplate lines are removed and a document that keeps too little of itself is rejected.

Copies of one document share all their lines, which does not make these lines boilerplate.
So equal texts count once, and of the texts that hold a line only those that differ are counted. A word triple
that stands in more than `max_docs` texts of a host is common there. A text whose share of other triples is above
`max_copied` is a document of its own, however much boilerplate surrounds it; such texts count by min-hashes
of their own triples, equal in most near copies. The others are copies: each chooses the rarest of its common
triples, and a triple that most of the texts holding it chose stands for one group of copies, of any size.
A line with more than `max_docs` such documents and groups is boilerplate.

Defined results: a null or blank text has no words and no lines, fails the base rules and keeps its row;
a null host is a host of its own; equal rows get equal results; an empty table gives an empty table.
Every row counts as a document, whatever its doc_id. Other columns, whatever their names, pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: A line of more differing documents than this in one host is boilerplate.
    max_docs: int = 10
    #: A text with at most this share of triples of its own is a copy. Words edited here and there down to a Jaccard
    #: coefficient of 0.8 over five-word runs change this share of the triples.
    max_copied: float = 1 / 15
    #: A triple stands for a group of copies if at least this share of the texts that hold it chose it.
    min_spread: float = 0.5
    #: A document that keeps less than this share of its words is depleted.
    min_left: float = 0.3


SYMBOLS = "#*$%&|<>"
#: Least triple hashes kept of a text; a text of up to so many distinct triples is kept whole.
SKETCH = 256
#: Min-hashes of a text's own triples. Each orders the hashed triples by their exclusive or with a mask of its own.
IDENTITIES = 6
MASKS = [(0x9E3779B97F4A7C15 * k) % (1 << 64) - (1 << 63) for k in range(IDENTITIES)]


def _line_key(host: Column, line: Column) -> Column:
    normal = F.regexp_replace(F.lower(F.trim(line, F.lit(common.GAP_CHARS))), common.GAP, " ")
    return F.xxhash64(host, normal)


def _lines(text: Column) -> Column:
    """The \\n-split lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.trim(line, F.lit(common.GAP_CHARS)) != "")


def _text_key(host: Column, text: Column) -> Column:
    return F.xxhash64(host, text)


def document_features(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One pass over the texts: doc_id, the base counts, and the hashed lines with their word counts."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", F.col("source").alias("host"), text.alias("text"), common.words(F.col("text")).alias("w"), _lines(F.col("text")).alias("l"))
    triples = F.transform("w", lambda w, i: F.xxhash64(w, F.get("w", i + 1), F.get("w", i + 2)))
    df = df.select("*", F.slice(triples, 1, F.greatest(F.size("w") - 2, F.lit(0))).alias("g"))
    df = df.select("*", F.sort_array(F.array_distinct("g")).alias("d"))
    at = F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.select("*", F.when(F.size("d") < F.size("g"), at).alias("s"))
    twice = F.filter("s", lambda x, k: x["h"].eqNullSafe(F.get("s", k - 1)["h"]) | x["h"].eqNullSafe(F.get("s", k + 1)["h"]))
    covered = F.aggregate(
        F.sort_array(F.transform(twice, lambda x: x["i"])),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    return df.select(
        "doc_id",
        _text_key(F.col("host"), F.col("text")).alias("text_key"),
        F.xxhash64("host").alias("host_key"),
        F.transform(F.slice("d", 1, SKETCH), lambda h: F.shiftright(h, 32).cast("int")).alias("sketch"),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("text", common.GAP_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.transform("l", lambda line: _line_key(F.col("host"), line)).alias("line_keys"),
        F.transform("l", lambda line: F.size(F.split(F.trim(line, F.lit(common.GAP_CHARS)), common.GAP))).alias("line_words"),
    ).withColumn("base_failed", (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words")))


def frequent_lines(features: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Keys of the boilerplate lines; features must be a stored table.

    Lines in enough distinct texts come first, and only their texts are compared. Each grouping
    aggregates before it shuffles, and rows are dealt by text and by identity before they are counted by
    line, so a line that a third of all documents hold does not meet in one task as rows.
    """
    held = features.select(F.explode(F.array_distinct("line_keys")).alias("line_key"), "text_key").distinct()
    often = held.groupBy("line_key").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > limits.max_docs)
    often = common.small(common.stored(often.select("line_key"), "often"))
    rows = features.select(F.explode(F.array_distinct("line_keys")).alias("line_key"), "text_key").join(often, "line_key", "left_semi")
    lines = common.stored(rows.groupBy("text_key").agg(F.collect_set("line_key").alias("lines")), "lines")
    texts = features.select("text_key", "host_key", "sketch").join(common.small(lines.select("text_key")), "text_key", "left_semi")
    texts = common.stored(texts.groupBy("text_key").agg(F.first("host_key").alias("host_key"), F.first("sketch").alias("sketch")), "texts")
    own, copies = _own_and_copied(texts, limits)
    own = own.join(lines, "text_key").select(F.explode("lines").alias("line_key"), "identities")
    own = own.select("line_key", F.posexplode("identities").alias("k", "identity")).distinct()
    own = own.groupBy("line_key", "k").agg(F.count(F.lit(1)).alias("n")).select("line_key", (F.col("n") / IDENTITIES).alias("n"))
    groups = copies.join(lines, "text_key").select(F.explode("lines").alias("line_key"), "group").distinct()
    groups = groups.groupBy("line_key").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return own.unionByName(groups).groupBy("line_key").agg(F.sum("n").alias("n_differing")).where(F.col("n_differing") > limits.max_docs + 1e-6)


def _own_and_copied(texts: DataFrame, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """text_key and identities of the documents of their own; text_key and group of the copies that have one."""
    triples = texts.select("text_key", "host_key", F.explode("sketch").alias("v"))
    triples = triples.select("text_key", "v", F.xxhash64("host_key", "v").alias("triple"))
    shared = triples.groupBy("triple").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limits.max_docs)
    shared = common.small(common.stored(shared, "shared"))
    hits = triples.join(shared, "triple").groupBy("text_key").agg(F.collect_list("v").alias("shared"), F.min(F.struct("n", "triple")).alias("rarest"))
    told = texts.join(hits, "text_key", "left")
    own = F.array_except("sketch", F.coalesce("shared", F.array().cast("array<int>")))
    told = common.stored(told.select("text_key", own.alias("own"), F.size("sketch").alias("n_kept"), "rarest"), "told")
    differs = (F.size("own") > limits.max_copied * F.col("n_kept")) | (F.col("n_kept") == 0)
    hashed = F.transform("own", lambda v: F.xxhash64(v))
    least = [F.coalesce(F.array_min(F.transform("hashed", lambda h, m=mask: h.bitwiseXOR(F.lit(m)))), F.col("text_key")) for mask in MASKS]
    apart = told.where(differs).select("text_key", hashed.alias("hashed")).select("text_key", F.array(*least).alias("identities"))
    copies = told.where(~differs).select("text_key", F.col("rarest.triple").alias("group"), F.col("rarest.n").alias("n"))
    chosen = copies.groupBy("group", "n").agg(F.count(F.lit(1)).alias("n_chose")).where(F.col("n_chose") >= limits.min_spread * F.col("n"))
    return apart, copies.join(common.small(common.stored(chosen.select("group"), "groups")), "group", "left_semi")


def judged(features: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Features plus n_removed_words, the removed line keys and `kept`; features must be a stored table."""
    frequent = common.small(common.stored(frequent_lines(features, limits).select("line_key"), "frequent"))
    lines = features.select("text_key", F.posexplode(F.arrays_zip("line_keys", "line_words")).alias("pos", "line"))
    lines = lines.select("text_key", "pos", F.col("line.line_keys").alias("line_key"), F.col("line.line_words").alias("n"))
    hit = lines.join(frequent, "line_key", "left_semi").dropDuplicates(["text_key", "pos"])
    removed = hit.groupBy("text_key").agg(F.sum("n").alias("n_removed_words"), F.collect_set("line_key").alias("removed_keys"))
    out = features.join(removed, "text_key", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
    depleted = F.col("n_words") - F.col("n_removed_words") < limits.min_left * F.col("n_words")
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def quality_report(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and n_removed_words, one row per row of docs."""
    features = common.stored(document_features(docs, limits), "features")
    return judged(features, limits).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def apply_quality_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The kept rows of docs with boilerplate lines cut from their text; columns as in docs.

    n_chars, where docs has it, follows the cut text.
    """
    features = common.stored(document_features(docs, limits), "features")
    verdicts = judged(features, limits).where("kept").groupBy("text_key").agg(F.first("removed_keys").alias("removed"))
    source, text = F.col("row.source"), F.col("row.text")
    joined = common.packed(docs).withColumn("text_key", _text_key(source, F.coalesce(text, F.lit("")))).join(verdicts, "text_key")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda line: ~F.array_contains("removed", _line_key(source, line))), "\n")
    cut = joined.withColumn("cut", F.when(F.col("removed").isNull(), text).otherwise(left))
    replaced = {"text": F.col("cut")}
    if "n_chars" in docs.columns:
        replaced["n_chars"] = F.length("cut").cast(docs.schema["n_chars"].dataType)
    return cut.select(*common.unpacked(docs.columns, **replaced))
