"""Source divergence audit: how far the word use of each source lies from that of every other source of its language.

Each language keeps the terms that enough of its documents use. A group (language, source) gives every kept term the smoothed
share p, in integers. Two groups lie apart by the sum of |p - q| over all kept terms, and this sum is split:

* a group that lacks a term gives it its least share p0, so between two groups all terms count as |p0 - q0| first;
* heavy terms, which many groups use, fill dense tiles: a matrix of groups by terms, whose rows are subtracted whole. What
  a tile's terms differ by in place of |p0 - q0| is its part of the sum;
* light terms, which few groups use, are never laid out. For each group's own light terms comes the difference that they make
  (a histogram of its shares against the other's p0), and for terms of both groups, by posting pairs, what the two
  corrections have wrong together.

All sums are integers and are added exactly. A light term has at most LIGHT postings, so its pairs are few; tiles hold a bounded
number of cells, and groups beyond GROUPS are cut into blocks, of which every two share a tile.

Texts are counted in the tasks that read them (by bytes, since only ASCII letters change case and ASCII alone separates terms); what is
shuffled are counts of distinct terms.

Defined results: null text, lang and source count as ''; a group without terms takes part with p0 alone; a language without kept
terms has pairs of value 0 and no terms; ties go to the lesser item; a very long text is counted piece by piece; repeated rows count as often as they are
there; empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Terms in more groups than this are heavy.
LIGHT = 6
#: Groups of a block, and cells of a tile's matrix, at most.
GROUPS, CELLS = 256, 1 << 21
#: A task passes its counts on when it holds this many.
HELD = 400_000
#: Texts are split in pieces of about so many bytes.
PIECE = 1 << 20

TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
BREAK = re.compile(rb"[^A-Za-z\x80-\xff]")
COUNTS = "lang string, source string, term string, n long, docs long"


def _pieces(text: bytes) -> Iterator[bytes]:
    start = 0
    while len(text) - start > PIECE:
        cut = BREAK.search(text, start + PIECE)
        end = cut.start() if cut else len(text)
        yield text[start:end]
        start = end
    yield text[start:]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs: partial counts; a group's row of null term says that the group is there."""
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    names = ["lang", "source", "term", "n", "docs"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def passed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in found.items():
            terms = [None, *(t.decode() for t in n)]
            columns = [[lang] * len(terms), [source] * len(terms), terms, [0, *n.values()], [0, *map(docs.__getitem__, n)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        found.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(batch[c].to_pylist() for c in ("lang", "source", "text"))):
            n, docs = found.setdefault((lang, source), (Counter(), Counter()))
            before, own = len(n), set()
            for piece in _pieces(text.lower()):
                terms = TERM.findall(piece)
                n.update(terms)
                own.update(terms)
            docs.update(own)
            held += len(n) - before
            if held > HELD:
                yield from passed_on()
                held = 0
    yield from passed_on()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, and over all groups of the language: docs_lang, n_lang, in_groups, first (one row of a term).

    docs_lang is the number of documents with the term; a row of null term stands for each group.
    """
    texts = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    parts = texts.mapInArrow(_counted, COUNTS).repartition("lang", "term")  # one shuffle serves the grouping and the window
    counts = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    over = {"docs_lang": F.sum("docs"), "n_lang": F.sum("n"), "in_groups": F.count(F.lit(1)), "_least": F.min("source")}
    counts = counts.withColumns({c: f.over(term) for c, f in over.items()})
    return counts.select("lang", "source", "term", "n", "docs_lang", "n_lang", "in_groups", (F.col("source") == F.col("_least")).alias("first"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 terms)), exact for any long; 0 where there are no terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    whole = F.call_function("div", (wide(n) + 5) * F.lit(10**9).cast("decimal(10,0)"), F.nullif(wide(total) + wide(terms) * 5, F.lit(0).cast("decimal(20,0)")))
    return F.when(terms > 0, whole + 1).otherwise(0).cast("long")


def _tiles(size: int):
    """lang, g, h, apart: what the terms of a tile change between its groups, `size` to a block; rows without a term hold the groups' least shares."""

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        least = pdf[pdf["term"].isna()].sort_values("idx")
        groups = least["idx"].to_numpy()
        own = pdf[pdf["term"].notna()]
        at, terms = pd.factorize(own["term"])
        shares = np.repeat(least["p"].to_numpy()[:, None], len(terms), axis=1)
        shares[np.searchsorted(groups, own["idx"].to_numpy()), at] = own["p"].to_numpy()
        low, high = pdf["b1"].iloc[0], pdf["b2"].iloc[0]
        left = np.flatnonzero(groups // size == low)
        right = np.flatnonzero(groups // size == high)
        p0 = least["p"].to_numpy()
        found = [(groups[i], to := right[right > i], np.abs(shares[to] - shares[i]).sum(axis=1) - len(terms) * np.abs(p0[to] - p0[i])) for i in left]
        g = np.concatenate([np.full(len(to), i) for i, to, _ in found])
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "g": g, "h": groups[np.concatenate([to for _, to, _ in found])], "apart": np.concatenate([d for *_, d in found])})

    return tile


def _block_pairs(df: DataFrame) -> DataFrame:
    """Each row of a group once for every two blocks of its language that its own is one of; s: groups of the language."""
    last = F.floor((F.col("s") - 1) / GROUPS).cast("int")
    own = F.floor(F.col("idx") / GROUPS).cast("int")
    df = df.withColumn("_b", F.explode(F.sequence(F.lit(0), last)))
    return df.select(*[c for c in df.columns if c != "_b"], F.least(own, F.col("_b")).alias("b1"), F.greatest(own, F.col("_b")).alias("b2"))


def _heavy(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, g, h, apart of all heavy terms, by tiles."""
    width = F.least(F.lit(4096), F.lit(CELLS) / F.least(F.col("s"), F.lit(2 * GROUPS)))
    tiles = F.ceil(F.col("heavy") / width)
    cells = entries.where(F.col("in_groups") > LIGHT).select("lang", F.pmod(F.xxhash64("term"), tiles).cast("int").alias("tile"), "idx", "s", "term", "p")
    least = groups.where("heavy > 0").select("lang", F.explode(F.sequence(F.lit(0), (tiles - 1).cast("int"))).alias("tile"), "idx", "s", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"))
    both = _block_pairs(cells.unionByName(least)).drop("s")
    return both.groupBy("lang", "tile", "b1", "b2").applyInPandas(_tiles(GROUPS), "lang string, g long, h long, apart long")


def _posting_pairs(entries: DataFrame) -> DataFrame:
    """lang, g, h, apart: for each two groups of a light term, its difference less what the single corrections say of it."""
    posting = F.struct(F.col("idx").cast("long").alias("idx"), "p", "p0")
    light = entries.where((F.col("in_groups") > 1) & (F.col("in_groups") <= LIGHT)).groupBy("lang", "term").agg(F.sort_array(F.collect_list(posting)).alias("own"))
    pairs = light.select("lang", F.posexplode("own").alias("at", "a"), "own").select("lang", "a", F.explode(F.slice("own", F.col("at") + 2, F.lit(LIGHT))).alias("b"))
    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    apart = gap("a.p", "b.p") - gap("a.p", "b.p0") - gap("b.p", "a.p0") + gap("a.p0", "b.p0")
    return pairs.select("lang", F.col("a.idx").alias("g"), F.col("b.idx").alias("h"), apart.alias("apart"))


def _grid(groups: DataFrame) -> DataFrame:
    """Every two groups of a language once, as structs g and h; they meet by blocks."""
    each = _block_pairs(groups).select("lang", "b1", "b2", "idx", F.struct("idx", "source", "p0", "held", "shares", "v").alias("x"))
    left, right = each.select("lang", "b1", "b2", F.col("idx").alias("_i"), F.col("x").alias("g")), each.select("lang", "b1", "b2", F.col("idx").alias("_j"), F.col("x").alias("h"))
    in_order = (F.col("_i") < F.col("_j")) & (F.floor(F.col("_i") / GROUPS) == F.col("b1")) & (F.floor(F.col("_j") / GROUPS) == F.col("b2"))
    return left.join(right, ["lang", "b1", "b2"]).where(in_order).select("lang", "g", "h")


def divergence(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language by distance (`pair`), and the terms used more than in the language (`term`)."""
    counts = common.stored(term_counts(docs), "term_counts")
    kept = counts.where(F.col("term").isNotNull() & (F.col("docs_lang") >= min_docs))
    by_lang = kept.groupBy("lang").agg(F.count(F.when(F.col("first"), 1)).alias("v"), F.count(F.when(F.col("first") & (F.col("in_groups") > LIGHT), 1)).alias("heavy"), F.sum("n").alias("total_lang"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    place = Window.partitionBy("lang").orderBy("source")  # a row for each group
    groups = counts.where(F.col("term").isNull()).select("lang", "source", (F.row_number().over(place) - 1).alias("idx"), F.count(F.lit(1)).over(Window.partitionBy("lang")).cast("int").alias("s"))
    groups = groups.join(totals, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0, ["total", "v", "heavy", "total_lang"])
    groups = common.stored(groups.withColumn("p0", share(F.lit(0).cast("long"), F.col("total"), F.col("v"))), "groups")
    entries = kept.join(common.small(groups), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))
    entries = common.stored(entries.withColumn("q", share(F.col("n_lang"), F.col("total_lang"), F.col("v"))).drop("n", "docs_lang", "n_lang", "first", "total", "total_lang"), "shares")

    found = _heavy(entries, groups).unionByName(_posting_pairs(entries)).groupBy("lang", "g", "h").agg(F.sum("apart").alias("apart"))
    shares = entries.where(F.col("in_groups") <= LIGHT).groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n"))
    shares = shares.groupBy("lang", "source").agg(F.sum("n").alias("held"), F.collect_list(F.struct("p", "n")).alias("shares"))
    known = groups.join(shares, ["lang", "source"], "left").na.fill(0, ["held"])
    grid = _grid(known).withColumns({"_base": F.abs(F.col("g.p0") - F.col("h.p0"))})

    def single(own: str, other: str) -> Column:
        """Of a group's light terms, the distances from the other's least share, in place of that between the two least shares."""
        away = F.aggregate(f"{own}.shares", F.lit(0).cast("long"), lambda a, x: a + x["n"] * F.abs(x["p"] - F.col(f"{other}.p0")))
        return F.coalesce(away, F.lit(0)) - F.col(f"{own}.held") * F.col("_base")

    rest = F.col("g.v") * F.col("_base") + single("g", "h") + single("h", "g")
    pairs = grid.select("lang", F.col("g.idx").cast("long").alias("i"), F.col("h.idx").cast("long").alias("j"), F.col("g.source").alias("a"), F.col("h.source").alias("b"), rest.alias("_rest"))
    pairs = pairs.withColumnsRenamed({"i": "g", "j": "h"}).join(found, ["lang", "g", "h"], "left").select("lang", "a", "b", (F.col("_rest") + F.coalesce("apart", F.lit(0))).alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    terms = entries.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


def oracle_sql(min_docs: int = 30, top: int = 50) -> str:
    """Every kept term of every two sources of a language, by brute force."""
    share = lambda n, total: f"(1 + (1000000000::HUGEINT * ({n} + 5)) // ({total} + 5 * v))::BIGINT"
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}') AS text FROM documents),
    tok AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM tok GROUP BY ALL),
    k AS (SELECT lang, term, sum(n)::BIGINT AS nl FROM c GROUP BY ALL HAVING sum(docs) >= {min_docs}),
    l AS (SELECT lang, count(*) AS v, sum(nl)::BIGINT AS total_l FROM k GROUP BY ALL),
    g AS (SELECT DISTINCT lang, source FROM d),
    e AS (SELECT g.lang, g.source, k.term, k.nl, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    t AS (SELECT lang, source, sum(n)::BIGINT AS total FROM e GROUP BY ALL),
    p AS (SELECT lang, source, term, n, {share("n", "total")} AS p, {share("nl", "total_l")} AS q FROM e JOIN t USING (lang, source) JOIN l USING (lang)),
    dist AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN dist ON dist.lang = a.lang AND dist.source = a.source AND dist.item = b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
    SELECT * FROM ranked WHERE part = 'pair' OR rank <= {top}
    """
