"""Main text of web pages by wrapper induction.

The pages of a host are aligned: each page's tree of block elements, furniture included (runs of equal neighbours
are one node), is matched with the host's most common tree by simple tree matching. Over the pages a node of
the host's tree is a slot, and its texts tell what it is:

* a text that most of the host's pages hold in the same slot, and hardly another one there, is constant: template;
* the words that vary, links aside, are summed up the tree; the wrapper goes down from the root as long as one
  branch carries most of them and ends at the branch that holds the content. All outside is template, headings
  that lead to it apart, however it varies from page to page;
* a slot within the content whose words stand in links on most pages is a menu.

Tags and names (nav, footer, comments, ...) only break ties: where two branches could carry the content, for
elements that the host's tree lacks, and for small slots within the content; a slot that carries most of the
content stays, whatever its name. Where no wrapper can be induced - hosts with fewer than `min_pages` differing
pages, and pages without the host's content branch - the page's own marks and names decide.

A host's pages vote by identity, the hash of their longest block of main text, so that copies and near copies of one
page count once, and don't make their content constant.

Pages are parsed once; their blocks are a stored table with the texts, and all later steps move hashes and counts.
Trees are matched once per distinct tree of a host; counts of (host, slot, text) are aggregated before they
are shuffled; the extraction is a join of the blocks with the slots to keep, in native expressions.

Defined results: null and empty html give an empty text; a null url is a host of its own, the empty one; repeated
rows are extracted alike; ties of trees go to the greater string; a very long page is one row in one task and
no part of it is left out; an empty table gives an empty table. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, dom

#: States of a slot: template; content unless named furniture, by the rule for main parts or for whole pages; content.
TEMPLATE, CONTENT, WIDE_CONTENT, SURE = 0, 1, 2, 3
#: A branch carries the content if it holds this share of the varying words, or that share if the page marks it.
BRANCH, MARKED_BRANCH = 0.6, 0.3
#: A constant text stands on this share of the pages that have its slot.
SLOT_SHARE = 0.8
#: A slot within the content with this share of its words in links, on min_share of the pages, is a menu.
LINK_SHARE = 0.8


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)), F.lit(""))


def layouts(pages: DataFrame) -> DataFrame:
    """page_id, url, host, shape, blocks (node, text, words, links, flags) and identity of every page."""
    ids = pages.schema["page_id"].dataType.simpleString()
    parts = {"node": "int", "text": "string", "words": "int", "links": "int", "flags": "int"}
    kinds = {"int": pa.int32(), "string": pa.string()}
    schema = f"page_id {ids}, url string, host string, shape string, longest int, " + ", ".join(f"{k} array<{v}>" for k, v in parts.items())

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes, longest, columns = [], [], {k: [] for k in parts}
            for source in batch.column(3):
                root = dom.parse(source.as_py() or "")
                shape, numbers = dom.skeleton(root)
                found = dom.page_blocks(root)
                shapes.append(shape)
                columns["node"].append([numbers.get(b.owner, 0) for b in found])
                for k in ("text", "words", "links", "flags"):
                    columns[k].append([getattr(b, k) for b in found])
                longest.append(max(range(len(found)), key=lambda i: (found[i].flags & dom.USUAL, len(found[i].text)), default=-1) + 1)
            arrays = [batch.column(0), batch.column(1), batch.column(2), pa.array(shapes, pa.string()), pa.array(longest, pa.int32())]
            arrays += [pa.array(columns[k], pa.list_(kinds[v])) for k, v in parts.items()]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "host", "shape", "longest", *parts])

    source = pages.select("page_id", "url", host(F.col("url")).alias("host"), "html")
    rows = source.mapInArrow(parse, schema)
    identity = F.xxhash64(F.when(F.col("longest") > 0, F.element_at("text", F.col("longest"))))
    return rows.select("page_id", "url", "host", "shape", F.xxhash64("host", "shape").alias("shape_key"), identity.alias("identity"), F.arrays_zip(*parts).alias("blocks"))


def _matched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each tree, its nodes' numbers in the host's tree: m of the partner, or -1 - m of the nearest ancestor's."""
    for pdf in frames:
        found = []
        for shape, model in zip(pdf["shape"], pdf["model"]):
            tree = dom.read_skeleton(shape)
            pairs = dom.simple_tree_matching(tree, dom.read_skeleton(model)) if shape != model else None
            to = [0] * shape.count("(")
            todo = [(tree, -1)]
            while todo:
                (_, number, kids), above = todo.pop()
                to[number] = number if pairs is None else pairs.get(number, above)
                todo.extend((kid, to[number] if to[number] < 0 else -1 - to[number]) for kid in kids)
            found.append(to)
        yield pd.DataFrame({"shape_key": pdf["shape_key"], "to": found})


def wrapper(model: tuple, varying: dict[int, int], words: dict[int, int], links: dict[int, int], share: dict[int, float], min_share: float) -> tuple[int, list[int]]:
    """The content branch (a node of the host's tree, -1: none) and the state of every node.

    varying, words and links: words in each slot, all and those in links; varying: those that are neither constant nor
    in links; share: share of the pages that have the slot.
    """
    order, below = [model], {}
    for _, _, kids in order:
        order.extend(kids)
    for _, number, kids in reversed(order):
        below[number] = varying.get(number, 0) + sum(below[k[1]] for k in kids)
    states = [TEMPLATE] * len(order)
    total = below[model[1]]
    if not total:
        return -1, states
    at, sure_headings = model, []
    while at[2]:
        own = below[at[1]]
        kids = [k for k in at[2] if k[2] or _marks(k)]  # a run of paragraphs is content, not a branch
        best = max(kids, key=lambda k: below[k[1]], default=None)
        marked = [k for k in kids if _holds_mark(k) and below[k[1]] >= MARKED_BRANCH * own]
        if best is not None and marked and best not in marked and below[best[1]] < 2 * below[marked[0][1]]:
            best = max(marked, key=lambda k: below[k[1]])
        if best is None or below[best[1]] < (MARKED_BRANCH if best in marked else BRANCH) * own:
            break
        before = at[2][: at[2].index(best)]
        sure_headings += [k for k in before if _tag(k) in dom.HEADINGS and varying.get(k[1], 0)]
        at = best
    wide = _tag(at) in ("#root", "html", "body")
    content, todo = below[at[1]], [at]
    while todo:
        node = todo.pop()
        number = node[1]
        menu = words.get(number, 0) and links.get(number, 0) >= LINK_SHARE * words[number] and share.get(number, 0) >= min_share
        large = not node[2] and below[number] > 0.5 * content
        states[number] = TEMPLATE if menu and not large else SURE if large else WIDE_CONTENT if wide else CONTENT
        todo.extend(node[2])
    for k in sure_headings:
        states[k[1]] = CONTENT
    return at[1], states


def _tag(node: tuple) -> str:
    return node[0].split(".")[0]


def _marks(node: tuple) -> bool:
    return _tag(node) in ("main", "article")


def _holds_mark(node: tuple) -> bool:
    todo = [node]
    while todo:
        kid = todo.pop()
        if _marks(kid):
            return True
        todo.extend(kid[2])
    return False


def wrappers(pages: DataFrame, min_pages: int = 3, min_share: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """What the hosts' pages tell; `pages` is a stored table of layouts.

    Two tables: host, content (a node), states (of the host's tree) and constants (hashes of slot and text);
    shape_key and to (the nodes of that tree in the host's).
    """
    votes = pages.where("size(blocks) > 0")
    pages_of = votes.groupBy("host", "identity").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("one").alias("n_pages")).where(F.col("n_pages") >= min_pages)
    pages_of = common.small(common.stored(pages_of, "pages_of"))
    shapes = votes.groupBy("host", "shape_key").agg(F.count(F.lit(1)).alias("n"), F.first("shape").alias("shape"))
    model = shapes.groupBy("host").agg(F.max(F.struct("n", "shape")).alias("m")).select("host", F.col("m.shape").alias("model"))
    # an inner join (a host is one row): a semi-join would be moved below the grouping, to every page's row
    model = common.stored(model.join(pages_of, "host").select("host", "model"), "models")
    to = shapes.join(common.small(model), "host").select("shape", "shape_key", "model").mapInPandas(_matched, "shape_key long, to array<int>")
    to = common.stored(to, "aligned")
    seen = votes.select("host", "identity", "shape_key", F.explode("blocks").alias("b")).join(common.small(to), "shape_key")
    seen = seen.select("host", "identity", F.element_at("to", F.col("b.node") + 1).alias("slot"), F.xxhash64("b.text").alias("text"), "b.words", "b.links")
    once = seen.groupBy("host", "slot", "text", "identity").agg(F.sum("words").alias("words"), F.sum("links").alias("links"))
    once = common.stored(once, "slot_texts")
    texts = once.groupBy("host", "slot", "text").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words"), F.sum("links").alias("links")).where(F.col("n") >= min_pages)
    slots = once.groupBy("host", "slot", "identity").agg(F.sum("words").alias("words"), F.sum("links").alias("links"))
    slots = slots.groupBy("host", "slot").agg(F.count(F.lit(1)).alias("n_slot"), F.sum("words").alias("words"), F.sum("links").alias("links"))
    slots = common.stored(slots.join(pages_of, "host"), "slots")
    fixed = texts.join(common.small(slots.select("host", "slot", "n_slot", "n_pages")), ["host", "slot"])
    fixed = fixed.where((F.col("n") >= min_share * F.col("n_pages")) & (F.col("n") >= SLOT_SHARE * F.col("n_slot")))
    fixed = common.stored(fixed.select("host", "slot", "text", "words", "links"), "constants")
    lost = fixed.groupBy("host", "slot").agg(F.sum(F.col("words") - F.col("links")).alias("lost"))
    told = slots.join(lost, ["host", "slot"], "left").withColumn("varying", F.col("words") - F.col("links") - F.coalesce("lost", F.lit(0)))
    told = told.groupBy("host").agg(F.collect_list(F.struct("slot", "varying", "words", "links", (F.col("n_slot") / F.col("n_pages")).alias("share"))).alias("slots"))

    def induce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for name, model, slots in zip(pdf["host"], pdf["model"], pdf["slots"]):
                sums = [{}, {}, {}]
                share = {s["slot"]: s["share"] for s in slots}
                for s in slots:
                    own = s["slot"] if s["slot"] >= 0 else -1 - s["slot"]
                    for column, into in zip(("varying", "words", "links"), sums):
                        if column == "varying" or s["slot"] >= 0:
                            into[own] = into.get(own, 0) + s[column]
                rows.append((name, *wrapper(dom.read_skeleton(model), *sums, share, min_share)))
            yield pd.DataFrame(rows, columns=["host", "content", "states"])

    induced = told.join(model, "host").select("host", "model", "slots").mapInPandas(induce, "host string, content int, states array<int>")
    texts = fixed.groupBy("host").agg(F.collect_list(F.xxhash64("slot", "text")).alias("constants"))
    found = induced.where("content >= 0").join(texts, "host", "left").withColumn("constants", F.coalesce("constants", F.array().cast("array<long>")))
    return common.stored(found, "wrappers"), to


def extract(pages: DataFrame, min_pages: int = 3, min_share: float = 0.6) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""
    rows = common.stored(layouts(pages), "layouts")
    known, to = wrappers(rows, min_pages, min_share)
    joined = rows.select("page_id", "url", "host", "shape_key", "blocks").join(common.small(to), "shape_key", "left").join(common.small(known), "host", "left")

    def flag(b: Column, bit: int) -> Column:
        return b["flags"].bitwiseAND(bit) != 0

    def kept(b: Column) -> Column:
        slot = F.element_at("to", b["node"] + 1)
        state = F.element_at("states", F.when(slot < 0, -slot).otherwise(slot + 1))
        state = F.when((state == SURE) & (slot < 0), CONTENT).otherwise(state)
        named = F.when(state == CONTENT, flag(b, dom.NAMED)).when(state == WIDE_CONTENT, flag(b, dom.NAMED_OUTSIDE)).otherwise(False)
        return (state != TEMPLATE) & ~named & ~F.array_contains("constants", F.xxhash64(slot, F.xxhash64(b["text"])))

    def by_names(b: Column) -> Column:
        slot = F.element_at("to", b["node"] + 1)
        constant = F.coalesce(F.array_contains("constants", F.xxhash64(slot, F.xxhash64(b["text"]))), F.lit(False))
        return flag(b, dom.USUAL) & ~constant

    fits = F.coalesce(F.array_contains("to", F.col("content")), F.lit(False))
    joined = joined.select("page_id", "url", "blocks", "to", "states", "constants", fits.alias("fits"))
    joined = joined.select("*", F.when(F.col("fits"), F.filter("blocks", kept)).alias("found"))
    chosen = F.when(F.coalesce(F.size("found"), F.lit(0)) > 0, F.col("found")).otherwise(F.filter("blocks", by_names))
    text = F.array_join(F.transform(chosen, lambda b: b["text"]), "\n\n")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
