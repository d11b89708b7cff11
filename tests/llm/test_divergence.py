"""The divergence audit against sums over all terms in plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestream.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, min_docs, top=50):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    groups = defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        share = lambda n, total: 1 + 10**9 * (n + 5) // (total + 5 * len(kept))
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: share(counts[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(sum(counts[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, n) for n, (value, item) in enumerate(found, 1) if part == "pair" or n <= top]
    return sorted(out)


def audited(spark, rows, min_docs, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("term", "n", "docs", "idx", "s", "p", "q", "part", "item", "rank", "g", "h", "v")}).repartition(parts)
    return sorted(tuple(r) for r in divergence.divergence(df, min_docs).collect())


def corpus(seed, n, sources, words=120):
    """Every source has its own words beside those of all; one source holds a third of the rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = sources[0] if i % 3 == 0 else rng.choice(sources)
        own = [f"{'abcdefgh'[zlib.crc32(str(source).encode()) % 8]}{'xyz'[k % 3] * (k % 9 + 1)}" for k in range(20)]
        common_words = ["The", "the", "Été", "été", "a1b2", "x-y"] + ["w" + "abcdefghij"[k % 10] * (1 + k // 10) for k in range(words)]
        text = " ".join(rng.choice(own if rng.random() < 0.3 else common_words) for _ in range(rng.randint(0, 60)))
        rows.append((i, text, rng.choice(["en", "en", "de"]), source))
    return rows


@pytest.mark.parametrize("light", [0, 2, 6, 1000])
def test_heavy_and_light_add_up_to_all_terms(spark, monkeypatch, light):
    monkeypatch.setattr(divergence, "LIGHT", light)
    rows = corpus(1, 260, ["s0", "s1", "s2", "s3", "s4", None, "", "s5", "s6", "s7", "S8"])
    rows += [(900, None, "en", "s0"), (901, "", None, "bare"), (902, "1 2 3", "fr", None), (903, "alone here", "fr", "other"), (None, "The the", "en", "s1")]
    rows += [rows[5]] * 3
    assert audited(spark, rows, 4) == brute(rows, 4)


def test_blocks_and_tiles(spark, monkeypatch):
    """More groups than a block holds, and more terms than a tile; one group has words that nobody else has."""
    monkeypatch.setattr(divergence, "GROUPS", 4)
    monkeypatch.setattr(divergence, "CELLS", 64)
    rows = corpus(2, 240, [f"s{i}" for i in range(11)])
    rows += [(1000 + i, f"onlyhere{'q' * (i % 5)} the", "en", "s0") for i in range(20)]
    assert audited(spark, rows, 3) == brute(rows, 3)


def test_long_texts_are_counted_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 50)  # in this process: the pieces themselves
    text = ("word " * 40 + "x" * 200 + " Été" * 30).encode()
    pieces = list(divergence._pieces(text))
    assert b"".join(pieces) == text and len(pieces) > 3
    assert Counter(t for p in pieces for t in divergence.TERM.findall(p)) == Counter(divergence.TERM.findall(text))
    rows = [(i, "long words of a text " * 60_000 + "end", "en", s) for i, s in enumerate(["a", "b", "a"])] + [(9, "Long end", "en", "c")]
    assert audited(spark, rows, 1) == brute(rows, 1)


def test_few_rows(spark):
    assert audited(spark, [], 1, 1) == []
    one = [(1, "some words", "en", "a")]
    assert audited(spark, one, 1, 1) == brute(one, 1) == []
    two = [(1, None, None, None), (2, None, None, "b"), (3, "x y", "en", "a")]
    assert audited(spark, two, 1, 1) == brute(two, 1)


def test_ties_go_to_the_lesser_item(spark):
    rows = [(i, "a b c d é z", "en", s) for i, s in enumerate(["p", "q", "é", "z"])] + [(9, "a a b", "en", "last")]
    assert audited(spark, rows, 1) == brute(rows, 1)
