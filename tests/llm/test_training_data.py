"""Each operator against a brute-force version, on a small fixture with nulls, ties, copies and clashing columns."""

import hashlib
import html
import json
import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lodestream.llm import balanced_mix, chat_format, common, decontaminate, dom, elias_fano, licenses, near_copies, ngram_lm, quality_rules, registry, sharding, simhash, templates, token_lengths, wrapper_extract

FOLDER = "/root/testdata/sf0.001"
GAP = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["text_key", "row", "own", "removed", "cut", "id", "nth", "copies", "_key", "_h", "_n", "size", "fp", "shard", "kept"]


def sample(seed=0, n=160):
    """Documents with shared lines, near copies, repeats, nulls, blanks and one long text."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    line = lambda k: " ".join(rng.choice(words) for _ in range(k))
    footer = "All Rights  reserved by the example host today"
    rows = [(900, None, "en", "a", None), (901, "", "en", None, 0), (902, " \n\t ", None, "a", 4), (None, "one two three", "en", "b", 13), (903, line(3000), "en", "b", None)]
    for i in range(n):
        source = rng.choice(["a", "a", "b", "c", None])
        text = "\n".join(line(rng.randint(10, 40)) for _ in range(rng.randint(1, 5)))
        if source == "a" and i % 2:
            text += "\n" + footer
        if i % 17 == 0:
            text = "\n".join([line(6)] * 12)
        rows.append((i, text, "en", source, len(text)))
        if i % 10 == 0:
            rows += [(i + 1000, text, "en", source, len(text)), (i + 2000, text.replace("w1 ", "w2 ", 1), "en", source, len(text))]
    rows += [rows[7], rows[7]]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return GAP.findall(text or "")


# ---------------------------------------------------------------- 1


def chained(*values):
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def brute_quality(rows, limits=quality_rules.Limits()):
    lines_of = lambda t: [x for x in (t or "").split("\n") if words(x)]
    normal = lambda x: " ".join(words(x)).lower()
    seen = defaultdict(set)
    for _, t, _, s, _ in rows:
        w = words(t)
        triples = [chained(*w[i : i + 3]) for i in range(len(w) - 2)]
        identities = tuple(min((h ^ m for h in triples), default=chained(t or "")) for m in quality_rules.MASKS)
        for x in lines_of(t):
            seen[s, normal(x)].add((t or "", identities))
    frequent = set()
    for key, texts in seen.items():
        n = max(len({i[k] for _, i in texts}) for k in range(quality_rules.IDENTITIES))
        if len(texts) > limits.max_docs and n > limits.max_docs and n >= limits.min_spread * len(texts):
            frequent.add(key)
    out = []
    for d, t, _, s, _ in rows:
        w = words(t)
        triples = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        own = lines_of(t)
        removed = sum(len(words(x)) for x in own if (s, normal(x)) in frequent)
        failed = len(w) < limits.min_words or 100 * len(covered) > limits.max_repeat_percent * len(w)
        kept = not failed and not len(w) - removed < limits.min_left * len(w)
        symbols = sum((t or "").count(c) for c in "#*$%&|<>")
        out.append((d, len(w), sum(map(len, w)), symbols, len(own) - len(set(own)), len(covered), failed, kept, removed))
    return out


def test_quality_report(docs):
    got = [tuple(r) for r in quality_rules.quality_report(docs).collect()]
    want = brute_quality(sample())
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(r[-1] for r in want) and any(r[6] for r in want) and any(r[7] for r in want)


def test_quality_filter_cuts_lines_and_keeps_columns(docs, clashing):
    kept = Counter(r[0] for r in brute_quality(sample()) if r[7])
    out = quality_rules.apply_quality_rules(clashing)
    assert out.columns == clashing.columns
    rows = out.collect()
    assert Counter(r.doc_id for r in rows) == kept
    assert all(r.text_key == "own text_key" and r.n_chars == len(r.text) and "Rights  reserved" not in r.text for r in rows)


def test_boilerplate_of_depleted_documents_and_beside_near_copies(spark):
    rng = random.Random(8)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows, footer = [], line(12)
    for host, share in (("h80", 0.8), ("h85", 0.85), ("h90", 0.9)):
        template = [line(round(120 * share) // 4) for _ in range(4)]
        rows += [(host, "\n".join([*template, line(120 - 4 * len(template[0].split()))]), 4 * len(template[0].split())) for _ in range(100)]
    rows += [("mixed", line(90) + "\n" + footer, 12) for _ in range(60)]
    article = [line(20).split() for _ in range(9)]
    for _ in range(600):
        copy = [list(x) for x in article]
        for _ in range(2):
            rng.choice(copy)[rng.randrange(20)] = line(1)
        rows.append(("mixed", "\n".join(map(" ".join, copy)) + "\n" + footer, 12))
    # few groups of copies share a line: not boilerplate; many groups do: boilerplate
    for host, groups, cut in (("few", 4, 0), ("many", 14, 12)):
        for k in range(groups):
            body = [line(30) for _ in range(4)]
            rows += [(host, "\n".join([*body[:3], body[3] + " " + line(2), footer]), cut) for _ in range(15)]
    df = spark.createDataFrame([(i, t, "en", h, len(t)) for i, (h, t, _) in enumerate(rows)], SCHEMA).repartition(4)
    got = {r.doc_id: r.n_removed_words for r in quality_rules.quality_report(df).collect()}
    wrong = Counter((h, n, got[i]) for i, (h, _, n) in enumerate(rows) if got[i] != n)
    assert not wrong, wrong


# ---------------------------------------------------------------- 2


@pytest.mark.parametrize(
    "source, values, want",
    [
        ("{{ 1 + 2 * 3 }}", {}, "7"),
        ("{% if a and not b %}x{% elif b %}y{% else %}z{% endif %}", {"a": 1, "b": 2}, "y"),
        ("{% for m in ms -%} {{ loop.index }}{{ m.x | upper }}{% if not loop.last %},{% endif %} {%- endfor %}", {"ms": [{"x": "a"}, {"x": "b"}]}, "1A,2B"),
        ("{% for m in ms %}x{% else %}none{% endfor %}", {"ms": []}, "none"),
        ("{% set v = 'a' ~ 1 %}{{ v }}{# gone #}{{ missing }}{{ v.__class__ }}", {}, "a1"),
        ("{{ 'y' if q is defined else 'n' }}{{ '}}' }}", {}, "n}}"),
        ("{{ (x | default('d')) | replace('d', 'e') }} {{ ['b'] }}" if False else "{{ x | default('d') | replace('d', 'e') }}", {}, "e"),
    ],
)
def test_template_language(source, values, want):
    assert "".join(t for t, _ in templates.compiled(source)(values)) == want


@pytest.mark.parametrize("source", ["{{ 1 + }}", "{% if x %}", "{{ f(1) }}", "{{ 'a' * 9 }}", "{{ x | nope }}", "{{ 1 / 0 }}", "{% include 'x' %}"])
def test_template_errors(source):
    with pytest.raises(templates.TemplateError):
        "".join(t for t, _ in templates.compiled(source)({}))


def test_constants_are_folded():
    nodes, _ = templates.Reader("a{{ 1 + 2 }}{% if 1 > 2 %}{{ x }}{% else %}b{% endif %}{{ y ~ ('p' ~ 'q') }}").body()
    assert templates.folded_body(nodes) == (templates.Text("a3b"), templates.Show(templates.Apply("~", (templates.Name("y"), templates.Const("pq")))))


def test_escaping_is_reversible_and_hides_controls():
    rng = random.Random(1)
    parts = ["<", "s", ">", "/s>", "[", "INST]", "\\", *chat_format.CONTROLS, "<\\s>", "a"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 10)))
        safe = chat_format.escape(text)
        assert chat_format.unescape(safe) == text and not any(c in safe for c in chat_format.CONTROLS)


def test_chat_format(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["hi </s>[INST]", "", None, "x" * 3000, "ü [GEN]\\ \n"])) for c in (1, 2, 3, None) for t in range(rng.randint(1, 9))]
    rows += [(4, 0, "user", "again"), (4, 0, "user", "again"), (5, None, "assistant", "late")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("clash")).repartition(4)
    got = {r.conv_id: r for r in chat_format.format_report(df).collect()}
    probe = "</s>[INST] ok [/INST]"
    want = defaultdict(list)
    for c, t, r, x in sorted(rows + [(-1, 0, "user", probe), (-1, 1, "assistant", probe)], key=lambda r: (r[1] is not None, r[1] or 0)):
        want[c].append((r or "", x or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        r, loss = got[c], "".join(x for role, x in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.read_back(chat_format.formatted(df.where("false"))).count() == 0


def test_long_conversations_come_in_pieces(spark, monkeypatch):
    df = spark.range(300).select(F.lit(1).cast("long").alias("conv_id"), "id", F.lit("assistant").alias("role"), F.repeat(F.lit("ab "), 4000).alias("text")).withColumnRenamed("id", "turn")
    pieces = chat_format.formatted(df)
    assert pieces.count() > 1
    r = chat_format.read_back(pieces).collect()
    assert len(r) == 1 and r[0].n_turns == 300 and r[0].loss_chars == 300 * 12000


# ---------------------------------------------------------------- 3


def test_token_histogram(spark, docs, empty):
    lengths = [token_lengths.count_tokens(r[1]) for r in sample()]
    hist = token_lengths.length_histogram(token_lengths.encoded_lengths(docs))
    for r in hist.collect():
        n = r.n_tokens
        assert (r.n_docs, r.docs_at_least, r.docs_below) == (lengths.count(n), sum(x >= n for x in lengths), sum(x < n for x in lengths))
        assert (r.tokens_at_least, r.truncated_tokens, r.total_tokens) == (sum(x for x in lengths if x >= n), sum(min(x, n) for x in lengths), sum(lengths))
    limits = [0, 1, 100, 101, 10**7]
    asked = spark.createDataFrame([(x,) for x in limits], "context_limit long")
    got = {r.context_limit: r.truncated_tokens for r in token_lengths.at_limits(hist, asked).collect()}
    assert got == {x: sum(min(v, x) for v in lengths) for x in limits}
    ordered = sorted(lengths)
    got = {float(r.quantile): r.n_tokens for r in token_lengths.quantiles(hist, [0.5, 0.9]).collect()}
    assert got == {q: ordered[math.ceil(q * len(ordered)) - 1] for q in (0.5, 0.9)}
    assert token_lengths.length_histogram(token_lengths.encoded_lengths(empty)).count() == 0


def test_pieces_encode_like_the_whole():
    text = " ".join(f"word{i} of, the" for i in range(3000))
    encode = token_lengths._encoding(token_lengths.TOKENIZER).encode_ordinary
    assert sum(len(encode(p)) for p in token_lengths.pieces(text, 500)) == len(encode(text))


# ---------------------------------------------------------------- 4


def test_shards(docs, clashing, empty):
    rows = sharding.shard_report(docs).collect()
    n = len(sample())
    assert len(rows) == n
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert max(map(len, by.values())) - min(len(by.get(s, [])) for s in range(40)) <= 1
    for s, own in by.items():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in sample())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    few = sharding.shard_report(docs, 4).collect()
    share = Counter(r.source for r in few)
    for s in range(4):
        own = Counter(r.source for r in few if r.shard == s)
        assert all(abs(own[k] - v / 4) <= 2 for k, v in share.items())
    out = sharding.shard_rows(clashing)
    assert out.columns == [c for c in clashing.columns if c != "shard"] + ["shard", "slot"] and out.count() == n
    assert out.where("row <> 'own row' or size <> 'own size'").count() == 0
    assert sharding.shard_rows(empty).count() == 0


# ---------------------------------------------------------------- 5


def test_contamination(spark, docs, clashing, empty):
    rng = random.Random(3)
    texts = [r[1] for r in sample() if r[1] and len(words(r[1])) > 60]
    items = [(0, None), (1, "..."), (2, "never seen words in any of these"), (3, "w1")]
    for i in range(12):
        w = words(rng.choice(texts))
        at = rng.randint(0, len(w) - 40)
        part = w[at : at + rng.choice([5, 8, 25, 40])]
        if i % 4 == 3:
            part[len(part) // 2] = "changed"
        items.append((10 + i, " ".join(part).upper() + "!"))
    grams = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"[^\W_]+", (t or "").lower())] if w for i in range(max(len(w) - 4, 1))}
    want = Counter()
    for d, t, *_ in sample():
        g = grams(t)
        for i, x in items:
            if grams(x) and len(g & grams(x)) / len(grams(x)) >= 0.8:
                want[d, i, len(grams(x)), len(g & grams(x))] += 1
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(tuple(r)[:4] for r in decontaminate.contamination(docs, bench).collect())
    assert got == want and sum(want.values()) > 8
    bad = {d for d, *_ in want}
    out = decontaminate.decontaminate(clashing, bench)
    assert out.columns == clashing.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter(d for d, *_ in sample() if d not in bad)
    assert decontaminate.contamination(empty, bench).count() == decontaminate.contamination(docs, bench.where("false")).count() == 0


def test_minima_follow_the_size(spark):
    for n in (1000, 60):
        df = spark.range(n).agg(F.collect_list(F.xxhash64("id")).alias("h"))
        for e in (-3, 0, 3, 9):
            found = df.select(F.size(decontaminate.minima(F.col("h"), e))).first()[0]
            assert found >= 0.9 * n * decontaminate.met_share(e) - 6, (n, e)
    assert decontaminate.resolution(1) > decontaminate.resolution(8) > decontaminate.resolution(60)


@pytest.mark.parametrize("size", [5, 9, 30, 120])
def test_candidates_are_found(spark, size):
    """Recall of the search alone, before verification, for items of one size in long and short documents."""
    rng = random.Random(size)
    docs, items = [], []
    for i in range(150):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([150, 600, 5000]))]
        part = w[(at := rng.randrange(len(w) - size)) : at + size]
        if size > 25:
            part[size // 2] = "changed"
        docs.append((i, " ".join(w)))
        items.append((i, " ".join(part)))
    found = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sum(r.doc_id == r.item_id for r in found) >= 0.98 * len(items) and all(r.doc_id == r.item_id for r in found)


# ---------------------------------------------------------------- 6


def test_elias_fano():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (1000, 50), (5000, 10**9), (300, 2**62)):
        values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        sequence = elias_fano.EliasFano.of(values)
        assert (sequence.get(np.arange(n)) == values).all()
        distinct = np.unique(values)
        found = elias_fano.EliasFano.of(distinct)
        assert (found.find(distinct) == np.arange(len(distinct))).all()
        if n:
            absent = np.setdiff1d(rng.integers(0, top, 200).astype(np.uint64), distinct)
            assert (found.find(absent) == -1).all()


@pytest.mark.parametrize("order", [2, 3])
def test_language_model(docs, empty, order):
    toks = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in words(t)] + ["</end>"]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    train = [toks(t) for d, t, *_ in sample() if not held(d)]
    uni = Counter(w for t in train for w in t)
    total, vocabulary = sum(uni.values()), len(uni)
    grams = {}
    for n in range(2, order + 1):
        counts = Counter(tuple((["<b>"] + t)[i : i + n]) for t in train for i in range(len(t) + 1 - n + 1))
        grams[n] = {g: c for g, c in counts.items() if c >= 2 and (n == 2 or g[:-1] in grams[n - 1])}
    contexts = dict(uni) | {"<b>": len(train)}
    full = {n: Counter(tuple((["<b>"] + t)[i : i + n]) for t in train for i in range(len(t) + 1 - n + 1)) for n in range(2, order + 1)}

    def prob(history, w):
        p = (uni.get(w, 0) + 1) / (total + vocabulary + 1)
        for n in range(2, order + 1):
            if len(history) < n - 1:
                break
            c = tuple(history[-(n - 1) :])
            own = {g[-1]: k for g, k in grams[n].items() if g[:-1] == c} if c in by_context[n] else {}
            if n > 2 and c not in grams[n - 1]:
                continue
            base = contexts.get(c[0], 0) if n == 2 else full[n - 1][c]
            if own:
                listed = {x: (k - 0.75) / base for x, k in own.items()}
                p = listed.get(w, 0.0) + (1 - sum(listed.values())) * p
        return p

    by_context = {n: {g[:-1] for g in grams[n]} for n in grams}
    got = {}
    for r in ngram_lm.score_report(docs, order).collect():
        got[r.doc_id] = r
    assert len(got) == len({r[0] for r in sample()})
    for d, t, *_ in sample():
        r, tokens = got[d], toks(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(d), len(tokens), sum(w in uni for w in tokens), total)
        assert r.base_score == pytest.approx(sum(math.log10((uni.get(w, 0) + 1) / (total + vocabulary + 1)) for w in tokens), abs=1e-6)
        history, score = ["<b>"], 0.0
        for w in tokens:
            score += math.log10(prob(history, w))
            history.append(w)
        assert r.score == pytest.approx(score, rel=2e-3, abs=0.01)
    if order == 2:
        assert ngram_lm.score_report(empty).count() == 0
        model = ngram_lm.train(empty)
        assert all(r.score == 0 for r in ngram_lm.score(docs, model).where("n_tokens = 1").collect())


@pytest.mark.parametrize("part", [1 << 20, 700])
def test_registered_language_model_lists_every_trigram(spark, monkeypatch, docs, part):
    monkeypatch.setattr(ngram_lm, "PART", part)
    toks = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in words(t)] + ["</end>"]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    train = [toks(t) for d, t, *_ in sample() if not held(d)]
    uni = Counter(w for t in train for w in t)
    full = {n: Counter(tuple((["<b>"] + t)[i : i + n]) for t in train for i in range(len(t) + 2 - n)) for n in (2, 3)}
    after = {c: Counter() for n in (2, 3) for c in {g[:-1] for g in full[n]}}
    for n in (2, 3):
        for g, k in full[n].items():
            after[g[:-1]][g[-1]] = k

    def prob(history, w):
        p = (uni.get(w, 0) + 1) / (sum(uni.values()) + len(uni) + 1)
        for c in (tuple(history[-1:]), tuple(history[-2:])):
            if c in after:
                n = full[2][c] if len(c) == 2 else uni.get(c[0], len(train))
                listed = {x: (k - 0.75) / n for x, k in after[c].items()}
                p = listed.get(w, 0) + (1 - sum(listed.values())) * p
            if len(history) == 1:
                break
        return p

    monkeypatch.setattr(registry, "read", lambda *_: docs)
    got = {r.doc_id: r.score for r in registry.op6_ngram_lm(spark, FOLDER).collect()}
    for d, t, *_ in sample():
        if d is not None and d < 900:
            history, want = ["<b>"], 0.0
            for w in toks(t):
                want += math.log10(prob(history, w))
                history.append(w)
            assert got[d] == pytest.approx(want, rel=2e-4, abs=2e-3 * len(history)), d


def test_probabilities_sum_to_one_over_parts(docs, monkeypatch):
    """Levels cut into many parts, in which one frequent context's successors spread over several."""
    import numpy as np

    monkeypatch.setattr(ngram_lm, "PART", 512)  # parts are cut on the driver, from the number of tokens
    model = ngram_lm.train(docs, 3, 1)
    assert len(model.levels[0].paths) > 4 and len(model.levels[1].paths) > 4
    vocabulary = model.words.entries
    every = np.concatenate((np.arange(vocabulary + 1), [-1]))  # words, the end, and what is unknown
    for history in ([model.end], [model.end, 0], [5, 7], [model.end, 3]):
        ids = np.array([h for w in every for h in (*history, w)], np.int64)
        previous = np.concatenate(([model.end], ids[:-1]))
        counts = np.full(len(ids), 0, np.int64)
        known = ids >= 0
        counts[known] = ngram_lm.counts_of(model, ids[known])
        prob = (counts + 1) / model.floor_mass()
        ngram_lm.contexts_of(model, ids, previous, 2, prob)
        assert prob[len(history) :: len(history) + 1].sum() == pytest.approx(1, abs=2e-3)


# ---------------------------------------------------------------- 7


def test_mixture(docs, clashing, empty):
    rows = balanced_mix.mix_report(docs).collect()
    assert len(rows) == len(sample())
    sizes = defaultdict(int)
    for _, t, _, s, _ in sample():
        sizes[s] += len(words(t))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        for s in over or set(open_):
            target[s] = 3.0 * sizes[s] if over else level * weight[s]
            left -= target[s] if over else 0
            open_.discard(s)
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken <= 3 * r.size
        taken[r.source] += r.taken
    largest = max(r.size for r in rows)
    assert all(abs(taken[s] - target[s]) <= 2 * largest for s in names)
    again = balanced_mix.mix_report(docs.repartition(2)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))
    out = balanced_mix.mix(clashing)
    # draws follow hashes of whole rows
    assert out.columns == clashing.columns and out.count() == balanced_mix.mix_report(clashing).agg(F.sum("copies")).first()[0]
    assert out.where("copies <> 'own copies'").count() == 0
    assert balanced_mix.mix(empty).count() == balanced_mix.mix_report(empty).count() == 0


def test_flight_keeps_the_balance():
    rng = random.Random(4)
    pi = [rng.random() for _ in range(500)]
    size = [float(rng.randint(1, 900)) for _ in pi]
    out = balanced_mix.flight(pi, size, rng, land=False)
    assert sum(0 < p < 1 for p in out) <= 2
    assert sum(out) == pytest.approx(sum(pi), abs=1e-6) and sum(p * s for p, s in zip(out, size)) == pytest.approx(sum(p * s for p, s in zip(pi, size)), abs=1e-3)


def test_many_equal_rows_spread(spark, monkeypatch):
    """60,000 equal rows beside others: blocks stay short, every row is dealt, and reruns agree."""
    blocks = []
    df = spark.range(60_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same text here").alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(14).cast("long").alias("n_chars"))
    others = spark.range(3000).select("id", F.concat(F.lit("other "), F.col("id")), F.lit("en"), F.when(F.col("id") % 2 == 0, "a").otherwise("b"), F.lit(9).cast("long"))
    docs = df.union(others)
    stored = common.stored

    def spied(df, name):
        out = stored(df, name)
        if name == "flight0":
            blocks.append(out.groupBy("source", "block").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(common, "stored", spied)
    report = balanced_mix.mix_report(docs)
    assert max(blocks) <= 1.15 * balanced_mix.BLOCK and report.count() == 63_000
    again = balanced_mix.mix_report(docs.repartition(5))
    key = lambda d: d.groupBy(*d.columns).count().agg(F.sum(F.xxhash64(*d.columns, "count").cast("decimal(38,0)"))).first()[0]
    assert key(report) == key(again)
    assert balanced_mix.mix(docs).count() == report.agg(F.sum("copies")).first()[0]
    shards = sharding.shard_rows(docs)
    counts = [r["count"] for r in shards.groupBy("shard").count().collect()]
    assert sum(counts) == 63_000 and max(counts) - min(counts) <= 1
    assert shards.where("doc_id = 7").groupBy("shard").count().agg(F.min("count")).first()[0] > 1000
    assert shards.select("shard", "slot").distinct().count() == 63_000


def test_rows_equal_but_for_another_column_stay_apart(spark):
    rows = [(1, "a b", "en", "s", 3), (1, "a b", "de", "s", 3), (1, "a b", "de", "s", 3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert Counter(r.lang for r in sharding.shard_rows(docs, 2).collect()) == {"en": 1, "de": 2}
    assert Counter(r.lang for r in balanced_mix.mix(docs).collect()) == {"en": 1, "de": 2}


def test_broadcasts_are_bounded_by_bytes(spark):
    wide = common.stored(spark.range(50).select(F.array_repeat("id", 1000).alias("a")), "wide")
    assert "broadcast" in common.small(wide)._jdf.queryExecution().toString()
    assert "broadcast" not in common.small(wide, max_bytes=100_000)._jdf.queryExecution().toString()
    assert "broadcast" not in common.small(wide, max_rows=49)._jdf.queryExecution().toString()


# ---------------------------------------------------------------- 8


def brute_fingerprint(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    fps = sorted(root)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def test_simhash(docs, clashing, empty):
    fps = [(d, t, brute_fingerprint(t)) for d, t, *_ in sample()]
    root = brute_components({f for _, _, f in fps})
    least = {}
    for d, _, f in fps:
        if d is not None:
            least[root[f]] = min(least.get(root[f], d), d)
    want = Counter((d, f"{f:016x}", least.get(root[f])) for d, _, f in fps)
    assert Counter(map(tuple, simhash.near_duplicate_report(docs).collect())) == want
    assert len(set(least.values())) < len({f for _, _, f in fps})
    out = simhash.deduplicate(clashing)
    assert out.columns == clashing.columns
    rows = out.collect()
    assert sorted(root[brute_fingerprint(r.text)] for r in rows) == sorted(set(root.values()))
    assert {r.doc_id for r in rows} >= set(least.values())
    assert simhash.deduplicate(empty).count() == simhash.near_duplicate_report(empty).count() == 0


@pytest.mark.parametrize("large", [4, 512])
def test_links_of_close_fingerprints(spark, monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE_BUCKET", large)
    rng = random.Random(5)
    fps = {0}
    for _ in range(12):
        base = rng.getrandbits(64)
        fps |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(25)}
        fps |= {(base & ~0xFFFF) | rng.getrandbits(16) for _ in range(10)}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = [frozenset((r.u, r.v)) for r in simhash.links(df).collect()]
    want = {frozenset((signed(a), signed(b))) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    assert len(got) == len(set(got)) and set(got) == want


def shingle_set(text, n=5):
    w = [x.lower() for x in words(text)]
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, min(len(w), 1)))}


def brute_groups(texts, kept, least_recall=0.9):
    """Holds what stays of texts (by doc_id) against the groups of texts with a Jaccard coefficient of 0.8 or more."""
    sets = {d: shingle_set(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if texts[a] == texts[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    groups = defaultdict(set)
    for d in ids:
        groups[find(d)].add(d)
    assert all(g & kept and min(g) in kept for g in groups.values())
    assert len(ids) - len(kept) >= least_recall * (len(ids) - len(groups)) > 0


def test_near_copies(spark, clashing, empty):
    rng = random.Random(9)
    texts, n = {}, 0
    for _ in range(120):
        body = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([40, 100, 400]))]
        for _ in range(rng.choice([1, 2, 4])):
            copy = list(body)
            for _ in range(rng.randint(0, max(1, len(body) // 60))):
                copy[rng.randrange(len(copy))] = "edited"
            texts[n] = " ".join(copy)
            n += 1
    texts |= {n: "", n + 1: " ", n + 2: "one", n + 3: "ONE", n + 4: "one two"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    brute_groups(texts, {r.doc_id for r in near_copies.deduplicate(df).collect()})
    out = near_copies.deduplicate(clashing)
    assert out.columns == clashing.columns and out.where("row <> 'own row'").count() == 0
    rows = out.collect()
    assert len({r.text for r in rows}) == len(rows) and sum(not words(r.text) for r in rows) == 1
    brute_groups({d: t or "" for d, t, *_ in sample() if d is not None}, {r.doc_id for r in rows})
    assert near_copies.deduplicate(empty).count() == 0


def test_large_group_of_near_copies(spark):
    """Hundreds of different near copies become one row, through a number of candidates that grows with their number."""
    rng = random.Random(10)
    body = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = [(i, " ".join(body[: (k := rng.randrange(199))] + [f"e{i}"] + body[k + 1 :])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    fps = common.stored(near_copies._fingerprints(df).select("text_key", "fp"), "fps")
    assert near_copies._candidates(fps).count() < 600 * near_copies.SEGMENTS * near_copies.SEGMENT
    assert [r.doc_id for r in near_copies.deduplicate(df).collect()] == [0]


@pytest.mark.parametrize("shared", [0, 0.4, 0.6])
def test_recall_of_single_pairs(spark, shared):
    """Each band of coefficients from 0.8 on, also where all texts share a passage of this part of their words, so that buckets are crowded."""
    rng = random.Random(12)
    passage = [f"p{rng.randrange(5000)}" for _ in range(480)]
    bands, n, pairs, texts = (0.8, 0.85, 0.9, 0.95), 150, {}, {}
    for band in bands:
        for _ in range(n):
            size = rng.choice([60, 120, 250, 800][2 * (band > 0.85) :])  # an edit of a short text changes more
            head = passage[: int(shared * size)]
            body = head + [f"w{rng.randrange(50000)}" for _ in range(size - len(head))]
            copy, least = list(body), 1.0
            own, want = shingle_set(" ".join(body)), rng.uniform(band, band + 0.05)
            while least > want or copy == body:
                tried = list(copy)
                tried[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
                other = shingle_set(" ".join(tried))
                least = len(own & other) / len(own | other)
                if least >= band:
                    copy = tried
            pair = len(texts), len(texts) + 1
            texts |= dict(zip(pair, (" ".join(body), " ".join(copy))))
            pairs[pair] = band
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    fps = common.stored(near_copies._fingerprints(df), "fps")
    id_of = {r.text_key: r.doc_id for r in fps.select("text_key", "doc_id").collect()}
    found = {tuple(sorted((id_of[r.u], id_of[r.v]))) for r in near_copies.similar_texts(df, fps.select("text_key", "fp")).collect()}
    recall = Counter(pairs[p] for p in found & set(pairs))
    assert all(recall[b] >= 0.9 * n for b in bands), recall
    sets = {d: shingle_set(t) for d, t in texts.items()}
    assert all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in found)


def test_no_pair_at_the_threshold_is_missed(spark):
    """Pairs at a coefficient of hardly more than 0.8, some hundred words beside a passage common to many."""
    rng = random.Random(17)
    passage = [f"p{k}" for k in range(60)]
    texts = {}
    for n in range(700):
        body = passage[: 60 * (n % 2)] + [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([30, 80]))]
        copy, own = list(body), shingle_set(" ".join(body))
        for _ in range(20):
            tried = list(copy)
            tried[rng.randrange(len(tried))] = f"e{rng.randrange(10**6)}"
            other = shingle_set(" ".join(tried))
            if len(own & other) >= 0.8 * len(own | other):
                copy = tried
        texts |= {2 * n: " ".join(body), 2 * n + 1: " ".join(copy)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    brute_groups(texts, {r.doc_id for r in near_copies.deduplicate(df.unionByName(df.where("doc_id < 40"))).collect()}, 1)


def test_signatures_lose_no_similar_pair():
    """Signatures never differ in more bits than the sets in shingles, whatever their lengths; unrelated sets differ in many."""
    rng = np.random.default_rng(19)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 700)).astype(np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < rng.random()], rng.integers(0, 2**63, rng.integers(0, 300)).astype(np.uint64))))
        least = near_copies.least_difference(near_copies.signature(a), near_copies.signature(b))
        assert least <= len(np.setxor1d(a, b)) and least == near_copies.least_difference(near_copies.signature(b), near_copies.signature(a))
    a, b = (rng.integers(0, 2**63, 800).astype(np.uint64) for _ in "ab")
    assert near_copies.least_difference(near_copies.signature(a), near_copies.signature(b)) > 1600 / 9


def test_shingle_sets_of_texts_with_a_common_passage_stay_where_they_are(spark, monkeypatch):
    """Texts that meet in a bucket by a common passage are told apart by their signatures; no shingle set is gathered or stored for them."""
    rng = random.Random(20)
    passage = [f"p{k}" for k in range(150)]
    texts = {i: " ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(150)]) for i in range(60)}
    texts |= {60: " ".join([*texts[0].split(), *"a b c d e f g h i j".split()])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    counts, stored = {}, common.stored

    def counting(df, name):
        out = stored(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(common, "stored", counting)
    monkeypatch.setattr(near_copies, "SAMPLE", 1)
    groups = stored(spark.createDataFrame([], "u long, v long"), "groups")
    missed = near_copies.missed_links(df, groups, len(texts)).collect()
    key = {r.doc_id: r.k for r in df.select("doc_id", F.xxhash64("text").alias("k")).collect()}
    assert [{r.u, r.v} for r in missed] == [{key[0], key[60]}]
    assert counts["missed"] > 50 and counts["shingle_sets"] < 10


@pytest.mark.parametrize("crowded", (1, near_copies.CROWDED))
def test_pairs_of_a_passage_unknown_to_the_sample_grow_with_the_rows(spark, monkeypatch, crowded):
    """However many texts share a passage that the sample does not show, their pairs grow no faster; all links are found, also in crowded buckets."""
    rng = random.Random(23)
    passage = [f"p{k}" for k in range(30)]
    own = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    made, counts, stored = [passage + own(30) for _ in range(600)], {}, common.stored
    base = own(60)
    for _ in range(40):  # many hardly similar copies of one text
        copy = list(base)
        for at in rng.sample(range(60), rng.choice([1, 2])):
            copy[at] = f"e{rng.randrange(10**6)}"
        made.append(copy)
    made += [[*text, "e"] for text in made[:20]]
    texts = {i: " ".join(words) for i, words in enumerate(made)}

    def counting(df, name):
        out = stored(df, name)
        counts[name] = counts.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(common, "stored", counting)
    monkeypatch.setattr(near_copies, "SAMPLE", 1)
    monkeypatch.setattr(near_copies, "CROWDED", crowded)
    for n in (300, len(texts)):
        counts.clear()
        some = {i: t for i, t in texts.items() if i < n}
        df = spark.createDataFrame(list(some.items()), "doc_id long, text string").repartition(3)
        missed = near_copies.missed_links(df, stored(spark.createDataFrame([], "u long, v long"), "groups"), n).collect()
        assert counts["missed"] + counts.get("missed_again", 0) < 12 * n, counts
    key = {r.k: r.doc_id for r in df.select("doc_id", F.xxhash64("text").alias("k")).collect()}
    sets = {d: shingle_set(t) for d, t in texts.items()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {tuple(sorted((key[r.u], key[r.v]))) for r in missed} == want and len(want) > 40


def test_words_and_pairs_in_bulk():
    """Words of many texts split at once are those of each text; pairs are ordered and counted alike, also where no number holds both."""
    rng = random.Random(21)
    texts = [None, "", " \t\x0b ", " A b  b\tc\n", "\xc9a \xe9 x \x1f y\xa0z", *(" ".join(rng.choice("aAbB\u0130") * rng.randint(1, 3) for _ in range(rng.randint(0, 30))) for _ in range(200))]
    for some in (texts, texts[:3], []):
        hashes, codes, lengths = ngram_lm._words(pa.array(some, pa.string()))
        own = [ngram_lm.token_hashes(t) for t in some]
        assert len(set(hashes.tolist())) == len(hashes) and lengths.tolist() == [len(o) for o in own]
        assert hashes[codes].tolist() == [h for o in own for h in o.tolist()]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    assert [t for s in ngram_lm._slices(iter([batch]), 0) for t in s.column(0).to_pylist()] == texts
    g = np.random.default_rng(22)
    for step in (1, 1 << 40):
        context, word = g.integers(0, 9, 500) * step, g.integers(-1, 5, 500)
        word = np.where((word > 0) & (step > 1), word << 28, word)
        want = Counter(zip(context.tolist(), word.tolist()))
        for places in (False, True):
            c, w, n, back = ngram_lm._distinct_pairs(context, word, places)
            assert list(zip(c.tolist(), w.tolist(), n.tolist())) == [(*k, want[k]) for k in sorted(want)]
            assert not places or ((c[back] == context).all() and (w[back] == word).all())
        order = ngram_lm._in_order(context, np.abs(word))
        pairs = list(zip(context.tolist(), np.abs(word).tolist()))
        assert [pairs[i] for i in order] == sorted(pairs)
    for bits in (1, 7, 8, 31, 33, 63):
        values = g.integers(0, 2**63, 70_001).astype(np.uint64) >> np.uint64(63 - bits)
        assert (elias_fano.unpack(elias_fano.pack(values, bits), bits, np.arange(len(values))) == values).all()


def test_leading_shingles_and_pairs_of_groups():
    rng = np.random.default_rng(18)
    for _ in range(50):
        a = np.unique(rng.integers(0, 400, rng.integers(1, 120)).astype(np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.9], rng.integers(400, 500, rng.integers(0, 12)).astype(np.uint64))))
        known = np.unique(rng.integers(0, 500, 30).astype(np.uint64))
        frequent = (known, rng.integers(2, 9, len(known)))
        if len(b) and len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            assert len(np.intersect1d(near_copies.leading(a, 0.8, frequent), near_copies.leading(b, 0.8, frequent)))
    rows = sorted((int(g), int(r), 10 * int(r) + int(k)) for g, r, k in zip(rng.integers(0, 6, 400), rng.integers(0, 4, 400) ** 2, rng.integers(0, 9, 400)))
    sizes = [10 + key % 7 for *_, key in rows]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in (*map(list, zip(*rows[i : i + 37])), sizes[i : i + 37])], names=["gram", "root", "key", "size"]) for i in range(0, 400, 37)]
    got = {tuple(sorted(p)) for batch in near_copies._pairs(iter(batches), 0.8) for p in zip(*(c.to_pylist() for c in batch.columns))}
    like = lambda x, y: min(x, y) >= 0.8 * max(x, y)
    assert got == {(x[2], y[2]) for x in rows for y in rows if x[0] == y[0] and x[1] != y[1] and x[2] < y[2] and like(10 + x[2] % 7, 10 + y[2] % 7)}


def test_neighbours_of_a_bucket_over_many_tasks(spark):
    """However a bucket's ids are cut into batches and tasks, borders and pairs connect them; buckets stay apart."""
    rng = np.random.default_rng(11)
    for n_keys in (1, 3, 40):
        rows = sorted({(int(k), int(i)) for k, i in zip(rng.integers(0, n_keys, 300), rng.integers(-(2**62), 2**62, 300))})
        cuts = sorted(int(c) for c in rng.integers(0, len(rows), 5))
        met = []
        for task in (rows[i:j] for i, j in zip([0, *cuts], [*cuts, len(rows)])):
            halves = [task[: len(task) // 2], task[len(task) // 2 :]]
            batches = [pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in h], pa.int64()), "id": pa.array([i for _, i in h], pa.int64())}) for h in halves]
            met += [r for out in near_copies._neighbours(iter(batches)) for r in out.to_pylist()]
        borders = defaultdict(list)
        for r in met:
            if r["border"] is not None:
                borders[r["border"]].append(r["a"])
        pairs = [(r["a"], r["b"]) for r in met if r["border"] is None] + [(a, min(g)) for g in borders.values() for a in g]
        assert len(met) - sum(map(len, borders.values())) <= 2 * len(rows) and sum(map(len, borders.values())) <= 3 * 6
        key_of = {i: k for k, i in rows}
        assert all(key_of[a] == key_of[b] for a, b in pairs)
        root = {i: i for i in key_of}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in pairs:
            root[find(a)] = find(b)
        assert len({find(i) for i in root}) == len({k for k, _ in rows})


# ---------------------------------------------------------------- 9


def page(i, body, title="Some title"):
    return f"<html><head><title>x</title><script>var a='</p>';</script></head><body><nav><a href=/>Home {i}</a></nav><div class=note>Read our terms before you go on</div><article><h1>{title}</h1>{body}</article><div class='comments'>first!</div><footer>&copy; host</footer></body></html>"


def test_extraction(spark):
    rows = [(i, "http://h.example/p", page(i, f"<p>Body  number\n{i} &amp; more</p><p>Second <b>bo</b>ld {i}</p>")) for i in range(6)]
    rows += [(90, None, None), (91, "http://h.example/q", ""), (92, "http://h.example/r", "<p>open <i>tags"), (0, *rows[0][1:])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("texts", F.lit("clash"))
    got = wrapper_extract.extract(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i in range(6):
        assert by[i].text.endswith(f"Body number {i} & more\n\nSecond bold {i}")
        assert "first!" not in by[i].text and "Home" not in by[i].text and "host" not in by[i].text and by[i].n_chars == len(by[i].text)
    assert by[90].text == by[91].text == "" and by[92].text == "open tags"
    assert wrapper_extract.extract(df.where("false")).count() == 0


def test_constant_blocks_become_template(spark):
    rows = [(i, "http://k.example/p", f"<div><p>Same sentence on all of our pages</p><p>Own text {i} " + f"word{i} " * 30 + "</p></div>") for i in range(6)]
    got = wrapper_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all("Same sentence" not in r.text and f"Own text {r.page_id}" in r.text for r in got)


def test_content_named_like_furniture_stays():
    texts = lambda source: [t for _, t in dom.blocks(dom.parse(source))]
    body = "<h2 id='related-work'>Related work</h2><h2 id='search-trees'>Trees</h2><section id='social-history'><p>Past</p></section><p>Open <kbd class='menu'>File</kbd> now</p>"
    want = ["Related work", "Trees", "Past", "Open File now"]
    assert texts(f"<nav>Home</nav><article>{body}<div class='share-buttons'>Share</div><div class='related'>More</div></article>") == want
    assert texts(f"<div class='top-menu'>Home</div>{body}<ol><li><a href='#x'>A cited work</a></li></ol><div id='sidebar'>Side</div>") == [*want, "A cited work"]


def test_deep_pages_keep_their_text():
    for depth in (100, 149, 160, 5000):
        source = f"<div><nav>{'<div>' * depth}menu{'</div>' * depth}</nav></div><div><article><p>first</p>{'<div>' * depth}deep{'</div>' * depth}<p>last</p></article></div>"
        root = dom.parse(source)
        assert [t for _, t in dom.blocks(root)] == ["first", "deep", "last"]
        shape, numbers = dom.skeleton(root)
        assert all(i in numbers for i, _ in dom.blocks(root)) and dom.read_skeleton(shape)[0] == "#root"


def test_tree_matching():
    a, b = dom.read_skeleton("r(x(p()) y() z())"), dom.read_skeleton("r(x(p() q()) z())")
    assert dom.simple_tree_matching(a, b) == {0: 0, 1: 1, 2: 2, 4: 4}


# ---------------------------------------------------------------- 10


def test_license_scan(spark, empty):
    rng = random.Random(6)
    texts = [t for _, t in licenses.NOTICES]
    rows = [(0, None), (1, ""), (2, "one"), (3, "\n".join(texts)), (3, "\n".join(texts)), (4, "Released under the MIT License.\nReleased under the MIT License.")]
    rows += [(5, "Copyright 2021 The Authors. Released under the MIT License. See the file for details."), (6, "x " * 30_000 + texts[3])]
    rows += [(7 + i, "# Copyright 2020\n#\n" + "\n".join(f"# {line}" for line in textwrap.wrap(t, 72)) + "\n\nint main() {}") for i, t in enumerate(texts)]
    for i in range(40):
        w = rng.choice(texts).split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "other"
        rows.append((100 + i, "plain line here\n" + " ".join(w[: rng.randint(3, len(w))])))
    normal = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = lambda w: [tuple(w[i : i + 2]) for i in range(max(len(w) - 1, 1))] if w else []
    want = Counter()
    for d, t in rows:
        g = grams(normal(t or ""))
        for k, n in enumerate(texts):
            size, b = len(normal(n)), set(grams(normal(n)))
            best = None
            for i, x in enumerate(g):
                if x in b:
                    a = set(g[i : i + max(size - 1, 1)])
                    dice = 2 * len(a & b) / (len(a) + len(b))
                    if dice >= 0.8 and (best is None or dice > best[0]):
                        best = dice, i
            if best:
                want[d, k, best[1], min(size, len(g) + 1 - best[1]), round(best[0], 9)] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("g", F.lit("clash")).withColumn("license", F.lit("clash"))
    got = Counter((r.doc_id, r.notice_id, r.start, r.n_words, round(r.dice, 9)) for r in licenses.scan(df, licenses.notices(spark)).collect())
    assert got == want and len(want) > 80
    found = {(d, k) for d, k, *_ in want}
    assert all((7 + i, i) in found for i in range(len(texts))) and (5, 2) in found and (6, 3) in found
    assert licenses.scan(empty, licenses.notices(spark)).count() == licenses.scan(df, licenses.notices(spark).where("false")).count() == 0


# ---------------------------------------------------------------- pipeline and registry


def test_pipeline_against_brute_force(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    bench = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    table = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows]
    first = stages["quality_rules"](spark, docs, FOLDER)
    assert first.columns == columns
    kept = {r[0] for r in brute_quality(table) if r[7]}
    assert {r.doc_id for r in first.collect()} == kept
    second = stages["near_duplicates"](spark, first, FOLDER)
    texts = {r.doc_id: r.text for r in first.collect()}
    kept = {r.doc_id for r in second.collect()}
    brute_groups(texts, kept)
    third = stages["decontamination"](spark, second, FOLDER)
    grams = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"[^\W_]+", (t or "").lower())] if w for i in range(max(len(w) - 4, 1))}
    items = [grams(t) for t in bench if grams(t)]
    clean = {d for d in kept if not any(len(g & grams(texts[d])) >= 0.8 * len(g) for g in items)}
    assert {r.doc_id for r in third.collect()} == clean
    fourth = stages["mixing"](spark, third, FOLDER)
    taken = Counter(r.doc_id for r in fourth.collect())
    report = {r.doc_id: r for r in balanced_mix.mix_report(third).collect()}
    assert taken == Counter({d: r.copies for d, r in report.items() if r.copies})
    whole = corpus_pipeline.run(spark, FOLDER)
    assert whole.columns == [*columns, "shard", "slot"]
    assert Counter(r.doc_id for r in whole.collect()) == taken


def test_pipeline_of_awkward_rows(spark, tmp_path):
    """Nulls, blanks, repeated rows and extra columns with clashing names go through all stages; so do empty tables."""
    docs = spark.createDataFrame(sample(), SCHEMA).withColumns({c: F.lit(f"own {c}") for c in ("row", "_key1", "nth", "_piece", "size", "fp")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (2, "w1 w2 w3 w4 w5 w6")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "shard", "slot"] and out.count() > 20
    assert out.where("row <> 'own row' or size <> 'own size'").count() == 0
    counts = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert sum(counts) == out.count() and (len(counts) < 40 or max(counts) - min(counts) <= 1)
    docs.where("false").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registry_names():
    names = registry.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(names)


def test_text_helpers(spark):
    df = spark.createDataFrame([(None,), (" a b \x0bc\t",), ("",)], "t string")
    assert [tuple(r) for r in df.select(common.words(F.col("t")), common.n_words(F.col("t"))).collect()] == [([], 0), (["a b", "c"], 2), ([], 0)]
