"""Wrapper induction: the alignment decides, not the names; and the whole extraction against a plain version."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestream.llm import dom, wrapper_extract

SCHEMA = "page_id long, url string, html string"
RNG = random.Random(11)


def text(n):
    return " ".join(f"w{RNG.randrange(10**6)}" for _ in range(n))


def links(n):
    return "<ul class=z9>" + "".join(f"<li><a href=/{k}>{text(1)}</a></li>" for k in range(n)) + "</ul>"


def nameless(i, paragraphs=4):
    """A page whose elements have no telling names: menu, advert, notice, article and footer are told apart by alignment alone."""
    body = "".join(f"<p>{text(25)}</p>" for _ in range(paragraphs))
    return (
        f"<html><body><div class=q1>{links(4 + i % 3)}</div><div class=q2><span>{text(6)}</span></div><h1>{(head := text(4))}</h1>"
        f"<div class=q3><div class=q4>Please read our terms before you go on</div>{body}</div><div class=q5><div class=q6>&copy; host {text(5)}</div></div></body></html>"
    ), head, [p[3:-4] for p in body.split("</p>") for p in [p + "</p>"] if p != "</p>"]


def extracted(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({k: F.lit("clash") for k in ("host", "text", "blocks", "to", "states")})
    got = {}
    for r in wrapper_extract.extract(df, **more).collect():
        got.setdefault(r.page_id, []).append(r.text)
    return got


def test_alignment_finds_content_without_names(spark):
    pages = [nameless(i) for i in range(8)]
    rows = [(i, "http://n.example/x", page) for i, (page, _, _) in enumerate(pages)]
    got = extracted(spark, rows)
    for i, (_, head, body) in enumerate(pages):
        assert got[i] == ["\n\n".join([head, *body])]
    # with alignment switched off (no host has so many pages) menus, notices and footers come through
    off = extracted(spark, rows, min_pages=100)
    assert all("terms" in off[i][0] and "host" in off[i][0] for i in off)


def test_near_copies_keep_their_content(spark):
    shared = [text(30) for _ in range(4)]
    rows = [(i, "http://c.example/x", f"<body><div class=a1>{links(3)}</div><div class=a2>" + "".join(f"<p>{p}</p>" for p in [*shared, text(8)]) + "</div></body>") for i in range(3)]
    rows += [(i, "http://c.example/x", f"<body><div class=a1>{links(3)}</div><div class=a2>" + "".join(f"<p>{text(25)}</p>" for _ in range(5)) + "</div></body>") for i in (3, 4)]
    got = extracted(spark, rows)
    for i in range(3):
        assert got[i][0].split("\n\n")[:4] == shared


def test_constant_text_goes_only_from_its_slot(spark):
    notice = "About our great site"
    rows = []
    for i in range(6):
        more = f"<p>{notice}</p>" if i == 2 else ""
        rows.append((i, "http://s.example/x", f"<body><div class=b1><h4>{notice}</h4><p>{text(30)}</p><p>{text(20)}</p>{more}</div></body>"))
    got = extracted(spark, rows)
    assert [notice in got[i][0] for i in range(6)] == [False, False, True, False, False, False]


def test_large_slot_named_like_furniture_stays(spark):
    rows = [(i, "http://f.example/x", f"<body><nav>{links(3)}</nav><div class=share-widget><p class=notice>{text(40)}</p></div><footer>{text(4)}</footer></body>") for i in range(5)]
    rows += [(i, "http://g.example/x", f"<body><nav>{links(3)}</nav><div class=post><p>{text(60)}</p><div class=comments><p>{text(10)}</p></div></div></body>") for i in range(5, 10)]
    got = extracted(spark, rows)
    assert all(len(got[i][0].split()) == 40 for i in range(5)) and all(len(got[i][0].split()) == 60 for i in range(5, 10))


@pytest.mark.parametrize(
    "source, want",
    [
        ("<p class=\"x>hello", "hello"),
        ("<p title='a > b'>one</p>", "one"),
        ("İ<SCRIPT>var a='<p>no</p>'</SCRIPT><p>after", "İ|after"),
        ("<style>p{}</STYLE ><p>a&lt;b &amp; c</p>", "a<b & c"),
        ("<script>x</scripty>y</script><p>z</p>", "z"),
        ("<main><p class='ad-hoc'>one</p><p class='share-price'>two</p><div class='related-work'>three</div></main>", "one|two|three"),
        ("<p>a<br>b</p><ol><li><a href=x>A cited work</a></li></ol>", "a b|A cited work"),
        ("<form id=f><article><p>in a form</p></article></form><form><p>ask</p></form>", "in a form"),
        ("<article><header><h1>T</h1><p>by line</p></header><p>x</p></article>", "T|x"),
        ("", ""),
    ],
)
def test_page_rule(source, want):
    assert "|".join(t for _, t in dom.blocks(dom.parse(source))) == want


def plain(rows, min_pages=3, min_share=0.6):
    """The extraction without Spark: one host after the other, all pages of a host together."""
    hosts = defaultdict(list)
    for page_id, url, source in rows:
        root = dom.parse(source or "")
        shape, numbers = dom.skeleton(root)
        blocks = [(numbers.get(b.owner, 0), b) for b in dom.page_blocks(root)]
        name = url.split("/")[2].lower() if url and "://" in url else ""
        main = max(blocks, key=lambda b: (b[1].flags & dom.USUAL, len(b[1].text)), default=None)
        hosts[name].append((page_id, shape, blocks, main and main[1].text))
    out = Counter()
    for pages in hosts.values():
        voting = [p for p in pages if p[2]]
        voters = {p[3] for p in voting}
        content, states, constants, slots_of = -1, [], set(), {}
        if len(voters) >= min_pages:
            n, model = max((sum(q[1] == s for q in voting), s) for s in {p[1] for p in voting})
            tree = dom.read_skeleton(model)

            def aligned(shape):
                mine, to = dom.read_skeleton(shape), {}
                pairs = {i: i for i in range(shape.count("("))} if shape == model else dom.simple_tree_matching(mine, tree)

                def go(node, above):
                    to[node[1]] = pairs.get(node[1], above)
                    for kid in node[2]:
                        go(kid, to[node[1]] if to[node[1]] < 0 else -1 - to[node[1]])

                go(mine, -1)
                return to

            slots_of = {s: aligned(s) for s in {p[1] for p in voting}}
            who, holders, words, linked = defaultdict(set), defaultdict(set), Counter(), Counter()
            per_text = defaultdict(lambda: [0, 0])
            for _, shape, blocks, voter in voting:
                for node, b in blocks:
                    slot = slots_of[shape][node]
                    who[slot, b.text].add(voter)
                    holders[slot].add(voter)
                    words[slot] += b.words
                    linked[slot] += b.links
                    per_text[slot, b.text][0] += b.words
                    per_text[slot, b.text][1] += b.links
            constants = {k for k, v in who.items() if len(v) >= max(min_pages, min_share * len(voters)) and len(v) >= 0.8 * len(holders[k[0]])}
            varying = Counter({s: words[s] - linked[s] - sum(w - x for k, (w, x) in per_text.items() if k[0] == s and k in constants) for s in words})
            sums = Counter()
            for s, v in varying.items():
                sums[s if s >= 0 else -1 - s] += v
            positive = lambda c: {s: v for s, v in c.items() if s >= 0}
            content, states = wrapper_extract.wrapper(tree, sums, positive(words), positive(linked), {s: len(v) / len(voters) for s, v in holders.items()}, min_share)
        for page_id, shape, blocks, _ in pages:
            to, found = slots_of.get(shape), []
            if content >= 0 and to and content in to.values():
                for node, b in blocks:
                    slot = to[node]
                    state = states[slot if slot >= 0 else -1 - slot]
                    if state == wrapper_extract.SURE and slot < 0:
                        state = wrapper_extract.CONTENT
                    named = {wrapper_extract.CONTENT: dom.NAMED, wrapper_extract.WIDE_CONTENT: dom.NAMED_OUTSIDE}.get(state, 0)
                    if state and not b.flags & named and (slot, b.text) not in constants:
                        found.append(b.text)
            if not found:
                found = [b.text for node, b in blocks if b.flags & dom.USUAL and not (to and content >= 0 and (to[node], b.text) in constants)]
            out[page_id, "\n\n".join(found)] += 1
    return out


def test_extraction_against_a_plain_version(spark):
    rng = random.Random(12)
    rows = [(-1, None, None), (-2, None, ""), (-3, "no url", "<p>alone</p>"), (-4, "http://one.example/", "<div>just one</div>")]
    for h in range(6):
        for i in range(rng.randint(2, 12)):
            page = nameless(i, rng.randint(1, 5))[0]
            if rng.random() < 0.3:
                page = page.replace("class=q3", "class=q7")
            if rng.random() < 0.3:
                page = page.replace("<h1>", f"<aside>{text(3)}</aside><h1>")
            if rng.random() < 0.2:
                page = f"<body><article><p>{text(20)}</p></article><div class=comment>{text(4)}</div></body>"
            rows.append((100 * h + i, f"http://H{h}.example/p{i}", page))
    rows += rows[6:9] + [(5000, rows[7][1], rows[7][2]), (5001, "http://h1.example/long", "<body>" + "<div class=q3>" + f"<p>{text(20000)}</p></div></body>")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = Counter((r.page_id, r.text) for r in wrapper_extract.extract(df).collect())
    assert got == plain(rows)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = Counter((r.page_id, r.text) for r in wrapper_extract.extract(pages).collect())
    assert got == plain([(r.page_id, r.url, r.html) for r in pages.collect()])


def test_most_hosts_get_a_wrapper(spark):
    rows = wrapper_extract.common.stored(wrapper_extract.layouts(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")), "layouts")
    known, _ = wrapper_extract.wrappers(rows)
    hosts = rows.groupBy("host").count().where("count >= 3").count()
    assert known.count() >= 0.9 * hosts
