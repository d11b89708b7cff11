"""A small tolerant reader of HTML into a tree of block elements, and simple tree matching.

Per-page helper of the wrapper induction; everything across pages is done by Spark.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

# HTML element names by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img br".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SKIPPED = frozenset("nav footer aside form menu".split())
UNSEEN = frozenset("head button select dialog object canvas audio video".split())
#: Words of class, id and role that name page furniture.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs footer header masthead topbar "
    "sidebar aside widget widgets comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended pagination pager search searchform complementary contentinfo".split()
)
#: Words that say no more than where or how furniture stands: a name of these and furniture words is furniture.
PLACES = frozenset(
    "area articles bar block bottom box btn button buttons container content footer form global header inline inner item items left link links list local main "
    "nav outer page panel post posts primary right row secondary section site title top wrap wrapper".split()
)
#: Elements deeper than this are aligned as parts of their ancestor at this depth.
MAX_DEPTH = 150
#: A tag ends at the first > outside quotes, or, if a quote doesn't close, at the first >.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*>)", re.S)
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I | re.A) for tag in RAW}
ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Characters that structure a skeleton string.
UNSAFE = re.compile(r"[()\s]")
NAME_PARTS = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("hidden", "kids", "label", "names", "tag", "tokens")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.kids, self.names, self.tokens, self.hidden = tag, [], frozenset(), (frozenset(), frozenset()), False
        self.label = UNSAFE.sub("_", tag)
        if attrs and "=" in attrs or "hidden" in attrs:
            found = {}
            for m in ATTR.finditer(attrs):
                found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
            classes = sorted(re.sub(r"\d+", "0", x) for x in found.get("class", "").lower().split())
            if classes:
                self.label = UNSAFE.sub("_", f"{tag}.{'.'.join(classes)}")
            named, own = (" ".join(found.get(k, "") for k in keys).lower() for keys in (("class", "role"), ("id",)))
            self.names = frozenset(x for x in NAME_PARTS.split(f"{named} {own}") if x)
            self.tokens = frozenset(named.split()), frozenset(own.split())
            self.hidden = "hidden" in found or found.get("aria-hidden") == "true"


def parse(source: str) -> Node:
    """The element tree; text stays as str among the kids, character references decoded."""
    root = Node("#root")
    stack, at, n = [root], 0, len(source)
    while at < n:
        m = TOKEN.search(source, at)
        if m is None:
            stack[-1].kids.append(html.unescape(source[at:]))
            break
        if m.start() > at:
            stack[-1].kids.append(html.unescape(source[at : m.start()]))
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].kids.append(m[0][9:-3])
            continue
        tag = m[2].lower()
        if m[1]:
            _close(stack, tag)
            continue
        if tag in CLOSES_P:
            _close_open(stack, {"p"}, {"table", "td", "th", "li", "blockquote", "div", "article", "section", "main", "#root"})
        if tag in SELF_CLOSING:
            _close_open(stack, SELF_CLOSING[tag], SCOPES[tag])
        attrs = m[3][:-1]
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if tag in RAW and not attrs.endswith("/"):
            end = RAW_END[tag].search(source, at)
            at = end.end() if end else n
        elif tag not in VOID and not attrs.endswith("/"):
            stack.append(node)
    return root


def _close(stack: list[Node], tag: str) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if tag in INLINE and stack[i].tag not in INLINE:
            return


def _close_open(stack: list[Node], tags: set[str], scope: set[str]) -> None:
    """Close the nearest open element of `tags`, unless an element of `scope` stands between."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in scope:
            return


def skeleton(root: Node) -> tuple[str, dict[int, int]]:
    """The block structure as a string, and the preorder number in it of each block element by id().

    Inline elements count as text. Equal neighbouring structures (rows, items, paragraphs) are one node.
    """

    def shape(node: Node, depth: int) -> tuple:
        kids: list[tuple[tuple, list[Node]]] = []
        if depth == MAX_DEPTH:
            return f"{node.label}()", [_below(node)]
        for kid in node.kids:
            if isinstance(kid, str) or kid.tag in INLINE or kid.tag in RAW or kid.tag in VOID:
                continue
            own = shape(kid, depth + 1)
            if kids and kids[-1][0][0] == own[0]:
                kids[-1] = (_together(kids[-1][0], own), kids[-1][1])
            else:
                kids.append((own, []))
        return f"{node.label}({' '.join(k[0][0] for k in kids)})", [[id(node)]] + [x for k in kids for x in k[0][1]]

    def _below(node: Node) -> list[int]:
        todo, ids = [node], []
        while todo:
            ids.append(id(todo[-1]))
            todo.extend(kid for kid in todo.pop().kids if not isinstance(kid, str))
        return ids

    def _together(a: tuple, b: tuple) -> tuple:
        return a[0], [x + y for x, y in zip(a[1], b[1])]

    text, members = shape(root, 0)
    return text, {i: number for number, ids in enumerate(members) for i in ids}


def read_skeleton(text: str) -> tuple:
    """(label, number, kids) from a skeleton string."""
    stack, number, label = [("", -1, [])], 0, []
    for ch in text:
        if ch == "(":
            node = ("".join(label), number, [])
            stack[-1][2].append(node)
            stack.append(node)
            number, label = number + 1, []
        elif ch == ")":
            stack.pop()
        elif ch == " ":
            label = []
        else:
            label.append(ch)
    return stack[0][2][0]


def simple_tree_matching(a: tuple, b: tuple) -> dict[int, int]:
    """Numbers of a's nodes to those of b's in a largest order-preserving matching of equal labels."""

    def weigh(x: tuple, y: tuple) -> tuple[int, list]:
        """Size of the matching below two nodes of equal labels, and its pairs."""
        p, q = x[2], y[2]
        best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        how: dict[tuple[int, int], list] = {}
        for i in range(1, len(p) + 1):
            for j in range(1, len(q) + 1):
                best[i][j] = max(best[i - 1][j], best[i][j - 1])
                if p[i - 1][0] == q[j - 1][0]:
                    w, pairs = weigh(p[i - 1], q[j - 1])
                    if best[i - 1][j - 1] + w > best[i][j]:
                        best[i][j] = best[i - 1][j - 1] + w
                        how[i, j] = pairs
        pairs, i, j = [(x[1], y[1])], len(p), len(q)
        while i and j:
            if (i, j) in how:
                pairs += how[i, j]
                i, j = i - 1, j - 1
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return best[len(p)][len(q)] + 1, pairs

    return dict(weigh(a, b)[1]) if a[0] == b[0] else {}


class Block(NamedTuple):
    """A run of text of one block element. `words` of it, `links` of these in links; `flags`: see below."""

    owner: int
    text: str
    words: int
    links: int
    flags: int


#: Flags of a block: part of the main text by the page's own marks and names; under an element whose tag or name
#: says furniture by the rule for main parts; the same by the rule for whole pages.
USUAL, NAMED, NAMED_OUTSIDE = 1, 2, 4


def page_blocks(root: Node) -> list[Block]:
    """All visible blocks of a page in page order, furniture included, with what the page itself says of them.

    If the page marks its main part (main, else article, or the role main), only that part is its usual main text.
    """
    main = {id(x) for x in _marked(root)}
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []

    def flush(owner: Node, named: bool, outside: bool, within: bool, into: list[tuple[str, bool]] = parts) -> None:
        text = " ".join("".join(x for x, _ in into).split())
        if text:
            usual = within and not named if main else not outside
            links = sum(len(x.split()) for x, link in into if link)
            out.append(Block(id(owner), text, text.count(" ") + 1, links, usual * USUAL | named * NAMED | outside * NAMED_OUTSIDE))
        into.clear()

    # kids, owner, named, outside, within the main part, in a link, only headings count, is a block
    todo = [(iter(root.kids), root, False, False, False, False, False, True)]
    while todo:
        kids, owner, named, outside, within, link, heading_only, block = todo[-1]
        for kid in kids:
            if isinstance(kid, str):
                parts.append((kid, link))
            elif kid.tag == "br":
                parts.append((" ", link))
            elif kid.tag in VOID and kid.tag != "hr" or kid.tag in UNSEEN or kid.tag in RAW or kid.hidden:
                if kid.tag not in INLINE and kid.tag not in VOID:
                    flush(owner, named or heading_only, outside, within)
            elif kid.tag in INLINE:
                if not within and not outside and _furniture(kid, False):
                    aside = [(x, True) for x in _texts(kid)]
                    flush(kid, named, True, within, aside)
                    continue
                todo.append((iter(kid.kids), owner, named, outside, within, link or kid.tag == "a", heading_only, False))
                break
            else:
                flush(owner, named or heading_only, outside, within)
                inside = within or id(kid) in main
                only = (heading_only or kid.tag == "header") and kid.tag not in HEADINGS
                todo.append((iter(kid.kids), kid, named or _furniture(kid, True), outside or _furniture(kid, False), inside, link, only, True))
                break
        else:
            todo.pop()
            if block:
                flush(owner, named or heading_only, outside, within)
    return out


def _texts(node: Node) -> list[str]:
    todo, found = [node], []
    while todo:
        kid = todo.pop()
        if isinstance(kid, str):
            found.append(kid)
        elif kid.tag not in RAW:
            todo.extend(reversed(kid.kids))
    return found


def blocks(root: Node) -> list[tuple[int, str]]:
    """(id() of the block element, text) of the page's usual main text: what it yields without its host's wrapper."""
    return [(b.owner, b.text) for b in page_blocks(root) if b.flags & USUAL]


def _marked(root: Node) -> list[Node]:
    for test in (lambda n: n.tag == "main" or "main" in n.names and n.tag not in ("body", "html"), lambda n: n.tag == "article"):
        found: list[Node] = []
        todo = [root]
        while todo:
            node = todo.pop()
            if isinstance(node, str) or _furniture(node, False):
                continue
            if test(node):
                found.append(node)
            else:
                todo.extend(reversed(node.kids))
        if any(_has_text(x) for x in found):
            return found
    return []


def _has_text(node: Node) -> bool:
    todo = [node]
    while todo:
        kid = todo.pop()
        if isinstance(kid, str):
            if not kid.isspace() and kid:
                return True
        elif kid is node or not _furniture(kid, True):
            todo.extend(kid.kids)
    return False


def _holds_main(node: Node) -> bool:
    todo = list(node.kids)
    while todo:
        kid = todo.pop()
        if not isinstance(kid, str):
            if kid.tag in ("main", "article") and not _named_furniture(kid, False):
                return True
            todo.extend(kid.kids)
    return False


def _furniture(node: Node, inside: bool) -> bool:
    if node.tag in UNSEEN or node.tag in RAW or node.hidden:
        return True
    if node.tag in SKIPPED:
        return node.tag != "form" or not _holds_main(node)
    if node.tag in ("html", "body", "main", "#root"):
        return False
    if node.tag == "header" and not inside or _named_furniture(node, inside):
        return not _holds_main(node)
    return False


def _named_furniture(node: Node, inside: bool) -> bool:
    """Whether class, role or id name furniture.

    Outside the main part one word of a block's class or role is enough; an id, which often is a heading's anchor, must
    say nothing else. Inside, only a whole class or role counts. Headings and the wording of a sentence are never furniture
    by name; links and plain spans only outside the main part, by a whole class or role.
    """
    if not node.names & FURNITURE or node.tag in HEADINGS:
        return False
    named, own = node.tokens
    if node.tag in INLINE:
        return not inside and node.tag in ("a", "span") and any(map(_whole, named))
    if inside:
        return any(map(_whole, named))
    return any(not FURNITURE.isdisjoint(NAME_PARTS.split(x)) for x in named) or any(map(_whole, own))


def _whole(token: str) -> bool:
    parts = {x for x in NAME_PARTS.split(token) if x}
    return not parts.isdisjoint(FURNITURE) and parts <= FURNITURE | PLACES
