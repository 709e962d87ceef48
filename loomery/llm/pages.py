"""Main text of web pages by a tree-structured graphical model (operator 7).

A page becomes a tree of block elements with its runs of text as leaves. Every node is content or not. Potentials: how
often a node of either kind has its features, and how often a child with its tag is content given its parent. Features of
blocks are the words of their class and id, and how much text and how many links they hold; those of leaves their length,
links and end, the element they stand in, and whether that is inside of the page's largest article and inside of the
block with the most running text. Sum-product messages, up from the leaves and down again, give each node's marginal; the
leaves whose marginal is above a half make the text.

The counts behind the potentials come from labelled pages that :func:`labelled_pages` composes from layouts, half of whose
names are made up; content is marked in them by an attribute that the model never sees. Parsing and inference are small
pure functions of one page, and take time in proportion to its length.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from loomery.llm.common import with_made_columns

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
LABEL = "data-content"

# Element names of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is no text of the page.
SILENT = frozenset("script style head title noscript template iframe svg math object canvas audio video select option textarea button".split())
RAW = frozenset("script style title textarea noscript iframe template".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: Blocks of running text, and the blocks that are told apart in features.
PARAGRAPHS = frozenset("p li dd blockquote pre td figcaption".split())
BLOCKS = PARAGRAPHS | frozenset("article aside body div footer form h1 h2 h3 h4 header html main nav ol section table tr ul".split())
LANDMARKS = frozenset("aside div footer form header nav section table ul ol".split())
RAW_END = {x: re.compile(rf"</{x}\s*>", re.I) for x in RAW}
#: Elements that end an open one of these kinds, up to the given container.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class Node:
    """A block element, or (tag ``#``) a run of text in one."""

    __slots__ = ("tag", "parent", "names", "text", "n_link", "label", "hints", "down")

    def __init__(self, tag: str, parent: Node | None, names: str = "", label: bool = False):
        self.tag, self.parent, self.names, self.text, self.n_link, self.label = tag, parent, names, "", 0, label
        self.hints: list[str] = []
        self.down = 0.5


class _Open:
    """An open block: its node (None for the page), and how many inline elements of each name are open in it."""

    __slots__ = ("name", "node", "inline")

    def __init__(self, name: str, node: Node | None):
        self.name, self.node, self.inline = name, node, Counter()


def parse(source: str | None) -> list[Node]:
    """The nodes of a page in document order, the root first. Broken markup is repaired as browsers do, roughly."""
    root = Node("html", None)
    nodes, here, stack = [root], root, [_Open("", None)]
    is_open: Counter = Counter()  # names of open elements, so that an end tag of none costs nothing
    pieces: list[str] = []
    in_link, silent = 0, 0
    n_link = 0

    def end_run() -> None:
        nonlocal n_link
        text = " ".join("".join(pieces).split())
        if text:
            leaf = Node("#", here, label=here.label)
            leaf.text, leaf.n_link = text, n_link
            nodes.append(leaf)
        pieces.clear()
        n_link = 0

    def say(raw: str) -> None:
        nonlocal n_link
        if raw and not silent:
            text = html.unescape(raw)
            pieces.append(text)
            if in_link:
                n_link += len(text.strip())

    def close_block() -> None:
        nonlocal here, in_link, silent
        top = stack.pop()
        end_run()
        here = top.node.parent
        is_open[top.name] -= 1
        silent -= top.name in SILENT
        for name, k in top.inline.items():
            is_open[name] -= k
            in_link -= k * (name == "a")

    def close_to(names, stop=frozenset()) -> None:
        """Close blocks up to the nearest of these names, unless a stop comes first."""
        if not any(is_open[x] for x in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                while len(stack) > k:
                    close_block()
                return
            if stack[k].name in stop:
                return

    source = source or ""
    at, n = 0, len(source)
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            say(source[at:])
            break
        found = TOKEN.match(source, lt)
        if not found:
            say(source[at : lt + 1])
            at = lt + 1
            continue
        say(source[at:lt])
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        attributes = (found[3] if found[2] else found[6]) or ""
        if found[1] or found[4]:
            if not is_open[name]:
                continue
            if name not in INLINE:
                close_to({name})
            elif stack[-1].inline[name]:  # an inline end tag ends nothing outside of its block
                stack[-1].inline[name] -= 1
                is_open[name] -= 1
                in_link -= name == "a"
            continue
        if name in CLOSES_P:
            close_to({"p"}, {"table", "td", "th", "button", "object"})
        if name in CLOSES:
            close_to(*CLOSES[name])
        if name == "body":
            close_to({"head"})
        if name in INLINE:
            if name == "br":
                say(" ")
            elif name not in VOID:
                if name == "a" and stack[-1].inline["a"]:  # links don't nest
                    stack[-1].inline["a"] -= 1
                    is_open["a"] -= 1
                    in_link -= 1
                stack[-1].inline[name] += 1
                is_open[name] += 1
                in_link += name == "a"
            continue
        end_run()
        if name in VOID:
            continue
        given = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes else {}
        label = {"1": True, "0": False}.get(given.get(LABEL), here.label)
        node = Node(name, here, " ".join(given.get(k, "") for k in ("class", "id", "role")), label)
        nodes.append(node)
        here = node
        stack.append(_Open(name, node))
        is_open[name] += 1
        silent += name in SILENT
        if name in RAW and not attributes.rstrip().endswith("/"):
            close = RAW_END[name].search(source, at)
            at = close.start() if close else n
    while len(stack) > 1:
        close_block()
    end_run()
    _describe(nodes)
    return nodes


def _words(names: str) -> list[str]:
    """The words of an element's names: ``mainMenu_2`` has main and menu."""
    return re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", names).lower())


def _describe(nodes: list[Node]) -> None:
    """Give every node its features."""
    place = {id(x): i for i, x in enumerate(nodes)}
    up = [place[id(x.parent)] if x.parent is not None else -1 for x in nodes]
    size, link = [len(x.text) for x in nodes], [x.n_link for x in nodes]
    running = [0] * len(nodes)  # running text in the blocks of a block
    for i in range(len(nodes) - 1, 0, -1):
        if nodes[i].tag == "#" and size[i] >= 25:
            block = up[i]
            held = up[block] if nodes[block].tag in PARAGRAPHS and up[block] >= 0 else block
            running[held] += size[i] - link[i]
        size[up[i]] += size[i]
        link[up[i]] += link[i]
    main = max((i for i, x in enumerate(nodes) if x.tag in ("article", "main") or " main" in f" {x.names} ".lower().split("-")[0]), key=lambda i: (size[i] - link[i], -i), default=-1)
    dense = max(range(len(nodes)), key=lambda i: (running[i], -i))
    in_main, in_dense = [False] * len(nodes), [False] * len(nodes)
    named = [frozenset(_words(x.names)) for x in nodes]
    under = [named[0]] * len(nodes)  # names of a node and of all that it stands in; shared where nothing is added
    for i, x in enumerate(nodes):
        in_main[i] = i == main or (i > 0 and in_main[up[i]])
        in_dense[i] = i == dense or (i > 0 and in_dense[up[i]])
        if i:
            above = under[up[i]]
            under[i] = above if named[i] <= above or len(above) > 64 else above | named[i]
        share = min(4, 5 * link[i] // max(1, size[i]))
        grade = min(9, size[i].bit_length())
        where = ("none" if main < 0 else "in" if in_main[i] else "out") + f"-{in_dense[i]}"
        if x.tag == "#":
            inside = nodes[up[i]].tag
            ends = x.text[-1] in '.!?…:;»”'
            x.hints = [f"text-{grade}-{share}", f"ends-{ends}-{grade > 4}", f"inside-{inside if inside in BLOCKS else 'other'}-{share > 1}", f"where-{where}-{grade > 4}"]
            if size[i] <= 40 and len(said := re.findall(r"[^\W\d_]+", x.text.lower())) <= 5:
                x.hints += [f"says-{w}" for w in sorted(set(said))]
            if "©" in x.text or "(c)" in x.text.lower():
                x.hints.append("copyright")
            x.hints += [f"under-{w}" for w in sorted(under[i])]
        else:
            x.hints = [f"holds-{x.tag if x.tag in BLOCKS else 'other'}-{share}-{grade // 3}"]
            if x.tag in LANDMARKS:
                x.hints.append(f"{x.tag}-where-{where}")
            if x.names.strip():
                x.hints += [f"name-{w}" for w in sorted(named[i])]
            else:
                x.hints.append(f"bare-{x.tag if x.tag in BLOCKS else 'other'}")


def features(node: Node) -> list[str]:
    """What the model sees of a node."""
    return node.hints


class TreeModel:
    """Potentials of nodes and of parent-child edges, from counts on labelled pages."""

    def __init__(self, pages: list[str], smooth: float = 0.2, least: int = 3):
        """Features seen ``least`` times count. Those of a node overlap, so their sum is damped, by as much as is best on a fifth of the pages, held out."""
        trees = [parse(x) for x in pages]
        held = trees[::5]
        self._count([x for i, x in enumerate(trees) if i % 5], smooth, least)
        best = -1
        for leaf in (0.5, 0.7, 1.0):
            for block in (0.5, 0.7, 1.0, 1.4):
                self.damped = (block, leaf)
                right = sum(self._right(x) for x in held)
                if right > best:
                    best, chosen = right, (block, leaf)
        self.damped = chosen
        self._count(trees, smooth, least)

    def _right(self, nodes: list[Node]) -> int:
        self.marginals(nodes)
        return sum((x.down > 0.5) == x.label for x in nodes if x.tag == "#")

    def _count(self, trees: list[list[Node]], smooth: float, least: int) -> None:
        counts, total = (Counter(), Counter()), [0, 0]
        edges = Counter()
        for nodes in trees:
            for node in nodes:
                kind = int(node.label)
                total[kind] += 1
                counts[kind].update(features(node))
                if node.parent is not None:
                    for pair in (self._pair(node), node.tag, None):
                        edges[int(node.parent.label), kind, pair] += 1
        self.weight = {
            f: math.log((counts[1][f] + smooth) / (total[1] + 2 * smooth)) - math.log((counts[0][f] + smooth) / (total[0] + 2 * smooth)) for f in counts[0] | counts[1] if counts[0][f] + counts[1][f] >= least
        }
        #: chance that a child is content if its parent is not, and if it is, by the tags of both, or the child's; None for others
        self.child = {
            tag: [(edges[p, 1, tag] + smooth * self._share(edges, p)) / (edges[p, 0, tag] + edges[p, 1, tag] + smooth) for p in (0, 1)]
            for tag in {k[2] for k in edges}
        }

    def potential(self, node: Node) -> float:
        """Log odds that a node is content by its own features alone."""
        get = self.weight.get
        return self.damped[node.tag == "#"] * sum(get(f, 0.0) for f in features(node))

    @staticmethod
    def _pair(node: Node) -> tuple[str, str]:
        above = node.parent.tag
        return above if above in BLOCKS else "other", node.tag

    def edge(self, node: Node) -> list[float]:
        """The chances that a node is content if its parent is not, and if it is."""
        return self.child.get(self._pair(node)) or self.child.get(node.tag) or self.child[None]

    @staticmethod
    def _share(edges: Counter, parent: int) -> float:
        return (edges[parent, 1, None] + 1) / (edges[parent, 0, None] + edges[parent, 1, None] + 2)

    def marginals(self, nodes: list[Node]) -> None:
        """Set ``down`` of every node to the marginal chance that it is content."""
        n = len(nodes)
        place = {id(x): i for i, x in enumerate(nodes)}
        parent = [place[id(x.parent)] if x.parent is not None else -1 for x in nodes]
        odds = [0.0] * n
        edges = [[0.0, 0.0], *map(self.edge, nodes[1:])]
        for i, x in enumerate(nodes):
            odds[i] = self.potential(x)
        up = odds[:]  # log odds of a node given its own subtree, without its parent
        message = [0.0] * n  # what a node tells its parent, as log odds
        for i in range(n - 1, 0, -1):
            out, inside = edges[i]
            e = math.exp(max(-500.0, min(500.0, up[i])))
            message[i] = math.log((inside * e + 1 - inside) / (out * e + 1 - out))
            up[parent[i]] += message[i]
        full = up[:]
        full[0] += -4.0  # the page as a whole is not content
        for i in range(1, n):
            out, inside = edges[i]
            rest = full[parent[i]] - message[i]  # the parent without this subtree
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, rest))))
            prior = p * inside + (1 - p) * out
            full[i] = up[i] + math.log(prior / (1 - prior))
        for i, x in enumerate(nodes):
            x.down = 1 / (1 + math.exp(-max(-500.0, min(500.0, full[i]))))

    def text(self, page: str | None, least: float = 0.5) -> str:
        """The main text of a page: its content blocks in order, one line each."""
        nodes = parse(page)
        self.marginals(nodes)
        return "\n".join(x.text for x in nodes if x.tag == "#" and x.down > least)


# -- labelled pages ----------------------------------------------------------------------------------------------------
def labelled_pages(n: int = 900, seed: int = 11, known: float = 0.5) -> list[str]:
    """Pages composed from layouts, with content marked by the attribute ``data-content``: 1 is content, 0 is not.

    A part has one of its usual names in a share ``known`` of cases; else a made-up one, or none.
    """
    rng = random.Random(seed)
    pick = rng.choice

    def sentence(lo: int = 4, hi: int = 22) -> str:
        words = ["".join(pick("aeinorstlu") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(lo, hi))]
        return " ".join(words).capitalize() + pick(".....!?")

    def prose(lo: int = 1, hi: int = 7) -> str:
        return " ".join(sentence() for _ in range(rng.randrange(lo, hi)))

    def few(k: int = 3) -> str:
        return " ".join(sentence(1, 4).rstrip(".!?") for _ in range(rng.randrange(1, k)))

    def says(*usual: str) -> str:
        return pick(usual) + pick(["", "", ":", f" ({rng.randrange(1, 99)})"]) if rng.random() < known else few()

    def links(tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{i}">{few()}</a></{tag}>' for i in range(rng.randrange(2, 9)))

    def named(names: list[str]) -> str:
        draw = rng.random()
        if draw > known + (1 - known) * 0.7:
            return ""
        made = "".join(pick("bcdfgklmnprstvz") + pick("aeiou") for _ in range(rng.randrange(2, 5)))
        return f' {pick(["class", "class", "id"])}="{pick(names) if draw < known else made}"'

    def block(tag: str, names: list[str], inside: str) -> str:
        return f'<{tag}{named(names)} {LABEL}="0">{inside}</{tag}>'

    def menu() -> str:
        return pick([lambda: f'<nav {LABEL}="0"><ul>{links()}</ul></nav>', lambda: block("div", ["nav", "menu", "navbar", "main-menu", "navigation", "topnav", "breadcrumb", "breadcrumbs"], f"<ul>{links()}</ul>"), lambda: block("ul", ["menu", "nav-list", "nav"], links())])()

    def header() -> str:
        return pick([lambda: f'<header {LABEL}="0"><h1>{few()}</h1><p>{sentence()}</p>{menu()}</header>', lambda: block("div", ["header", "masthead", "site-header", "page-header", "top", "logo"], f'<a href="/">{few()}</a><p>{few()}</p>'), lambda: f'<header {LABEL}="0">{few()}</header>', menu])()

    def footer() -> str:
        inside = pick([f"&copy; {rng.randrange(1999, 2026)} {few()} &middot; {sentence()}", f"<p>{sentence()}</p><ul>{links()}</ul>", f"<p>{few()}</p><p>{sentence()}</p>", prose(1, 3)])
        return pick([lambda: f'<footer {LABEL}="0">{inside}</footer>', lambda: block("div", ["footer", "site-footer", "copyright", "bottom", "legal", "colophon"], inside)])()

    def side() -> str:
        head = says("Related", "Most read", "Popular", "About", "About the author", "Categories", "Archives", "Recent posts", "Follow us")
        inside = pick([f"<h3>{head}</h3><ul>{links()}</ul>", f"<h3>{head}</h3><p>{prose(1, 4)}</p>", f"<p>{sentence()}</p>", links("p")])
        return pick([lambda: f'<aside {LABEL}="0">{inside}</aside>', lambda: block("div", ["sidebar", "side", "right-column", "widget", "rail", "widget-area", "related", "recommended", "popular", "more-stories", "trending"], inside)])()

    def related() -> str:
        tag, level = pick(["div", "section", "aside"]), pick(["h2", "h3", "h4", "p"])
        head = f"<{level}>{says('Related', 'Related articles', 'Related stories', 'Read more', 'See also', 'You may also like', 'More stories', 'Recommended')}</{level}>"
        return block(tag, ["related", "related-posts", "recommended", "more", "see-also", "read-next", "more-stories"], head + pick([f"<ul>{links()}</ul>", links("p"), links("div")]))

    def advert() -> str:
        tag = pick(["div", "div", "aside", "section", "p"])
        inside = pick([sentence(), prose(1, 4) if tag == "p" else f"<p>{prose(1, 4)}</p>", f'<a href="/x">{sentence()}</a>', few(), says("Advertisement", "Sponsored", "Ad", "Promoted")])
        return block(tag, ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "ad-slot", "promotion", "sponsor"], inside)

    def notice() -> str:
        tag = pick(["div", "div", "section", "p"])
        inside = pick([sentence(), prose(1, 4), f"{sentence()}<button>{few()}</button>"])
        inside = inside if tag == "p" or rng.random() < 0.4 else f"<p>{inside}</p>"
        return block(tag, ["cookie", "cookie-banner", "notice", "consent", "gdpr", "newsletter", "subscribe", "popup", "modal", "alert", "paywall", "cookie-notice", "banner", "disclaimer", "message"], inside)

    def form() -> str:
        inside = f'<label>{few()}</label> <input name="q"> <button>{few()}</button>' + pick(["", f"<p>{sentence()}</p>", f"<legend>{few()}</legend>"])
        return pick([lambda: f'<form action="/s" {LABEL}="0">{inside}</form>', lambda: block("div", ["search", "login", "signup", "search-form"], f"<form>{inside}</form>")])()

    def comments() -> str:
        one = lambda: pick([f'<div class="comment"><p>{prose(1, 5)}</p></div>', f"<li><b>{few()}</b><p>{prose(1, 4)}</p></li>", f"<p>{prose(1, 4)}</p>", f'<article class="comment"><h4>{few()}</h4><p>{prose(1, 4)}</p></article>',
                             f'<div{named(["comment", "reply", "comment-body", "response"])}><b>{few()}</b><p>{prose(1, 3)}</p></div>'])
        head = says("Comments", "Reader comments", "Responses", "Discussion", "Replies", "Leave a comment", "Leave a reply", "What readers say", "Join the discussion")
        inside = pick(["", f"<h3>{head}</h3>", f"<h2>{head}</h2>", f"<h4>{head}</h4>"]) + "".join(one() for _ in range(rng.randrange(1, 6)))
        return block(pick(["section", "div", "div", "ol", "ul"]), ["comments", "comment-list", "discussion", "responses", "replies", "reader-comments", "disqus", "respond", "user-comments"], inside)

    def share() -> str:
        tag = pick(["div", "ul", "p"])
        return block(tag, ["share", "social", "share-buttons", "tags", "social-links", "byline", "meta", "author-bio"], pick([links("a" if tag == "p" else "li"), few(), sentence(1, 6), says("Share this", "Share", "Tags", "Filed under", "Follow us")]))

    def boxed() -> str:
        """What stands inside an article without being its text."""
        about = lambda: f'<footer {LABEL}="0"><p>{pick([sentence(), few(), says("Filed under", "Tags", "Share this")])}</p></footer>'
        return pick([advert, share, notice, related, form, side, about])()

    def body() -> str:
        if rng.random() < 0.2:  # a very short one
            return pick(["", f"<h1>{few()}</h1>"]) + "".join(f"<p>{pick([few(), sentence(1, 5)])}{pick(['', '', '&&&', ' #', '***'])}</p>" for _ in range(rng.randrange(1, 4)))
        parts = []
        for _ in range(rng.randrange(2, 14)):
            parts.append(
                pick(
                    [lambda: f"<p>{prose()}</p>"] * 9
                    + [lambda: f"<p>{sentence(1, 5)}</p>", lambda: f"<h2>{few()}</h2>", lambda: f"<h3>{sentence(2, 6)}</h3>", lambda: f"<ul>{''.join(f'<li>{sentence(2, 12)}</li>' for _ in range(4))}</ul>",
                       lambda: f"<ol>{''.join(f'<li>{few()}</li>' for _ in range(rng.randrange(2, 6)))}</ol>", lambda: f"<ul>{''.join(f'<li>{few(2).lower()}</li>' for _ in range(rng.randrange(2, 6)))}</ul>", lambda: f"<blockquote><p>{prose()}</p></blockquote>", lambda: f"<pre>{sentence()}</pre>", lambda: f"<div>{prose()}</div>",
                       lambda: f'<p>{sentence()} <a href="/r">{few()}</a> {sentence()}</p>', lambda: f"<figure><img src=x><figcaption>{sentence(2, 9)}</figcaption></figure>",
                       lambda: f"<table><tr><th>{few()}</th><td>{few()}</td></tr><tr><th>{few()}</th><td>{sentence(1, 6)}</td></tr></table>", lambda: f"<section><h2>{few()}</h2><p>{prose()}</p></section>",
                       lambda: f"<p><b>{prose()}<br><p>{prose()}</p>", boxed]
                )()
            )
        return pick(["", f"<h1>{sentence(2, 9)}</h1>", f"<h1>{few()}</h1>", f'<header><h1>{sentence(2, 9)}</h1></header>']) + "".join(parts) + (comments() if rng.random() < 0.2 else "")

    containers = [
        ("article", []), ("article", []), ("article", ["post", "story"]), ("main", []), ("div", ["content", "article-body", "post-content", "entry-content", "story text", "body", "main", "page-text"]), ("div", ["content", "main", "text"]),
        ("section", ["entry", "content", "article"]), ("td", ["content"]), ("div", []),
    ]

    def article() -> str:
        if rng.random() < 0.15:  # no container: each block is content by itself
            bare = [x for x in (body() for _ in range(9)) if f'{LABEL}="0"' not in x] or [f"<p>{prose()}</p>"]
            return re.sub(r"<(p|h1|h2|h3|ul|ol|li|blockquote|pre|div|figure|figcaption|table|tr|td|th|section|header)(?=[ >])", rf'<\1 {LABEL}="1"', bare[0])
        tag, names = pick(containers)
        inside = f'<{tag}{named(names) if names else ""} {LABEL}="1">{body()}</{tag}>'
        if rng.random() < 0.3:
            inside = pick(["<main>{}</main>", '<div class="container">{}</div>', "<div>{}</div>", '<div id="wrapper"><div class="row">{}</div></div>', "<section>{}</section>"]).format(inside)
        return inside

    pages = []
    for _ in range(n):
        alone = rng.random() < 0.08
        before = [] if alone else [x() for x in rng.sample([header, menu, notice, advert, form, side], rng.randrange(1, 5))]
        after = [] if alone else [x() for x in rng.sample([comments, share, side, advert, notice, form, menu], rng.randrange(0, 5))] + [footer()] * (rng.random() < 0.9)
        inside = "".join(before) + article() + "".join(after)
        if rng.random() < 0.3:
            inside = pick(['<div class="page">{}</div>', '<div id="wrap">{}</div>', "<div>{}</div>"]).format(inside)
        pages.append(f'<!DOCTYPE html><html><head><title>{few()}</title></head><body>{inside}</body></html>')
    return pages


_MODEL: list[TreeModel] = []


def default_model() -> TreeModel:
    """The model trained on :func:`labelled_pages`, made once in a process (a few seconds)."""
    if not _MODEL:
        _MODEL.append(TreeModel(labelled_pages()))
    return _MODEL[0]


def extract(pages: DataFrame, model: TreeModel | None = None, source: str = "html") -> DataFrame:
    """Replace ``source`` by ``text``, the main text of each page, and its length ``n_chars``. Null counts as empty.

    Other columns are kept; a column ``text`` or ``n_chars`` of the input is replaced. One row out for each row in, repeated
    rows too; no rows: no rows. Pages of any length are read whole, in time in proportion to their length.
    """
    known = model or default_model()  # some kilobytes, sent along

    def made(tool: TreeModel, sources: list[str | None]) -> dict:
        texts = [tool.text(x) for x in sources]
        return {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())}

    return with_made_columns(pages, source, {"text": "string", "n_chars": "bigint"}, lambda: known, made, without=(source,))


def op7_pages(pages: DataFrame) -> DataFrame:
    """The contract of operator 7 over ``pages``."""
    return extract(pages.select("page_id", "url", "html"))
