"""Main text of web pages by a tree-structured graphical model.

The element nodes of a page form a tree of binary variables: is this node's own text content? A node has a potential
from its features (tag, words of class, id and role, length, share of links), and each parent-child pair has one that
favours equal values. Sum-product messages go up from the leaves and down from the root, which on a tree gives exact
marginals in two passes; a block of text is kept if its node's marginal is at least one half. Both potentials are
trained by pseudo-likelihood on labelled pages, which ``labelled_pages`` makes here: no page of the input is needed.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .toxicity import fit_regression

TOKEN = re.compile(r"""<!--(?:>|.*?(?:-->|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)(?:((?:[^>"']|"[^"]*"|'[^']*')*+)>|([^>]*)(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][^\s=/>]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
WORD = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What these hold is text for machines, not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Never text of an article: what the page says about itself, code, and the parts of forms.
NEVER = frozenset("head script style template title form button select option textarea input".split())
#: Hints that make an inline element a node of its own, so that an advert within a paragraph can go without it.
APART = frozenset(("ad",))
INLINE = frozenset("a abbr acronym audio b bdi bdo big br canvas cite code data del dfn em font i img ins kbd label mark math menclose meter mfrac mi mmultiscripts mn mo mover mpadded mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover object picture q rp rt ruby s samp semantics small span strike strong sub sup svg time tt u var video wbr".split())
#: An opening tag ends an open element of the named kinds.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tbody", "tr", "td"), "tbody": ("thead", "tr", "td", "th"), "option": ("option",)}
KEEPS_OPEN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "thead": ("table",), "tbody": ("table",), "option": ("select",)}
#: Words of class, id and role that tell of a region, by what they tell.
HINTS = {
    "ad": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner",
    "nav": "nav navigation menu breadcrumb breadcrumbs toc pagination pager",
    "foot": "foot footer bottom copyright legal colophon contentinfo",
    "head": "masthead topbar header top logo",
    "side": "side sidebar aside widget rail complementary",
    "talk": "comment comments reply replies respond discussion disqus reader readers review reviews",
    "note": "notice notices cookie cookies consent gdpr popup modal alert subscribe newsletter signup paywall warning disclaimer message",
    "share": "share sharing social related recommended recommendations tags meta byline author more",
    "main": "article content main post entry story body text prose page",
    "search": "search login form",
}
HINT_OF = {word: hint for hint, words in HINTS.items() for word in words.split()}
TAGS = "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption header footer nav aside address details summary center".split()


def hints_of(attributes: str) -> set[str]:
    """What the words of class, id, role and the like tell."""
    told = (a or b or c for name, a, b, c in ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id", "role", "itemprop", "aria-label"))
    return {HINT_OF[w] for value in told for w in WORD.findall(value.lower()) if w in HINT_OF}


class Node:
    __slots__ = ("tag", "parent", "children", "hints", "chars", "links", "label", "never", "commas")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.children = tag, parent, []
        self.chars = self.links = self.commas = 0
        self.label = parent.label if parent else None
        self.never = tag in NEVER or bool(parent and parent.never)
        self.hints = hints_of(attributes) if attributes else set()
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            if name.lower() == "data-label":
                self.label = (a or b or c) == "content"
        if parent:
            parent.children.append(self)


class Text(str):
    """A block's text; runs has its parts with the node of each, where an inline element is a node of its own."""

    runs: tuple[tuple[Node, str], ...] = ()


def parse(page: str) -> tuple[list[Node], list[tuple[Node, Text]]]:
    """(nodes, parents first; blocks of text in page order with the node that owns each)."""
    root = Node("html", None)
    nodes, blocks, stack = [root], [], [root]
    inline: list[tuple[str, Node | None]] = []
    held: list[tuple[Node, str]] = []

    def here() -> Node:
        return next((node for _, node in reversed(inline) if node), stack[-1])

    def flush() -> None:
        if held:
            block = Text(" ".join("".join(raw for _, raw in held).split()))
            if block:
                own = {id(node): node for node, _ in held}
                for node in own.values():
                    part = block if len(own) == 1 else " ".join("".join(raw for n, raw in held if n is node).split())
                    node.chars += len(part)
                    node.commas += part.count(",") + part.count(".")
                if own.keys() != {id(stack[-1])}:
                    block.runs = tuple(held)
                blocks.append((stack[-1], block))
            held.clear()

    def text(raw: str) -> None:
        if raw:
            raw = unescape(raw) if "&" in raw else raw
            held.append((here(), raw))
            if any(tag == "a" for tag, _ in inline):
                stack[-1].links += len(raw)

    def pop_to(depth: int) -> None:
        flush()
        del stack[depth:]
        inline.clear()

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        closing, opening = m[1], m[2]
        if opening:
            tag, attributes = opening.lower(), m[3] or m[4] or ""
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                at = end.start() if end else size
                continue
            if tag in INLINE:
                if tag == "br":
                    held.append((here(), " "))
                elif tag not in VOID:
                    apart = Node(tag, here(), attributes) if attributes and not APART.isdisjoint(hints_of(attributes)) else None
                    if apart:
                        nodes.append(apart)
                    inline.append((tag, apart))
                continue
            if tag in VOID:
                flush()
                continue
            if tag in ("html", "body") and any(n.tag == tag for n in stack):
                continue
            flush()
            if tag in CLOSES:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag in KEEPS_OPEN[tag]:
                        break
                    if stack[depth].tag in CLOSES[tag]:
                        pop_to(depth)
                        break
            if stack[-1].tag == "p":
                pop_to(len(stack) - 1)
            if tag == "body":
                pop_to(1)
            stack.append(Node(tag, stack[-1], attributes))
            nodes.append(stack[-1])
            if attributes.rstrip().endswith("/") and tag not in TAGS:
                pop_to(len(stack) - 1)
        elif closing:
            tag = closing.lower()
            if tag in INLINE:
                for i in range(len(inline) - 1, -1, -1):
                    if inline[i][0] == tag:
                        del inline[i]
                        break
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    pop_to(depth)
                    break
            else:
                flush()
    flush()
    return nodes, blocks


NAMES = ["one", *(f"tag={t}" for t in TAGS), "tag=?", *(f"hint={h}" for h in HINTS), *(f"above={h}" for h in HINTS), "above=article", "above=nav", "above=foot", "above=head", "above=aside", "short", "long", "links", "punctuated", "empty"]
PLACE = {name: i for i, name in enumerate(NAMES)}
ABOVE = {"article": "above=article", "main": "above=article", "nav": "above=nav", "menu": "above=nav", "footer": "above=foot", "header": "above=head", "aside": "above=aside"}


def features(nodes: list[Node]) -> list[list[int]]:
    """The places in NAMES of each node's features; all are 0 or 1."""
    out: list[list[int]] = []
    above: dict[int, frozenset[int]] = {}
    for node in nodes:
        own = {0, PLACE.get(f"tag={node.tag}", PLACE["tag=?"]), *(PLACE[f"hint={h}"] for h in node.hints)}
        up = above[id(node.parent)] if node.parent else frozenset()
        out.append([*own, *up])
        down = up | {PLACE[f"above={h}"] for h in node.hints}
        if node.tag in ABOVE:
            down |= {PLACE[ABOVE[node.tag]]}
        above[id(node)] = down
        row = out[-1]
        if not node.chars:
            row.append(PLACE["empty"])
        else:
            row.append(PLACE["short" if node.chars < 40 else "long"])
            if node.links * 2 > node.chars:
                row.append(PLACE["links"])
            if node.commas * 120 > node.chars:
                row.append(PLACE["punctuated"])
    return out


def marginals(nodes: list[Node], weights: list[float], coupling: float) -> list[float]:
    """Exact P(content) of each node by one upward and one downward pass; fields are half log odds, as for spins."""
    place = {id(n): i for i, n in enumerate(nodes)}
    field = [0.5 * sum(map(weights.__getitem__, row)) for row in features(nodes)]
    for i, n in enumerate(nodes):
        if n.never:
            field[i] = -30.0
    pull = math.tanh(coupling)
    message = lambda h: math.atanh(pull * math.tanh(h))  # noqa: E731  what a neighbour with field h adds
    up, total = [0.0] * len(nodes), field[:]
    for i in range(len(nodes) - 1, 0, -1):  # parents come first in the list
        up[i] = message(total[i])
        total[place[id(nodes[i].parent)]] += up[i]
    for i in range(1, len(nodes)):
        total[i] += message(total[place[id(nodes[i].parent)]] - up[i])
    return [1 / (1 + math.exp(-2 * max(-30.0, min(30.0, t)))) for t in total]


def train(pages: list[str]) -> tuple[list[float], float]:
    """(weights, coupling) from pages whose regions carry data-label="content" or another value."""
    rows, labels = [], []
    for page in pages:
        nodes, _ = parse(page)
        place = {id(n): i for i, n in enumerate(nodes)}
        inside = [[n.chars * bool(n.label), n.chars] for n in nodes]
        for i in range(len(nodes) - 1, 0, -1):
            up = inside[place[id(nodes[i].parent)]]
            up[0] += inside[i][0]
            up[1] += inside[i][1]
        # A node of no text of its own is content if most of what it holds is.
        y = [bool(n.label) if n.chars or not all_chars else 2 * own >= all_chars for n, (own, all_chars) in zip(nodes, inside, strict=True)]
        for i, (n, own) in enumerate(zip(nodes, features(nodes), strict=True)):
            if not n.never:
                near = [*n.children, *([n.parent] if n.parent else [])]
                x = np.zeros(len(NAMES) + 1)
                x[own] = 1
                x[-1] = 2 * sum(1 if y[place[id(o)]] else -1 for o in near if not o.never)
                rows.append(x)
                labels.append(y[i])
    fit = fit_regression(np.array(rows), np.array(labels, float))
    return fit[:-1], max(0.0, fit[-1])


def labelled_pages(n: int = 300, seed: int = 7) -> list[str]:
    """Training pages of the usual layouts, each region labelled. Their words are random: only structure is learned."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(1, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    said = lambda a, b: words(a, b).capitalize() + rng.choice((".", ".", ",", ""))
    prose = lambda: " ".join(said(3, 16) for _ in range(rng.choice((1, 1, 2, 4, 8))))
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'

    def noise() -> str:
        links = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 7)))
        kind = rng.choice("ad ads advert sponsored promo banner".split()), rng.choice("notice cookie-notice alert newsletter consent".split()), rng.choice("comments comment-list reader-comments replies discussion".split()), rng.choice("share social related-posts".split())
        remarks = "".join(rng.choice((f'<div class="comment"><p>{prose()}</p></div>', f"<p>{prose()}</p>", f'<li class="comment">{prose()}</li>', f'<article class="comment"><header>{words(1, 2)}</header><p>{prose()}</p></article>')) for _ in range(rng.randint(1, 4)))
        return rng.choice(
            (
                f'<div class="{kind[0]}">{prose()}</div>',
                f'<aside class="{kind[0]}"><p>{prose()}</p></aside>',
                f'<div class="{kind[1]}"><p>{prose()}</p></div>',
                f'<div id="{kind[1]}" role="alert">{prose()}</div>',
                f'<section class="{kind[2]}"><h2>{words(1, 3)}</h2>{remarks}</section>',
                f'<div id="{kind[2]}"><h3>{words(1, 2)}</h3>{remarks}</div>',
                f'<div class="{kind[3]}"><ul>{links}</ul></div>',
                f"<aside><h3>{words(1, 3)}</h3><p>{prose()}</p></aside>",
                f"<nav><ul>{links}</ul></nav>",
                f'<form action="/s"><p>{prose()}</p><input name="q"></form>',
            )
        )

    def label(markup: str, how: str) -> str:
        return re.sub(r"^<(\w+)", rf'<\1 data-label="{how}"', markup)

    def block() -> str:
        return rng.choice((f"<p>{prose()}</p>",) * 6 + (f"<h2>{words(1, 6)}</h2>", f"<ul><li>{prose()}</li><li>{said(2, 9)}</li></ul>", f"<blockquote><p>{prose()}</p></blockquote>", f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>", f"<pre>{words(3, 20)}</pre>", f"<figure><figcaption>{said(2, 9)}</figcaption></figure>", f"<p><b>{prose()}<br><p>{prose()}</p>", f"<section><h3>{words(1, 4)}</h3><p>{prose()}</p></section>", f"<div>{prose()}</div>", f"<p>{link()} {prose()}</p>", f'<p>{prose()} <span class="{rng.choice(("ad", "advert", "sponsored", "inline-ad"))}" data-label="noise">{words(2, 9)}</span> {prose()}</p>'))

    out = []
    for _ in range(n):
        parts = [f"<h1>{words(2, 9)}</h1>"] + [block() for _ in range(rng.randint(1, 9))]
        for _ in range(rng.choice((0, 0, 1, 2))):
            parts.insert(rng.randint(1, len(parts)), label(noise(), "noise"))
        tag = rng.choice(("<article", "<article", "<article", "<main", '<div class="content"', '<div id="post-body"', '<div class="entry"', '<div class="article-text"'))
        body = f'{tag} data-label="content">{"".join(parts)}</{tag.split()[0][1:]}>'
        if rng.random() < 0.25:
            body = f"<main><div>{body}</div></main>" if rng.random() < 0.5 else f'<div class="page">{body}</div>'
        before = [label(x, "noise") for x in (f"<nav><ul><li>{link()}</li><li>{link()}</li></ul></nav>", f"<header><h1>{words(1, 3)}</h1><p>{words(2, 6)}</p></header>", f'<div id="header"><div class="logo">{words(1, 2)}</div></div>', noise()) if rng.random() < 0.6]
        after = [label(x, "noise") for x in (noise(), f'<div class="sidebar"><h3>{words(1, 3)}</h3><p>{prose()}</p><ul><li>{link()}</li></ul></div>', f"<footer>&copy; {prose()}</footer>", f'<div id="footer"><p>{prose()}</p></div>') if rng.random() < 0.6]
        rng.shuffle(after)
        out.append(f'<!DOCTYPE html><html data-label="noise"><head><title>{words(2, 5)}</title></head><body>{"".join(before)}{body}{"".join(after)}</body></html>')
    return out


def main_text(page: str, weights: list[float], coupling: float) -> str:
    nodes, blocks = parse(page)
    if not blocks:
        return ""
    content = dict(zip(map(id, nodes), marginals(nodes, weights, coupling), strict=True))
    kept = (text if not text.runs else " ".join("".join(raw for n, raw in text.runs if content[id(n)] >= 0.5).split()) for node, text in blocks if text.runs or content[id(node)] >= 0.5)
    return "\n\n".join(filter(None, kept))


@cache
def own_model() -> tuple[list[float], float]:
    """The model of the generated pages, trained once a driver."""
    return train(labelled_pages())


def extract(pages: DataFrame, model: tuple[list[float], float] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per page.

    Null or empty html, and pages without content, give an empty text. ``<br>`` is white space inside its block. One
    pass, no shuffle; the model (some sixty numbers) travels with the tasks. An empty table gives an empty result.
    """
    weights, coupling = model or own_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(value.as_py() or "", weights, coupling) for value in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars"])

    read = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return read.mapInArrow(run, "page_id long, url string, text string, n_chars long")
