"""Main text of web pages by a tree-structured graphical model.

A page is parsed to a tree of block elements; each run of text and inline elements in a block is a leaf. Every node is content or not. A node has a potential from features of its tag, attributes, text and links; each pair of parent and child has a potential from the parent's and the child's state, by kind of child. Messages pass upward from the leaves and downward from the root, which gives exact marginals; leaves whose marginal is over one half are the text.

No table has labelled pages. Potentials are learned from labelled synthetic pages of several layouts (example_page()), by the gradient of the likelihood, which needs the same marginals.
"""

from __future__ import annotations

import html
import math
import random
import re
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .common import prepare

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<[a-zA-Z/!?][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
#: The attribute itself (quoted values are taken out before), and values that hide an element.
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
HIDING = re.compile(r"style\s*=[^>]*(?:display\s*:\s*none|visibility\s*:\s*hidden)|aria-hidden\s*=\s*[\"']?true", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A line of rights, not a sentence about them.
RIGHTS = re.compile(r"©|(?:copyright|\(c\))[\s:,]*(?:©|\(c\)|[12][0-9]{3}\b)", re.I)

#: Elements whose content is no text of the page: scripts and styles, what is never shown, parts of forms. The text of xmp is shown as it is written. HTML ends all but the last ones at the first end tag, whatever stands between, and "/" in a start tag closes none.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
SHOWN_RAW = "xmp"
#: The same, but these may nest, and drawings may be closed by their start tag.
NESTED = frozenset("template select datalist svg".split())
#: Block elements, by group.
GROUPS = {
    "text": "p dd dt address summary",
    "heading": "h1 h2 h3 h4 h5 h6 hgroup",
    "list": "ul ol dl menu dir",
    "item": "li",
    "table": "table thead tbody tfoot tr td th caption",
    "plain": "div section center details fieldset body html span-block",
    "article": "article main",
    "nav": "nav",
    "header": "header head",
    "footer": "footer",
    "aside": "aside",
    "form": "form button label legend option dialog",
    "quote": "blockquote pre figure figcaption xmp",
}
GROUP_OF = {tag: group for group, tags in GROUPS.items() for tag in tags.split()}
VOID = frozenset("hr br img input meta link wbr area base col embed source track param".split())
#: A start tag closes an open element of these, no further up than the nearest of the second.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
#: Parts of class names and the like that speak for and against content. Fixed words.
FOR = frozenset("article content post entry story main text prose body blog news paragraph".split())
AGAINST = frozenset("nav navigation menu navbar topbar footer foot header head masthead side sidebar ad ads advert advertisement advertising banner sponsor sponsored promo comment comments reply replies discussion disqus share sharing social related recommended cookie cookies consent notice alert popup modal overlay breadcrumb breadcrumbs login signin signup form search widget copyright legal subscribe newsletter tags meta toolbar pagination pager skip".split())
COMMENT = frozenset("comment comments reply replies discussion disqus respond".split())
#: Words that say of a name's other words only which box they mean.
BOXES = frozenset("area bar block body box bottom center col column container group inner item items left link links list message outer page panel right row section text top wrap wrapper".split())
#: Words that say what an element has, not what it is.
HAVING = frozenset("has have no with without".split())


@dataclass
class Node:
    tag: str
    parent: int
    parts: frozenset[str] = frozenset()  # cues
    mixed: bool = False  # a name that may mean either
    hidden: bool = False
    text: str | None = None  # of leaves
    linked: int = 0  # characters in links
    children: int = 0
    words: int = 0  # of the subtree
    chars: int = 0
    links: int = 0
    inherited: frozenset[str] = field(default_factory=frozenset)
    below_mixed: bool = False


@cache
def ends_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I)


def after_nested(page: str, tag: str, at: int) -> int:
    """Where an element ends whose start tag ends at a place: after the end tag that closes it, those of the same name within it aside; the page's end if none does."""
    depth = 1
    while m := TOKEN.search(page, at):
        at, name = m.end(), (m[2] or "").lower()
        if name == tag:
            depth += -1 if m[1] else not (tag == "svg" and m[3].endswith("/"))
            if not depth:
                return at
        elif name in RAW and not m[1]:
            end = ends_of(name).search(page, at)
            at = end.end() if end else len(page)
    return len(page)


def is_hidden(attributes: str) -> bool:
    low = attributes.lower()
    return ("hidden" in low or "none" in low) and bool(HIDING.search(attributes) or HIDDEN.search(QUOTED.sub('""', attributes)))


def cues_of(said: str) -> tuple[frozenset[str], bool]:
    """Cues of an element's names. As in English compounds the last word that names no box tells what a name means: one that ends in a cue against content ("site-header", "main-menu") speaks against it, one with such a cue further ahead ("comments-on-theory", "main-menu-content") is mixed, as is one that says what an element has ("page-with-sidebar"), and cues for content count wherever they stand."""
    pure, mixed = set(), False
    for name in said.split():
        words = [w.lower() for w in PART.findall(name)]
        against = {w for w in words if w in AGAINST or w in COMMENT}
        if not against:
            pure.update(w for w in words if w in FOR)
        elif HAVING.isdisjoint(words) and next((w for w in reversed(words) if w not in BOXES or w in against), "") in against:
            pure |= against
        else:
            mixed = True
    return frozenset(pure), mixed


def parse(page: str | None) -> list[Node]:
    """Nodes in page order; a parent comes before its children. Open elements are known by name, so a page takes time by its length, however deep it nests."""
    nodes, stack, names = [Node("html", -1)], [0], ["html"]
    places: dict[str, list[int]] = {"html": [0]}  # of open elements of a name in the stack
    run: list[tuple[str, bool]] = []
    link, at, page = False, 0, page or ""

    def flush() -> None:
        nonlocal link
        if run:
            text = " ".join("".join(t for t, _ in run).split())
            if text:
                nodes.append(Node("#", stack[-1], text=text, linked=sum(len("".join(t.split())) for t, linked in run if linked)))
            run.clear()
        link = False

    def close(k: int) -> None:
        while len(names) > k:
            places[names.pop()].pop()
            stack.pop()

    def innermost(tags: set[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def start(tag: str, attributes: str) -> None:
        # Names of the whole page tell nothing of its parts.
        said = " ".join(v for x in ATTRIBUTE.findall(attributes) for v in x) if attributes and tag not in ("html", "body") else ""
        nodes.append(Node(tag, stack[-1], *cues_of(said), bool(attributes) and is_hidden(attributes)))
        places.setdefault(tag, []).append(len(names))
        stack.append(len(nodes) - 1)
        names.append(tag)

    while True:
        m = TOKEN.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece:
            run.append((html.unescape(piece), link))
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in GROUP_OF:
                if at_stack := innermost({tag}):
                    flush()
                    close(at_stack)
                elif tag == "p":
                    flush()
            elif tag == "a":
                link = False
            continue
        if tag in RAW:
            end = ends_of(tag).search(page, at)
            if tag == SHOWN_RAW:
                flush()
                start(tag, m[3])
                run.append((page[at : end.start() if end else len(page)], False))
                flush()
                close(len(names) - 1)
            at = end.end() if end else len(page)
            run.append((" ", link))
        elif tag in NESTED:
            at = at if tag == "svg" and m[3].endswith("/") else after_nested(page, tag, at)
            run.append((" ", link))
        elif tag == "br":
            run.append((" ", link))
        elif tag == "a":
            link = True
        elif tag == "hr":
            flush()
        elif tag in GROUP_OF and tag not in VOID:
            flush()
            if tag in ("html", "body") and places.get(tag):
                continue
            if names[-1] == "p" or (names[-1] in GROUPS["heading"] and tag in GROUPS["heading"]):
                close(len(names) - 1)
            if tag in CLOSES:
                ends, limit = CLOSES[tag]
                if (k := innermost(ends)) > innermost(limit):
                    close(k)
            start(tag, m[3])
    flush()
    for n in nodes[1:]:
        up = nodes[n.parent]
        n.inherited = up.inherited | up.parts if up.parts else up.inherited
        n.below_mixed = up.below_mixed or up.mixed
        n.hidden |= up.hidden
        up.children += 1
    for n in reversed(nodes):
        if n.text is not None:
            n.words, n.chars, n.links = n.text.count(" ") + 1, len(n.text), n.linked
        if n.parent >= 0:
            up = nodes[n.parent]
            up.words, up.chars, up.links = up.words + n.words, up.chars + n.chars, up.links + n.links
    return nodes


NAMES = ["leaf", "node", *(f"node {g}" for g in GROUPS), *(f"leaf in {g}" for g in GROUPS), "for", "against", "leaf below for", "leaf below against", "leaf below comments", "mixed", "leaf below mixed", "hidden", "leaf words", "leaf links", "leaf sentence", "leaf short", "leaf copyright", "node words", "node links", "node many children"]
AT = {name: k for k, name in enumerate(NAMES)}


def features(nodes: list[Node], k: int) -> list[tuple[int, float]]:
    n = nodes[k]
    if n.text is not None:
        up, text = nodes[n.parent], n.text
        out = [(AT["leaf"], 1.0), (AT[f"leaf in {GROUP_OF[up.tag]}"], 1.0), (AT["leaf words"], math.log1p(n.words) / 3), (AT["leaf links"], min(1.0, n.links / max(1, n.chars)))]
        out += [(AT[name], 1.0) for name, holds in (("leaf sentence", text[-1] in ".!?…\"”’:;" and n.words > 3), ("leaf short", n.words < 4), ("leaf copyright", bool(RIGHTS.match(text))), ("leaf below for", not FOR.isdisjoint(n.inherited)), ("leaf below against", not AGAINST.isdisjoint(n.inherited)), ("leaf below comments", not COMMENT.isdisjoint(n.inherited)), ("leaf below mixed", n.below_mixed)) if holds]
    else:
        out = [(AT["node"], 1.0), (AT[f"node {GROUP_OF[n.tag]}"], 1.0), (AT["node words"], math.log1p(n.words) / 3), (AT["node links"], min(1.0, n.links / max(1, n.chars)))]
        out += [(AT[name], 1.0) for name, holds in (("for", not FOR.isdisjoint(n.parts)), ("against", not AGAINST.isdisjoint(n.parts)), ("mixed", n.mixed), ("node many children", n.children > 3)) if holds]
    if n.hidden:
        out.append((AT["hidden"], 1.0))
    return out


@dataclass
class Model:
    weights: list[float]
    #: Kind of child (leaf, node) -> log potential of [parent's state][child's state].
    pair: list[list[list[float]]]

    def marginals(self, nodes: list[Node], rows: list[list[tuple[int, float]]]) -> tuple[list[float], list[list[list[float]]]]:
        """Probability of content of each node, and of each edge's pair of states, by sum-product messages."""
        w, n = self.weights, len(nodes)
        up0, up1 = [0.0] * n, [sum(w[i] * v for i, v in row) for row in rows]  # log of potential times children's messages
        msg0, msg1 = [0.0] * n, [0.0] * n
        for k in range(n - 1, 0, -1):
            (a, b), (c, d) = self.pair[nodes[k].text is None]
            x, y = up0[k], up1[k]
            p, q = a + x, b + y
            msg0[k] = max(p, q) + math.log1p(math.exp(-abs(p - q)))
            p, q = c + x, d + y
            msg1[k] = max(p, q) + math.log1p(math.exp(-abs(p - q)))
            up0[nodes[k].parent] += msg0[k]
            up1[nodes[k].parent] += msg1[k]
        probability, edges = [0.0] * n, [[[0.0, 0.0], [0.0, 0.0]] for _ in range(n)]
        probability[0] = 1 / (1 + math.exp(min(700.0, up0[0] - up1[0])))
        for k in range(1, n):
            (a, b), (c, d) = self.pair[nodes[k].text is None]
            p = probability[nodes[k].parent]
            one0, one1 = 1 / (1 + math.exp(min(700.0, a + up0[k] - b - up1[k]))), 1 / (1 + math.exp(min(700.0, c + up0[k] - d - up1[k])))
            edges[k] = [[(1 - p) * (1 - one0), (1 - p) * one0], [p * (1 - one1), p * one1]]
            probability[k] = (1 - p) * one0 + p * one1
        return probability, edges


WORDS = "abdefghiklmnoprstuvwz"


def example_page(rng: random.Random) -> str:
    """A page of one of several layouts. Words of content begin with c, others with x, so leaves carry their labels; features don't see this."""
    word = lambda c: c + "".join(rng.choice(WORDS) for _ in range(rng.randint(1, 8)))
    text = lambda c, a, b, stop=".": " ".join(word(c) for _ in range(rng.randint(a, b))) + stop
    some = lambda *xs: rng.choice(xs)
    para = lambda: f"<p>{text('c', 3, 90)}</p>" if rng.random() < 0.9 else f"<p>{text('c', 5, 40)} <a href=x>{word('c')}</a> {text('c', 2, 20)}"
    attr = lambda *names: some("", f' class="{some(*names)}"', f' id="{some(*names)}"', f' class="{some(*names)}"') if rng.random() < 0.9 else ""
    links = lambda: "<ul>" + "".join(f"<li><a href=/>{word('x')}</a></li>" for _ in range(rng.randint(2, 9))) + "</ul>"
    body = [f"<h1>{text('c', 1, 12, some('', '.'))}</h1>"] if rng.random() < 0.9 else []
    if rng.random() < 0.5:
        body.append(f"<p><b>{text('c', 3, 30)}<br>")
    for _ in range(rng.randint(0, 9)):
        body.append(some(*[para] * 6, lambda: f"<h2>{text('c', 1, 6, '')}</h2>", lambda: f"<ul>{''.join(f'<li>{text(chr(99), 2, 20)}</li>' for _ in range(rng.randint(2, 5)))}</ul>", lambda: f"<blockquote>{para()}</blockquote>", lambda: f"<pre>{text('c', 3, 20)}</pre>", lambda: f"<table><tr><td>{text('c', 1, 5, '')}<td>{text('c', 1, 5, '')}</table>", lambda: f"<figure><img src=x><figcaption>{text('c', 3, 12)}</figcaption></figure>", lambda: f"<div class=ad>{text('x', 2, 12)}</div>", lambda: f"<aside{attr('related', 'pullout')}>{links()}</aside>", lambda: f"<p>Copyright {text('c', 4, 30)}</p>", lambda: f'<section {some("class", "id")}="{some("comments", "social", "legal", "share", "sponsor", "head", "search", "form", "story", "meta")}-{word("c")}{some("", "-" + word("c"))}">{para()}</section>')())
    unseen = lambda: some("", "", "", "", f'<div {some("hidden", "style=display:none", "style='color:red; display: none'", "aria-hidden=true")}><p>{text("x", 3, 60)}</p>{some("", links())}</div>', f'<p {some("hidden", "style=display:none")}>{text("x", 3, 40)}</p>')
    body.insert(rng.randint(0, len(body)), unseen())
    inner = "".join(body)
    nav = some(f"<nav>{links()}</nav>", f"<div{attr('menu', 'nav', 'navbar')}>{links()}</div>", f"<header>{text('x', 1, 5, '')}{links()}</header>", f"<header><h2>{text('x', 1, 4, '')}</h2><nav>{links()}</nav></header>", links())
    ad = lambda: some(f'<div class="{some("ad", "ads", "banner", "sponsor", "promo-box")}">{text("x", 3, 16)}</div>', "", "", f'<div class="{some("ad", "promo", "share", "related")}-{word("x")}">{text("x", 2, 10, "")}</div>')
    side = lambda: some("", f"<aside{attr('sidebar', 'widget')}><h3>{text('x', 1, 4, '')}</h3>{links()}<p>{text('x', 3, 30)}</p></aside>", f'<div class="{some("sidebar", "side", "related")}"><p>{text("x", 3, 25)}</p>{links()}</div>')
    notice = lambda: some("", "", f'<div class="{some("cookie-notice", "consent", "popup", "alert notice")}"><p>{text("x", 5, 30)}</p><button>{word("x")}</button></div>', f"<form{attr('search', 'newsletter')}><label>{text('x', 1, 6, '')}</label><p>{text('x', 2, 15)}</p><input><button>{word('x')}</button></form>")
    comments = lambda: some("", "", f'<{(t := some("div", "section"))} {some("class", "id")}="comments"><h3>{text("x", 1, 3, "")}</h3>' + "".join(f"<div class=comment><p>{text('x', 3, 60)}</p></div>" for _ in range(rng.randint(1, 4))) + f"</{t}>", f'<ol class="replies">{"".join(f"<li><p>{text(chr(120), 4, 50)}</p></li>" for _ in range(rng.randint(1, 4)))}</ol>')
    foot = some(f"<footer>&copy; {text('x', 3, 25)}</footer>", f"<footer><p>{text('x', 2, 20)}</p>{links()}</footer>", f"<div{attr('footer', 'copyright', 'legal')}>&copy; {text('x', 2, 15)}</div>", f"<footer>{links()}</footer>")
    main = some(f"<article>{inner}</article>", f"<article>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", f'<div class="{some("content", "post", "entry-content", "article-body", "main")}">{inner}</div>', f'<div id="{some("content", "story", "main-text")}">{inner}</div>', f"<div><div>{inner}</div></div>" if len(inner) > 300 else f"<article>{inner}</article>")
    middle = [main + comments() if rng.random() < 0.7 else main.replace("</article>", comments() + "</article>")]
    name = some("", "", "", f' id="{some("main", "page", "post", word("x"))}-{some("menu", "header", "sidebar", "footer")}-{some("content", "body", word("x"))}"', f' class="{some("single-post", "article", "has-sidebar", "page-with-comments", "home")}"')
    return f"<html><head><title>{word('x')}</title></head><body{name}>{notice()}{unseen()}{nav}{ad()}{side()}{''.join(middle)}{ad()}{side()}{notice()}{foot}" + some("</body></html>", "")


def train(pages: list[str], epochs: int = 40, seed: int = 3) -> Model:
    """Likelihood of the labelled pages, by stochastic steps. A leaf's label is its first letter's; an inner node is content if over half its words are."""
    rng, data = np.random.default_rng(seed), []
    for page in pages:
        nodes = parse(page)
        content = [0] * len(nodes)
        for k in range(len(nodes) - 1, -1, -1):
            n = nodes[k]
            if n.text is not None:
                content[k] = n.words * n.text.lstrip("© ").lower().startswith("c")
            if n.parent >= 0:
                content[n.parent] += content[k]
        data.append((nodes, [features(nodes, k) for k in range(len(nodes))], [int(2 * c > n.words) for c, n in zip(content, nodes)]))
    model = Model([0.0] * len(NAMES), [[[0.5, -0.5], [-0.5, 0.5]] for _ in range(2)])
    moved = np.zeros(len(NAMES)) + 1e-3
    for epoch in range(epochs):
        for p in rng.permutation(len(data)).tolist():
            nodes, rows, labels = data[p]
            probability, edges = model.marginals(nodes, rows)
            grad = [0.0] * len(NAMES)
            for row, y, q in zip(rows, labels, probability):
                d = y - q
                for i, v in row:
                    grad[i] += d * v
            for i, g in enumerate(grad):
                if g:
                    moved[i] += g * g
                    model.weights[i] += 0.3 * g / math.sqrt(moved[i]) - 1e-5 * model.weights[i]
            for k in range(1, len(nodes)):
                e, pair = edges[k], model.pair[nodes[k].text is None]
                for s in (0, 1):
                    for t in (0, 1):
                        pair[s][t] += 0.02 / (1 + epoch) * ((labels[nodes[k].parent] == s and labels[k] == t) - e[s][t])
    return model


@cache
def default_model(pages: int = 300, seed: int = 3) -> Model:
    rng = random.Random(seed)
    return train([example_page(rng) for _ in range(pages)], seed=seed)


def main_text(page: str | None, model: Model) -> str:
    nodes = parse(page)
    probability, _ = model.marginals(nodes, [features(nodes, k) for k in range(len(nodes))])
    return "\n".join(n.text for n, p in zip(nodes, probability) if n.text is not None and p > 0.5)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None) -> DataFrame:
    """Main text of every whole page: id_col, url_col, text, n_chars (code points).

    Blocks are joined by a line end; white space within a block is one space. A null or empty page has an empty text, as has one without content. A row depends on its page alone: repeated rows, ties and null ids need no rule. An empty table gives an empty result. Other columns are not read.
    """
    prepare(pages.sparkSession)
    model = model or default_model()

    @pandas_udf(StringType())
    def text(page: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, model) for p in page], dtype=object)

    return pages.select(F.col(id_col), F.col(url_col), text(F.col(html_col)).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
