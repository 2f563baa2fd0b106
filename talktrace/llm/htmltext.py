"""Main text of web pages by a tree-structured graphical model.

A page's elements form a tree of hidden variables, content or not. An element's tag, names, links and text
give its own potentials; a table over parent and child, by the child's kind of tag, gives those of the
edges. Sum-product messages go up and down the tree once and yield exact marginals; text whose element is
more likely content than not is kept.

All potentials are estimated from labelled pages: a few written here, which show what real pages surround an
article with, and a bounded sample of the corpus, labelled by its own article elements where it has one. The written
pages are learned once as they are and once without names and meanings, so that an element's place, its share of the
page's text and its controls have to tell what it is where names are foreign or missing.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F

SAMPLE_PAGES = 500
SMOOTHING = 0.5
MAIN_SHARE = 0.5
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|(?=<)|$)|<[!?][^>]*(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME_WORD = re.compile(r"[a-z]+")
# Fixed values of HTML: elements without an end, whose text is raw, that are never shown as text, and inline ones.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style title template noscript textarea select option button iframe noembed noframes svg math object canvas audio video datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
GENERIC = frozenset(("div", "span"))
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CONTROLS = frozenset("button input select textarea label".split())
_HOLDERS = frozenset("article aside div footer form header main nav ol section td ul".split())
_SCOPE = frozenset("article aside body div footer form header html main nav ol section table td th tr ul blockquote".split())


@dataclass
class Node:
    tag: str
    names: frozenset
    parent: int
    hidden: bool
    texts: list = field(default_factory=list)  # places in the page's list of text pieces
    label: bool | None = None
    chars: int = 0
    linked: int = 0
    total: int = 0
    total_linked: int = 0
    visible: int = 0
    share: float = 0.0  # of the page's visible text
    controls: int = 0  # buttons and fields inside
    headed: bool = False  # has a first heading inside
    outside: bool = False  # not in the innermost element, sections aside, that holds a first heading and most of the text


@dataclass
class Page:
    nodes: list
    pieces: list  # (node, text), or (node, None) at the bounds of blocks


def parse(source: str, marked: bool = False) -> Page:
    """The tree of a page, whatever its faults: unclosed elements end with their parent, stray ends are ignored.

    Open elements are found by their tag, so the time is in proportion to the page. Only with `marked`, for written
    pages, do `data-main` attributes label elements.
    """
    nodes = [Node("#page", frozenset(), -1, False)]
    pieces: list = [(0, None)]
    stack = [0]
    open_at: dict[str, list] = defaultdict(list)  # tag to the places in the stack of its open elements
    scopes: list = []  # those of elements beyond which nothing is closed without an end

    def text(value: str) -> None:
        if value:
            top = stack[-1]
            decoded = html.unescape(value)
            nodes[top].chars += len(decoded.strip())
            pieces.append((top, decoded))

    def close(count: int) -> None:
        for _ in range(count):
            name = nodes[stack.pop()].tag
            open_at[name].pop()
            if name in _SCOPE:
                scopes.pop()
            if name not in INLINE:
                pieces.append((stack[-1], None))

    def close_open(tag: str) -> None:
        """The elements that this tag's start ends."""
        closing = _CLOSES.get(tag, {"p"})
        while True:
            depth = max((open_at[name][-1] for name in closing if open_at[name]), default=0)
            barrier = next((place for place in reversed(scopes) if nodes[stack[place]].tag not in closing), 0)
            if depth <= barrier:
                return
            close(len(stack) - depth)
            if tag != "tr":
                return

    at, end = 0, len(source)
    while at < end:
        token = _TOKEN.search(source, at)
        if not token:
            text(source[at:])
            break
        text(source[at : token.start()])
        at = max(token.end(), token.start() + 1)
        if token[2] is None:
            continue
        tag = token[2].lower()
        if token[1]:
            if open_at[tag]:
                close(len(stack) - open_at[tag][-1])
            continue
        if tag not in INLINE or tag in _CLOSES:
            close_open(tag)
        if tag == "br":
            pieces.append((stack[-1], " "))
        if tag in VOID:
            if tag not in INLINE:
                pieces.append((stack[-1], None))
            continue
        parent = stack[-1]
        attributes = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(token[3])} if token[3].strip() else {}
        words = " ".join(attributes.get(k, "") for k in ("class", "id", "role")).lower()
        hidden = nodes[parent].hidden or tag in HIDDEN or "hidden" in token[3].split()
        node = Node(tag, frozenset(_NAME_WORD.findall(words)), parent, hidden)
        if marked and "data-main" in attributes:
            node.label = attributes["data-main"] == "1"
        nodes.append(node)
        if tag not in INLINE:
            pieces.append((parent, None))
        if token[3].rstrip().endswith("/") and tag in ("svg", "path"):
            continue
        open_at[tag].append(len(stack))
        if tag in _SCOPE:
            scopes.append(len(stack))
        stack.append(len(nodes) - 1)
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*(?:>|$)", re.I).search(source, at)
            text(source[at : stop.start() if stop else end])
            close(1)
            at = stop.end() if stop else end
    for node in reversed(nodes):  # children follow their parents
        node.total += node.chars
        node.visible += 0 if node.hidden else node.chars
        node.total_linked += node.chars if node.tag == "a" else node.linked
        if node.parent >= 0:
            above = nodes[node.parent]
            above.total += node.total
            above.linked += node.total_linked
            above.visible += node.visible
            above.controls += node.controls + (node.tag in _CONTROLS)
            above.headed |= node.headed or node.tag == "h1"
    main = 0
    for i, node in enumerate(nodes):
        node.share = node.visible / nodes[0].visible if nodes[0].visible else 0.0
        if node.tag in _HOLDERS and node.tag != "section" and node.headed and node.share >= MAIN_SHARE:
            main = i
    above, at = set(), main
    while at > 0:
        at = nodes[at].parent
        above.add(at)
    for i, node in enumerate(nodes):
        node.outside = i != main and i not in above and (node.parent in above or (i > 0 and nodes[node.parent].outside))
    return Page(nodes, pieces)


def features(node: Node) -> list[str]:
    """What an element shows of itself, each as one word.

    A short text says nothing, as articles have short blocks too; nor does the tag of an element without a meaning.
    """
    density = node.total_linked / node.total if node.total else 0
    return [
        *([] if node.tag in GENERIC else [f"tag:{node.tag}{'/linked' if density > 0.5 else ''}"]),
        f"links:{min(3, int(4 * density))}",
        *([f"text:{min(4, int(math.log10(node.total)))}"] if node.total >= 100 else []),
        *(f"name:{n}" for n in sorted(node.names)),
        *(["outside"] if node.outside else []),
        *(holder(node) if node.tag in _HOLDERS else []),
    ]


def holder(node: Node) -> list[str]:
    """What an element that holds blocks shows by its place in the page, whatever its names."""
    share = 0 if node.share < 0.1 else 1 if node.share < 0.25 else 2 if node.share < 0.5 else 3
    return [f"share:{share}{'/headed' if node.headed else ''}", *(["controls"] if node.controls and node.share < 0.5 else [])]


def _kind(tag: str) -> str:
    return "inline" if tag in INLINE else tag if tag in _SCOPE else "block"


@dataclass
class TreeModel:
    """Counts of labelled elements, and the potentials they give."""

    own: Counter = field(default_factory=Counter)  # (feature, label)
    edges: Counter = field(default_factory=Counter)  # (kind, parent label, label)
    labels: Counter = field(default_factory=Counter)

    def learn(self, page: Page, labels: list[bool], weight: int = 1) -> None:
        for i, node in enumerate(page.nodes):
            if node.hidden or not i:
                continue
            self.labels[labels[i]] += weight
            self.edges[_kind(node.tag), labels[node.parent], labels[i]] += weight
            for feature in features(node):
                self.own[feature, labels[i]] += weight

    def potential(self, feature: str) -> float:
        """Log ratio of the feature's share among content and other elements; 0 for one never seen."""
        yes, no = self.own[feature, True], self.own[feature, False]
        if not yes + no:
            return 0.0
        return math.log((yes + SMOOTHING) / (self.labels[True] + 1)) - math.log((no + SMOOTHING) / (self.labels[False] + 1))

    def edge(self, kind: str) -> list[list[float]]:
        """Log shares of the child's labels given its parent's."""
        table = []
        for parent in (False, True):
            counts = [self.edges[kind, parent, child] + (2.0 if parent == child else 1.0) * SMOOTHING for child in (False, True)]
            prior = [self.labels[child] + 1 for child in (False, True)]
            total, everything = sum(counts), sum(prior)
            table.append([math.log(c / total) - 0.5 * math.log(p / everything) for c, p in zip(counts, prior)])
        return table

    def freeze(self) -> "Potentials":
        return Potentials({f: self.potential(f) for f, _ in self.own}, {k: self.edge(k) for k, _, _ in self.edges}, self.edge(""))


def _log_sum(a: float, b: float) -> float:
    high, low = (a, b) if a > b else (b, a)
    return high + math.log1p(math.exp(low - high))


@dataclass
class Potentials:
    own: dict
    edges: dict
    default: list

    def marginals(self, page: Page) -> list[float]:
        """The probability that each element is content, by messages up and then down the tree.

        Hidden elements are known not to be content, and the page itself is.
        """
        nodes = page.nodes
        unary = [(0.0, 0.0 if n.hidden else sum(self.own.get(f, 0.0) for f in features(n))) for n in nodes]
        unary = [(0.0, -60.0) if n.hidden else u for n, u in zip(nodes, unary)]
        unary[0] = (-60.0, 0.0)
        tables = [self.edges.get(_kind(n.tag), self.default) for n in nodes]
        inward = [list(u) for u in unary]
        messages: list = [None] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            table, (no, yes) = tables[i], inward[i]
            messages[i] = (_log_sum(table[0][0] + no, table[0][1] + yes), _log_sum(table[1][0] + no, table[1][1] + yes))
            above = inward[nodes[i].parent]
            above[0] += messages[i][0]
            above[1] += messages[i][1]
        outward: list = [(0.0, 0.0)] * len(nodes)
        out = [0.0] * len(nodes)
        for i, node in enumerate(nodes):
            if i:
                up, table, own = node.parent, tables[i], messages[i]
                rest = [inward[up][s] + outward[up][s] - own[s] for s in (0, 1)]
                outward[i] = tuple(_log_sum(rest[0] + table[0][s], rest[1] + table[1][s]) for s in (0, 1))
            gap = inward[i][0] + outward[i][0] - inward[i][1] - outward[i][1]
            out[i] = 1 / (1 + math.exp(min(gap, 700)))
        return out


def main_text(source: str | None, model: Potentials) -> str:
    """Blocks of the kept elements in page order, each with its white space as single spaces, joined by line ends."""
    if not source:
        return ""
    page = parse(source)
    keep = [p > 0.5 for p in model.marginals(page)]
    blocks, current = [], []
    for node, value in page.pieces:
        if value is None:
            blocks.append("".join(current))
            current = []
        elif keep[node] and not page.nodes[node].hidden:
            current.append(value)
    blocks.append("".join(current))
    return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


# ---------------------------------------------------------------- labelled pages

_WORDS = "The reservoir was drained in autumn and surveyed by boat before the valley road opened again to farm traffic".split()


def _prose(n: int, start: int = 0) -> str:
    return " ".join(_WORDS[(start + 5 * i + i // 7) % len(_WORDS)] for i in range(n)) + "."


def _links(*words: str) -> str:
    return "".join(f'<li><a href="/{w}">{w}</a></li>' for w in words)


_AROUND = {  # what surrounds or interrupts an article; none of it is content
    "nav": f"<nav><ul>{_links('home', 'news', 'sport', 'contact')}</ul></nav>",
    "menu": f'<div class="menu navigation"><ul>{_links("start", "archive", "team")}</ul></div>',
    "nav_list": f'<ul class="nav navbar menu" id="nav" role="navigation">{_links("about", "shop")}</ul>',
    "crumbs": '<div class="breadcrumb breadcrumbs"><a href="/">Home</a> &gt; <a href="/n">News</a></div>',
    "header": f'<header class="header site masthead" role="banner"><h1><a href="/">The Daily</a></h1><p>{_prose(6)}</p></header>',
    "header_div": f'<div id="header" class="header top banner"><div class="logo"><p>{_prose(5)}</p></div></div>',
    "footer": f'<footer class="footer" role="contentinfo"><p>&copy; 2020 {_prose(9, 2)}</p></footer>',
    "footer_div": f'<div id="footer" class="footer bottom copyright"><p>{_prose(8, 1)}</p><ul>{_links("terms", "privacy")}</ul></div>',
    "footer_text": f"<footer>&copy; site &middot; {_prose(12, 4)}</footer>",
    "aside": f'<aside><h3>More</h3><p>{_prose(14, 3)}</p><ul>{_links("one", "two")}</ul></aside>',
    "sidebar": f'<div class="sidebar side widget" role="complementary"><h4>Popular</h4><p>{_prose(20, 5)}</p></div>',
    "related": f'<section class="related recommended more popular"><h3>Related</h3><p>{_prose(11, 6)}</p><ul>{_links("a", "b")}</ul></section>',
    "ad": f'<div class="ad">{_prose(10, 7)}</div>',
    "advert": f'<div class="advert ads advertisement sponsored sponsor promo promotion banner"><p>{_prose(16, 8)}</p></div>',
    "ad_section": f'<section class="ad ads promo"><p>{_prose(13, 9)}</p></section>',
    "notice": f'<div class="cookie notice cookies consent banner gdpr alert"><p>{_prose(18, 10)}</p><button>OK</button></div>',
    "notice_section": f'<section class="notice alert message popup modal overlay"><p>{_prose(12, 11)}</p></section>',
    "subscribe": f'<div class="newsletter subscribe signup subscription paywall"><p>{_prose(9, 12)}</p></div>',
    "form": f'<form action="/s"><p>{_prose(6, 13)}</p><label>Mail</label><input type="text"><div><span>{_prose(4)}</span></div></form>',
    "search": '<form class="search login" role="search"><label>Search</label><input name="q"></form>',
    "comments": f'<section class="comments" id="comments"><h2>Comments</h2><div class="comment"><p>{_prose(25, 14)}</p></div><div class="comment"><b>Sam</b><p>{_prose(15, 1)}</p></div></section>',
    "comment_list": f'<div class="comments discussion responses reactions disqus"><ul><li class="comment reply"><p>{_prose(18, 2)}</p></li><li class="comment"><p>{_prose(30, 3)}</p></li></ul></div>',
    "comment_list2": f'<ol class="commentlist comments"><li class="comment"><article class="comment"><p>{_prose(22, 6)}</p></article></li></ol>',
    "share": '<div class="share social sharing"><a href="#">Post</a> <a href="#">Send</a></div>',
    "tags": f'<div class="tags meta tagcloud"><ul>{_links("x", "y")}</ul></div>',
    "pager": '<div class="pagination pager"><a href="2">Next</a></div>',
}
_INSIDE = (  # forms of an article's own blocks
    f"<h1>{_prose(6, 3)}</h1><p>{_prose(40)}</p><p>{_prose(25, 4)}</p>",
    f"<h1>{_prose(5)}</h1><p><b>{_prose(30, 2)}</b><br><p>{_prose(50, 5)}</p><p>{_prose(3, 9)}</p>",
    f"<h1>{_prose(4)}</h1><h2>{_prose(4, 8)}</h2><p>{_prose(30, 1)} <a href='/x'>{_prose(2)}</a> <em>{_prose(6)}</em></p>"
    f"<ul><li>{_prose(7)}</li><li>{_prose(9, 4)}</li></ul><blockquote><p>{_prose(12, 7)}</p></blockquote>",
    f"<h2>{_prose(5, 1)}</h2><p>{_prose(60, 3)}</p><ol><li>{_prose(6)}</li></ol><pre>{_prose(9)}</pre>"
    f"<table><tr><td>{_prose(2)}</td><td>{_prose(3)}</td></tr></table><figure><figcaption>{_prose(5)}</figcaption></figure>",
    f"<section><h2>{_prose(3)}</h2><p>{_prose(20, 6)}</p></section><section><h3>{_prose(3, 2)}</h3><p>{_prose(35)}</p><div><p>{_prose(11)}</p></div></section>",
    f"<h1>{_prose(3)}</h1>{_prose(30, 5)}<div>{_prose(20, 2)}</div><p><span>{_prose(10)}</span> <strong>{_prose(3)}</strong> <i>{_prose(3)}</i></p><dl><dt>{_prose(2)}</dt><dd>{_prose(8)}</dd></dl>",
)
_FRAMES = (  # how an article is held
    '<article data-main="1">{}</article>',
    '<main role="main"><article class="post article entry" data-main="1">{}</article></main>',
    '<div class="page wrapper container"><main id="main" class="main content" data-main="1">{}</main></div>',
    '<div id="wrapper"><div class="content article body post text story entry main" id="content" data-main="1">{}</div></div>',
    '<div><article data-main="1"><div class="article body content">{}</div></article></div>',
    '<section class="article content" data-main="1">{}</section>',
    '<div><div><div><div data-main="1">{}</div></div></div></div>',
    '<div data-main="1"><div><div>{}</div></div></div>',
)


def written_pages() -> list[str]:
    """Every frame with every form of blocks, alone, and with all surroundings before, inside and after in turn."""
    around = list(_AROUND.values())
    pages = []
    for i, frame in enumerate(_FRAMES):
        for j, inside in enumerate(_INSIDE):
            turn = (7 * i + 5 * j) % len(around)
            parts = (around[turn:] + around[:turn])[:12]
            cut = inside.find("</p>") + 4
            marked = re.sub(r"^<(\w+)", r'<\1 data-main="0"', parts[2])
            held = inside[:cut] + marked + inside[cut:] + (re.sub(r"^<(\w+)", r'<\1 data-main="0"', parts[3]) if j % 2 else "")
            body = "".join(parts[4:8]) + frame.format(held) + "".join(parts[8:])
            pages.append(f"<html><body>{frame.format(f'<div><div>{inside}</div></div>')}</body></html>")
            pages.append(f"<!DOCTYPE html><html><head><title>t</title></head><body>{body}</body></html>")
    return pages


def unnamed(source: str) -> str:
    """The page without the names and meanings of its elements: only structure is left to learn from."""
    plain = re.sub(r"(</?)(?:article|aside|footer|header|main|nav|section)\b", r"\1div", source)
    return re.sub(r' (?:class|id|role)="[^"]*"', "", plain)


def labels_of(page: Page) -> list[bool] | None:
    """Every element's label: that of the nearest marked element above. What only holds content is content too."""
    nodes = page.nodes
    labels = [False] * len(nodes)
    for i, node in enumerate(nodes):
        if i:
            labels[i] = node.label if node.label is not None else labels[node.parent]
    if not any(labels):
        return None
    holds = list(labels)
    for i in range(len(nodes) - 1, 0, -1):
        if holds[i]:
            holds[nodes[i].parent] = True
    return [a or (h and n.chars == 0) for a, h, n in zip(labels, holds, nodes)]


def mark_articles(page: Page) -> bool:
    """Label a page of the corpus by its article, if it has exactly one outside other marked parts."""
    articles = [n for n in page.nodes if n.tag == "article" and not n.names & {"comment"}]
    if len(articles) != 1:
        return False
    articles[0].label = True
    for node in page.nodes:
        if node.tag in ("nav", "aside", "footer", "form", "header"):
            node.label = False
    return True


def train(pages: DataFrame | None = None, sample_pages: int = SAMPLE_PAGES) -> Potentials:
    """Potentials from the written pages and at most about `sample_pages` rows of `pages`, chosen by hash."""
    model = TreeModel()
    for source in written_pages():
        for form in (source, unnamed(source)):
            page = parse(form, marked=True)
            model.learn(page, labels_of(page), 5)
    if pages is not None:
        share = min(1.0, sample_pages / max(1, pages.count()))
        draw = F.pmod(F.xxhash64(F.lit(2), "page_id"), F.lit(1 << 30)) < int(share * (1 << 30))

        def counts(frames):
            for frame in frames:
                local = TreeModel()
                for source in frame["html"]:
                    page = parse(source or "")
                    if mark_articles(page):
                        local.learn(page, labels_of(page))
                rows = [("own", f, "", y, n) for (f, y), n in local.own.items() if not f.startswith("name:")]
                rows += [("edge", k, str(p), y, n) for (k, p, y), n in local.edges.items()]
                rows += [("label", "", "", y, n) for y, n in local.labels.items()]
                yield pd.DataFrame(rows, columns=["what", "key", "parent", "label", "n"])

        made = pages.where(draw).select("html").mapInPandas(counts, "what string, key string, parent string, label boolean, n long")
        totals = made.groupBy("what", "key", "parent", "label").agg(F.sum("n").alias("n"))
        # the corpus weighs as much as the written pages at most
        rows = totals.collect()  # of the sample's pages alone
        seen = sum(r["n"] for r in rows if r["what"] == "label")
        weight = min(1.0, sum(model.labels.values()) / seen) if seen else 0.0
        for r in rows:
            n = r["n"] * weight
            if r["what"] == "own":
                model.own[r["key"], r["label"]] += n
            elif r["what"] == "edge":
                model.edges[r["key"], r["parent"] == "True", r["label"]] += n
            else:
                model.labels[r["label"]] += n
    return model.freeze()


def extract(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages` (page_id, url, html; more columns are ignored).

    A null or empty page has an empty text. Repeated rows are extracted each. An empty table gives no rows.
    """
    model = pages.sparkSession.sparkContext.broadcast(train(pages, sample_pages))  # some kilobytes

    def text(sources: pd.Series) -> pd.Series:
        return pd.Series([main_text(s, model.value) for s in sources], dtype=object)

    out = pages.select("page_id", "url", F.pandas_udf(text, "string")("html").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
