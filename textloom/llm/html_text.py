"""Composite text density: every DOM node gets link-adjusted characters per tag, and the densities of its children
are summed. The node of the largest sum is the heart of the article. The lowest density on its way to the body is
the threshold: beside that way, only subtrees that reach it are article too (a post in parts, a list of posts), and
headings that come before.

What can't be article (scripts, forms, menus, page headers and footers, asides, and elements that their class,
id or role names as advert, notice, sidebar or comments) is left out before densities are computed. No tag makes
an element article: <article> and <main> count like any other, except that headers in them aren't the page's.

Edge cases: null, empty and tag-only pages give an empty text; of equal sums the outer, then the earlier node
counts; pages may be cut off anywhere (open elements end with the page, an unclosed comment or script hides the
rest); very long and very deep pages take time in proportion to their length; repeated rows and null ids pass
through; an empty table gives an empty result; columns other than page_id, url and html aren't read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|select)\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:\"[^\"]*+\"|'[^']*+'|[^>\"']++)*+)>|<(?P<bad>/?[a-zA-Z][^>]*+)>",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_OUT = frozenset("head nav footer aside form button dialog menu video audio canvas".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies disqus footer header "
    "masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related share sharing sidebar social sponsor "
    "sponsored subscribe toolbar widget complementary contentinfo search".split()
)
_HEADS = frozenset("header masthead".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of a class that say what the element is like, not what it is.
_STATES = frozenset("has with no is without".split())
_STORY = frozenset("content article post entry main body story text".split())
#: An end tag is implied by these start tags.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


class _Node:
    __slots__ = ("chars", "children", "density", "first", "link_chars", "link_tags", "name", "out", "parent", "past", "tags")

    def __init__(self, name: str, parent: _Node | None, out: bool, first: int) -> None:
        self.name, self.parent, self.out, self.first, self.past = name, parent, out, first, first
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.children: list[_Node] = []
        self.density = 0.0


def _unwanted(name: str, attrs: str, inside: bool) -> bool:
    if name in _OUT or name == "header" and not inside:
        return True
    if name in ("html", "body", "article", "main") or "=" not in attrs:
        return False
    for _, value in _NAMED.findall(attrs):
        names = [[p for p in re.split(r"[^a-z0-9]+", n) if p] for n in value.lower().strip("\"'").split()]
        names = [n for n in names if n and n[0] not in _STATES]
        bad = [n for n in names if not _NAMES.isdisjoint(n)]
        if inside:  # a heading of the article
            bad = [n for n in bad if not _HEADS & set(n) or not _NAMES.isdisjoint(set(n) - _HEADS)]
        # one name that says story and another that says aside: the story wins
        if bad and not any(len(n) == 1 and n[0] in _STORY for n in names):
            return True
    return False


def _parse(html: str) -> tuple[_Node, list[str]]:
    """The tree and the text segments in page order; a node's text is segments[first:past]."""
    root = _Node("#root", None, False, 0)
    open_: list[_Node] = [root]
    parts: list[str] = []
    there: Counter[str] = Counter()  # names of open elements

    def close(k: int) -> None:
        while len(open_) > k:
            n = open_.pop()
            there[n.name] -= 1
            if n.name not in _INLINE and not n.out:
                parts.append(" ")
            n.past = len(parts)

    def text(s: str) -> None:
        if s and not open_[-1].out:
            s = unescape(s)
            parts.append(s)
            open_[-1].chars += len(s.strip()) if s.isspace() or s[:1].isspace() or s[-1:].isspace() else len(s)

    at = 0
    for m in _TAG.finditer(html):
        text(html[at : m.start()])
        at = m.end()
        name = m["name"] or m["bad"]
        if not name:
            continue
        if m["bad"]:
            end, name, attrs = name[0] == "/", name.lstrip("/").split(None, 1)[0].rstrip("/"), ""
        else:
            end, attrs = bool(m["end"]), m["attrs"]
        name = name.lower()
        if end:
            if not there[name]:
                continue
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].name == name:
                    close(k)
                    break
                if open_[k].name in ("article", "body", "td", "table") and name in _INLINE | {"p", "li"}:
                    break
            continue
        if name in _CLOSE_P and there["p"]:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].name == "p":
                    close(k)
                    break
                if open_[k].name not in _INLINE:
                    break
        elif name in _CLOSES and any(there[x] for x in _CLOSES[name][0]):
            shut, stop = _CLOSES[name]
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].name in stop:
                    break
                if open_[k].name in shut:
                    close(k)
                    break
        top = open_[-1]
        if name not in _INLINE and not top.out:
            parts.append(" ")
        inside = there["article"] + there["main"] > 0
        node = _Node(name, top, top.out or _unwanted(name, attrs, inside), len(parts))
        if not node.out:
            top.children.append(node)
        if name not in _VOID:
            open_.append(node)
            there[name] += 1
    text(html[at:])
    close(1)
    root.past = len(parts)
    return root, parts


def _nodes(root: _Node) -> list[_Node]:
    """Every node, parents before children."""
    out = [root]
    for n in out:
        out.extend(n.children)
    return out


def _measure(nodes: list[_Node]) -> None:
    """Fills in densities; nodes: parents before children."""
    for n in reversed(nodes):
        if n.name == "a":
            n.link_chars, n.link_tags = n.chars + sum(c.chars for c in n.children), 1
        for c in n.children:
            n.chars += c.chars
            n.tags += c.tags + 1
            if n.name != "a":
                n.link_chars += c.link_chars
            n.link_tags += c.link_tags
    body = next((n for n in nodes if n.name == "body"), nodes[0])
    rate = body.link_chars / max(body.chars, 1)
    for n in nodes:
        c, t, lc, lt = n.chars, max(n.tags, 1), n.link_chars, n.link_tags
        if not c:
            continue
        # the published base is a logarithm once more, near 1 where links are few: then any short text without
        # links would outweigh long ones. Left out, the measure stays finite
        base = c / max(c - lc, 1) * lc + rate * c + math.e
        n.density = c / t * max(math.log(c / max(lc, 1) * t / max(lt, 1)), 0.0) / math.log(base) if lc or rate else c / t


def _chosen(nodes: list[_Node]) -> list[_Node]:
    """The subtrees that are the article, in page order."""
    # marks inside a line are measured, but a line isn't the sum of its marks
    blocks = [n for n in nodes if n.name not in _INLINE]
    sums = {id(n): sum(c.density for c in n.children if c.name not in _INLINE) for n in blocks}
    best = max(blocks, key=lambda n: sums[id(n)])  # the first of equal ones
    if not sums[id(best)]:
        best = max(blocks, key=lambda n: n.density)
    way = [best]
    while way[-1].name != "body" and way[-1].parent is not None:
        way.append(way[-1].parent)
    threshold = min(n.density for n in way)
    before: list[_Node] = []
    after: list[_Node] = []
    for n, above in zip(way, way[1:], strict=False):
        at = next(k for k, c in enumerate(above.children) if c is n)
        # a heading is short: what tells it is that it stands right before
        head = next((k for k in range(at, 0, -1) if not _is_heading(above.children[k - 1])), 0)
        before = [c for k, c in enumerate(above.children[:at]) if k >= head or c.density >= threshold] + before
        after += [c for c in above.children[at + 1 :] if c.density >= threshold]
    return [*before, best, *after]


def _is_heading(n: _Node) -> bool:
    """Whether all text of a subtree is in headings (or in a header that has one)."""
    todo = [n]
    while todo:
        x = todo.pop()
        if x.name in _HEADINGS or x.name in ("header", "hgroup") and any(c.name in _HEADINGS for c in x.children):
            continue
        own = [c for c in x.children if c.chars]
        if not own or x.chars != sum(c.chars for c in own):
            return False
        todo += own
    return True


def main_text(html: str | None) -> str:
    if not isinstance(html, str) or not html:
        return ""
    root, parts = _parse(html)
    nodes = _nodes(root)
    _measure(nodes)
    if not root.chars:
        return ""
    return _joined(parts, _chosen(nodes))


def _joined(parts: list[str], taken: list[_Node]) -> str:
    return " ".join(" ".join("".join(parts[n.first : n.past]) for n in taken).split())


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [main_text(h) for h in b["html"].tolist()]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    bounded_batches(pages.sparkSession)
    # ids pass through Python as text: pandas would make nullable ones floats
    rows = pages.selectExpr("cast(page_id as string) page_id", "url", f"`{html}` html").mapInPandas(run, "page_id string, url string, text string, n_chars long")
    return rows.selectExpr("cast(page_id as long) page_id", "url", "text", "n_chars")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op5_html": op5_html}
SQL = {}
