"""HTML extraction by composite text density.

A page becomes a tree of block elements. Each node has a density: its characters per tag, adjusted by how many of the
characters and tags are links. The node with the largest sum of its children's densities holds the main text; the
smallest density on its path up to the body is the threshold that other subtrees must reach to be main text too.

Elements that are no content by their kind (scripts, forms, menus, footers and the like) are left out before densities are
computed. Words of a class, an ID or a role, or standing beside the article element that holds the main text, decide nothing by
themselves: they scale the density of a subtree by ``DOUBT``, and it goes only if it then falls below the threshold,
inside the main text as beside it.

Text is taken block by block in page order: character references are decoded, white space becomes one space.

Defined results: NULL, empty or text-free pages give an empty text; markup that ends early or is not closed is read as far
as it goes; rows that repeat are treated alike; nothing is cut off.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from evidentia.llm.common import map_batches, table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|style)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true", re.I)
WORD = re.compile("[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike "
    "strong sub sup time tt u var".split())
LEFT_OUT = frozenset(
    "head script style noscript template iframe nav aside footer form button select textarea menu dialog svg canvas object "
    "audio video fieldset datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MARKS = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent notice notices gdpr popup modal overlay newsletter "
    "subscribe subscription share sharing social related recommended recommendations comment comments respond discussion disqus "
    "form login signup search toolbar skip pagination pager widget".split())
#: What is left of the density of a subtree whose class, ID, role or place says that it is no content.
DOUBT = 0.001
#: Left out unless they belong to an article.
HEADERS = frozenset(["header"])
ARTICLES = frozenset(["article", "main"])
#: An element of the second kind ends an open one of the first.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section summary table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIST_BOUND = frozenset(["ul", "ol", "dl", "table", "menu", "select", "div", "article", "section", "body"])


class Page:
    """The block tree of a page: parallel lists of node properties, and the runs of text in page order."""

    def __init__(self, source: str):
        self.parent, self.tag, self.out, self.doubt = [-1], ["#root"], [False], [False]
        self.tags, self.links, self.link_chars = [0], [0], [0]
        self.runs: list[tuple[int, list[str]]] = []
        self._read(source)
        self.texts = [(n, " ".join(html.unescape("".join(parts)).split())) for n, parts in self.runs if not self.out[n]]
        self.texts = [(n, t) for n, t in self.texts if t]

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = []  # open elements, each with the block it belongs to
        node, anchors, fresh, place = 0, 0, True, 0
        runs = self.runs

        def text(part: str) -> None:
            nonlocal fresh
            if fresh:
                runs.append((node, []))
                fresh = False
            runs[-1][1].append(part)
            if anchors:
                self.link_chars[node] += len("".join(part.split()))

        def close(to: int) -> None:
            nonlocal node, anchors, fresh
            while len(stack) > to:
                name, _ = stack.pop()
                if name == "a":
                    anchors -= 1
                elif name not in INLINE:
                    fresh = True
            node = stack[-1][1] if stack else 0

        def find(names: tuple[str, ...], bound: frozenset[str]) -> int:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in names:
                    return i
                if stack[i][0] in bound:
                    return -1
            return -1

        while place < len(source):
            token = TOKEN.search(source, place)
            if token is None:
                text(source[place:])
                break
            if token.start() > place:
                text(source[place:token.start()])
            place = token.end()
            name = token[2] or token[5]
            if not name:
                continue
            name, attributes = name.lower(), token[3] or token[6] or ""
            if token[1] or token[4]:
                at = find((name,), frozenset())
                if at >= 0:
                    close(at)
                continue
            if name in ENDS_P and (at := find(("p",), frozenset(["table", "td", "article", "section", "div", "body"]))) >= 0:
                close(at)
            if name in SIBLINGS and (at := find(SIBLINGS[name], LIST_BOUND)) >= 0:
                close(at)
            self.tags[node] += 1
            if name in VOID:
                text(" ")
                fresh = fresh or name == "hr"
                continue
            if name == "a":
                anchors += 1
                self.links[node] += 1
            out, doubt = self._judged(name, attributes, node)
            if name not in INLINE or out or doubt:
                self.parent.append(node)
                self.tag.append(name)
                self.out.append(self.out[node] or out)
                self.doubt.append(self.doubt[node] or doubt)
                for values in (self.tags, self.links, self.link_chars):
                    values.append(0)
                node = len(self.parent) - 1
                fresh = True
            stack.append((name, node))
            if name in RAW:
                end = re.compile(f"</{name}", re.I).search(source, place)
                place = end.start() if end else len(source)

    def _judged(self, name: str, attributes: str, node: int) -> tuple[bool, bool]:
        """Whether an element is no content by its kind or hidden, and whether its attributes make it doubtful."""
        if name in LEFT_OUT or name in HEADERS and not self._in_article(node):
            return True, False
        if name in ("html", "body") or not attributes:
            return False, False
        if HIDDEN.search(attributes):
            return True, False
        doubt = False
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "style":
                if "display:none" in value.replace(" ", ""):
                    return True, False
            elif key == "role":
                doubt = doubt or value in ROLES
            elif name not in ARTICLES:
                words = set(WORD.findall(value))
                doubt = doubt or bool(words & MARKS or words & HEADERS and not self._in_article(node))
        return False, doubt

    def _in_article(self, node: int) -> bool:
        while node > 0:
            if self.tag[node] in ARTICLES:
                return True
            node = self.parent[node]
        return False

    def densities(self) -> tuple[list[float], list[float]]:
        """Density of every node, and the sum over its children (its own where it has none)."""
        n = len(self.parent)
        chars, tags, links, link_chars = [0] * n, list(self.tags), list(self.links), list(self.link_chars)
        for node, t in self.texts:
            chars[node] += len(t)
        for i in range(n - 1, 0, -1):  # a child stands behind its parent
            p = self.parent[i]
            if not self.out[i] and self.doubt[i] == self.doubt[p]:  # a doubtful subtree counts for itself only
                chars[p] += chars[i]
                tags[p] += tags[i]
                links[p] += links[i]
                link_chars[p] += link_chars[i]
        share = min(1.0, link_chars[0] / chars[0]) if chars[0] else 0.0
        density = [0.0 if self.out[i] else _density(chars[i], tags[i], min(link_chars[i], chars[i]), links[i], share) * (DOUBT if self.doubt[i] else 1) for i in range(n)]
        total, leaf = [0.0] * n, [True] * n
        for i in range(n - 1, 0, -1):
            if not self.out[i]:
                if leaf[i]:
                    total[i] = density[i]
                if self.doubt[i] == self.doubt[self.parent[i]]:
                    total[self.parent[i]] += density[i]
                    leaf[self.parent[i]] = False
        if leaf[0]:
            total[0] = density[0]
        return density, total

    def main_text(self) -> str:
        if not self.texts:
            return ""
        density, total = self.densities()
        best = max(range(len(total)), key=lambda i: (total[i], -i))
        path = [best]
        while self.parent[path[-1]] >= 0 and self.tag[path[-1]] != "body":
            path.append(self.parent[path[-1]])
        threshold = min(density[i] for i in path)
        above, near = set(path[1:]), set(path)
        article = next((i for i in reversed(path) if self.tag[i] in ARTICLES), None)
        within = [article is None] * len(total)
        # A node stands behind its parent: what is inside, and what a doubtful subtree below the threshold takes out.
        inside, gone = [False] * len(total), [False] * len(total)
        for i in range(len(total)):
            p = self.parent[i]
            within[i] = within[i] or i == article or p >= 0 and within[p]
            level = density[i] if within[i] or self.doubt[i] else density[i] * DOUBT
            dense = i not in above and level >= threshold and level > 0 and p in above
            inside[i] = i == best or dense or p >= 0 and inside[p]
            gone[i] = p >= 0 and gone[p] or (self.doubt[i] or not within[i]) and i not in near and i > path[-1] and level < threshold
        # Text that stands directly in a node above the main text, or a heading beside it, belongs to the same article.
        heading = lambda i: self.tag[i][0] == "h" and self.tag[i][1:].isdigit() and self.parent[i] in near
        return "\n".join(t for n, t in self.texts if not gone[n] and (inside[n] or n in near or heading(n)))


def _density(chars: int, tags: int, link_chars: int, links: int, share: float) -> float:
    """Characters per tag, scaled by a logarithm that falls as links take over; ``share`` is the link share of the page.

    On a page without links the base of the logarithm is 1, and characters per tag are the density.
    """
    if not chars:
        return 0.0
    tags = max(tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e)
    ratio = chars / max(link_chars, 1) * tags / max(links, 1)
    return max(0.0, chars / tags * (math.log(max(ratio, 1.0)) / math.log(base) if base > 1 else 1.0))


def extract(source: str | None) -> str:
    return Page(source).main_text() if source else ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(h) for h in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64(), size=len(texts))],
            ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_batches(pages.select("page_id", "url", "html"), work, f"page_id {kind}, url string, text string, n_chars long")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
