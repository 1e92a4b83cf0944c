"""Main text of web pages: every host's pages vote for the container that holds their articles."""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .common import fresh, written
from .urls import host

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?>[^'">]++|"[^"]*+"|'[^']*+')*+|[^>]*)>|<[/a-zA-Z][^<>]*\Z""", re.DOTALL)
_CLASS = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noframes xmp template".split())
#: Elements that start a block of text; the others stand within one.
_BLOCK = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre "
                   "figure figcaption address details summary fieldset form nav header footer aside hr center hgroup menu dialog legend head".split())
_ENDS_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Elements that are not the article, whatever they hold.
_APART = frozenset("head nav footer aside form script style noscript template iframe button select textarea title svg canvas object audio video dialog menu".split())
#: Roles of the page's own parts (fixed names of the format).
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Nouns that name a part that is not the article: they count as a whole class, as its last word ("cookie-notice"), or before one of the words for a place.
_NOUNS = frozenset("ad ads adv advert advertisement adverts advertising banner sponsor sponsored promo promotion nav navbar navigation menu sidebar footer "
                   "header masthead cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login share sharing "
                   "social related recommended breadcrumb breadcrumbs pagination pager widget toolbar comment comments commentlist respond replies disqus search dialog".split())
_PLACES = frozenset("area list box wrap wrapper container block section bar item items slot unit inner links buttons icons posts articles form thread panel row column group widget body "
                    "content text".split())
#: First words that only say what else the page has.
_SAYS = frozenset("has with without no is not hide show after before".split())
#: First words with which a header is the article's own.
_OWN = frozenset("post entry article story content section card".split())
#: Whole ids of containers that name such a part; other ids are names of sections and headings.
_IDS = frozenset("comments respond disqus_thread sidebar footer header nav navigation menu navbar newsletter cookie-banner cookie-notice".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CONTAINERS = frozenset("body article main section div td blockquote center".split())


def names_part(token: str) -> bool:
    """Whether a class names a part of the page that is not the article."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()) if w]
    if not words or words[0] in _SAYS or words[0] in _OWN and words[-1] == "header":
        return False
    return words[-1] in _NOUNS or len(words) > 1 and words[0] in _NOUNS and words[-1] in _PLACES


class Page:
    """Elements and text blocks of a page, in page order; damaged markup is closed as browsers do for these elements.

    What is apart from the article: elements that never hold it, and containers that a role, a whole class or one of few ids names so. A name
    doesn't count on a heading or on an element that stands around the main part (the first article without one) or around the title in it; where a page has
    none of these, on one that holds most of the text outside links.
    """

    def __init__(self, source: str):
        self.parent, self.name, self.apart = [-1], ["#"], [False]
        self.named = [0]  # 1: named as a part, 2: as the head or menu of the site
        self.tags, self.links = ["#"], 0
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters within links
        self.anchors: list[int] = []  # links of each block
        self._pieces: list[str] = []
        self._linked = self._anchors = 0
        stack, at, n = [0], 0, len(source)
        while at < n:
            m = _TAG.search(source, at)
            if m is None:
                self._text(stack[-1], source[at:])
                break
            if m.start() > at:
                self._text(stack[-1], source[at:m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                if m[0].startswith("<![CDATA["):
                    self._text(stack[-1], m[0][9:].removesuffix("]]>"))
                continue
            tag = tag.lower()
            if m[1]:
                self._close(stack, tag)
            elif tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE).search(source, at)
                at = end.end() if end else n
            elif tag == "br":
                self._pieces.append(" ")
            else:
                self._open(stack, tag, m[3])
        self._flush(stack[-1])
        self._settle()

    def _settle(self) -> None:
        """Elements that are apart only by name are so unless they stand around the article; what is below them follows."""
        if not any(self.named):
            return
        places = [(self.tags[e], e) for e in range(1, len(self.tags)) if not self.apart[e]]
        key = next((e for t, e in places if t == "main"), 0) or next((e for t, e in places if t == "article"), 0)
        title = next((e for t, e in places if t == "h1"), 0)
        around = self._upwards(key)
        if title and (not key or self._below(title, key)):
            around |= {e for e in self._upwards(title) if key or self.named[e] < 2}
        total, weight = 0, [0] * len(self.tags)
        if not key and not title:
            for element, text, linked in self.blocks:
                if not self.apart[element]:
                    weight[element] += max(0, len(text) - linked)
            total = sum(weight)
            for e in reversed(range(1, len(self.tags))):  # children come after their parents
                weight[self.parent[e]] += weight[e]
        for e in range(1, len(self.tags)):
            by_name = self.named[e] and e not in around and 2 * weight[e] <= total
            self.apart[e] = self.apart[e] or bool(by_name) or self.apart[self.parent[e]]

    def _upwards(self, element: int) -> set[int]:
        out = set()
        while element > 0:
            out.add(element)
            element = self.parent[element]
        return out

    def _below(self, element: int, top: int) -> bool:
        while element > top:
            element = self.parent[element]
        return element == top

    def _text(self, element: int, text: str) -> None:
        self._pieces.append(text)
        if self.links:
            self._linked += len(text)

    def _flush(self, element: int) -> None:
        if self._pieces:
            text = " ".join(entities.unescape("".join(self._pieces)).split())
            if text:
                while self.tags[element] not in _BLOCK and element:
                    element = self.parent[element]
                self.blocks.append((element, text, self._linked))
                self.anchors.append(self._anchors)
            self._pieces, self._linked, self._anchors = [], 0, 0

    def _pop(self, stack: list[int], to: int) -> None:
        while len(stack) > to:
            tag = self.tags[stack[-1]]
            if tag in _BLOCK:
                self._flush(stack[-1])
            elif tag == "a":
                self.links = max(0, self.links - 1)
            stack.pop()

    def _close(self, stack: list[int], tag: str) -> None:
        for i in range(len(stack) - 1, 0, -1):
            here = self.tags[stack[i]]
            if here == tag:
                return self._pop(stack, i)
            if here in _BLOCK and (tag not in _BLOCK or tag == "p" and here != "p"):
                return None  # an inline end tag does not end a block
            if tag in _HOLDS and here in _HOLDS[tag]:
                return None
        return None

    def _open(self, stack: list[int], tag: str, attributes: str) -> None:
        if tag in _BLOCK:
            self._flush(stack[-1])
            if tag in _ENDS_P:
                self._close(stack, "p")
            for same in _SAME.get(tag, ()):
                self._close(stack, same)
        parent, classes, apart, named = stack[-1], "", self.apart[stack[-1]] or tag in _APART, 0
        if attributes and not attributes.isspace():
            for k, *v in _CLASS.findall(attributes):
                value, kind = "".join(v), k.lower()
                if kind == "class":
                    classes = "".join("." + c for c in sorted(set(re.sub(r"\d+", "#", value.lower()).split())))
                    if tag not in _HEADINGS and any(map(names_part, value.split())):
                        named = max(named, 2 if re.search("(?i)header|masthead|banner|nav|menu", value) else 1)
                elif kind == "role":
                    named = max(named, 2 * (value.strip().lower() in _ROLES and tag not in _HEADINGS))
                elif tag in ("div", "ul", "ol") and value.strip().lower() in _IDS:
                    named = max(named, 2 if re.search("(?i)header|nav|menu", value) else 1)
        if tag in ("html", "body", "article", "main") or tag == "header":
            named = 0
        if tag == "header" and not any(self.tags[e] in ("article", "main") for e in stack):
            apart = True  # the head of the site, not of the article
        if tag in _VOID or attributes.endswith("/") and tag not in _BLOCK:
            return
        self.parent.append(parent)
        self.name.append(tag + classes)
        self.tags.append(tag)
        self.apart.append(apart)
        self.named.append(named)
        stack.append(len(self.tags) - 1)
        self.links += tag == "a"
        self._anchors += tag == "a"

    def path(self, element: int) -> str:
        """Tags and classes from the root, with digits generalised."""
        names = []
        while element > 0:
            names.append(self.name[element])
            element = self.parent[element]
        return ">".join(reversed(names))

    def scores(self) -> dict[int, float]:
        """Each block's characters outside links, given to the containers above it in falling shares."""
        found: dict[int, float] = {}
        for element, text, linked in self.blocks:
            if self.apart[element]:
                continue
            share, weight = 1.0, max(0, len(text) - 2 * linked)
            e = element if self.tags[element] in _CONTAINERS else self.parent[element]
            while e > 0 and share > 0.1:
                if self.tags[e] in _CONTAINERS:
                    found[e] = found.get(e, 0.0) + share * weight * (1.25 if self.tags[e] in ("article", "main") else 1.0)
                    share *= 0.7
                e = self.parent[e]
        return found

    def best(self) -> str | None:
        """The path of the container around the one with the highest score (the first in page order in a tie); see :meth:`whole`."""
        found = self.scores()
        return self.path(self.whole(max(found, key=lambda e: (found[e], -e)))) if found and max(found.values()) > 0 else None

    def whole(self, element: int) -> int:
        """The outermost article or main around a container; without one, its furthest parent up to which no link list stands beside it.

        A heading, a lead or a short section outside the container that holds most of the text belongs to the article too. A link list is
        what stands beside the way up, has two links and more, and half of its characters within links.
        """
        around, e = 0, element
        while e > 0:
            around = e if self.tags[e] in ("article", "main") else around
            e = self.parent[e]
        if around:
            return around
        beside: dict[int, list[int]] = {}  # characters, those within links, and links below each element
        for (e, text, linked), anchors in zip(self.blocks, self.anchors):
            while e > 0 and not self.apart[e]:
                n = beside.setdefault(e, [0, 0, 0])
                n[0], n[1], n[2] = n[0] + len(text), n[1] + linked, n[2] + anchors
                e = self.parent[e]
        # a block straight in an element counts as one of the parts beside, too
        parts: dict[int, list[tuple[int, int, int, int]]] = {}
        for e, n in beside.items():
            parts.setdefault(self.parent[e], []).append((e, *n))
        for (e, text, linked), anchors in zip(self.blocks, self.anchors):
            if not self.apart[e]:
                parts.setdefault(e, []).append((-1, len(text), linked, anchors))
        top, e = element, element
        while self.parent[e] > 0 and self.tags[e] != "body":
            if any(child != e and links > 1 and 2 * linked >= n for child, n, linked, links in parts.get(self.parent[e], ())):
                break
            e = self.parent[e]
            top = e if self.tags[e] in _CONTAINERS else top
        return top

    def text(self, path: str | None) -> str:
        """The blocks within the containers of a path, or within the best one where the page has none of them."""
        inside = self._within(path) if path else None
        if inside is None or not any(inside[e] and not self.apart[e] for e, *_ in self.blocks):
            best = self.best()
            inside = self._within(best) if best else [True] * len(self.tags)
        return "\n".join(t for e, t, _ in self.blocks if inside[e] and not self.apart[e])

    def _within(self, path: str) -> list[bool]:
        leaf = path.rpartition(">")[2]
        inside = [False] * len(self.tags)
        for e in range(1, len(self.tags)):
            inside[e] = inside[self.parent[e]] or self.name[e] == leaf and self.path(e) == path
        return inside


@F.pandas_udf(T.StringType())
def best_path(pages: pd.Series) -> pd.Series:
    return pd.Series([Page(p).best() if p else None for p in pages], dtype=object)


@F.pandas_udf(T.StringType())
def main_text(pages: pd.Series, paths: pd.Series) -> pd.Series:
    return pd.Series([Page(p).text(path) if p else "" for p, path in zip(pages, paths)], dtype=object)


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the container path that most pages of a host vote for; ties to the first path in order.

    A page has one vote, for its best container. Votes are counted with map-side combination, so a host with a third of all pages
    sends a few rows from each task.
    """
    votes = (pages.select(host(F.col("url")).alias("host"), best_path("html").alias("path")).where("host IS NOT NULL AND path IS NOT NULL")
             .groupBy("host", "path").agg(F.count("*").alias("votes")))
    return votes.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), "path")).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """Adds ``main_text`` to every page: the article's blocks in page order, joined by line feeds.

    The winning path of the page's host decides; a page that lacks it, or whose address has no host, is read by its own best container.
    NULL and empty pages give the empty text, as do pages without text. Repeated rows keep one result each; a column
    ``main_text`` of the table is replaced. The winners are written to the shared folder first: few enough hosts are sent to every task,
    otherwise the pages are shuffled once by host and large hosts are split.
    """
    winners = written(winning_paths(pages.select("url", "html")), "host-paths")
    key, path = fresh(pages, "host", "path")
    joined = pages.withColumn(key, host(F.col("url"))).join(winners.select(F.col("host").alias(key), F.col("path").alias(path)), key, "left")
    return joined.withColumn("main_text", main_text("html", path)).drop(key, path)
