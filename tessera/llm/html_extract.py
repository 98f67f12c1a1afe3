"""Main text of web pages by tag-path ratios.

A page is cut into text blocks, each with the path of block-level tags from the root. For every path the text
length, the punctuation and the number of blocks are summed: its text ratio is the text for each block, its
punctuation ratio the marks for each block. Both are spread along the page's order (a Gaussian over neighbouring
blocks), fused by their product with the share of text outside links, and paths that reach a share of the page's
spread (the root mean square of its scores) are content, on every page. Tags that never hold an article's text and
hidden elements are left out before. Marks only weigh: a path inside ``article`` or ``main`` and a heading need a lower
score, and each element around a path that a class, an id or a role calls chrome takes a factor off its score, so that
a mark that lies around the whole page decides nothing.

A path may score low and yet belong to the article: lists, tables, captions, its title. So the content paths tell where
the article is, the lowest element that holds four fifths of their text (or the ``article`` or ``main`` around it), and
what stands in there is kept: every block but those that a mark inside it calls chrome and those of an inner element
that is links for the most part. How long the rest of the article is does not matter for that.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import map_text

#: HTML's void, raw-text, phrasing and implied-end elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg title xmp noframes noembed".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}

#: Elements whose text is never the article's.
CHROME = frozenset("head nav footer aside form button select menu dialog search fieldset noscript input".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Class and id names that mark what is around an article: one of these words, alone or with words that tell of a place or a shape.
CHROME_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner cookie cookies consent notice notices gdpr popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer masthead comment comments commentlist remark remarks reaction reactions reply feedback discussion disqus respond replies share sharing social related recommend recommended recommendations subscribe newsletter signup login widget widgets toolbar pagination pager skip hidden".split())
PLACES = frozenset("user users reader readers visitor visitors site page global main top bottom left right primary secondary header footer box area list lists wrapper wrap container content inner outer section block bar links link items item buttons button icons form post posts articles thread panel slot unit text title menu row col column".split())
ARTICLE = frozenset(("article", "main"))

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、؛؟]")
#: Spread of the smoothing in blocks, and the share of the page's spread that content paths reach.
SIGMA, SHARE = 1.0, 0.5
#: The share of the content paths' text that the article's element holds, and the share of links from which an inner element is a list of them.
HELD, LINKS = 0.8, 0.5
#: Weights of paths inside an article, of headings and of each chrome mark around a path.
IN_ARTICLE, HEADING, MARKED = 2.0, 4.0, 0.05
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def hidden(tag: str, attributes: str, article: bool = False) -> bool:
    """Whether an element's text is never shown or never an article's; a header is the article's own inside of one."""
    if tag in CHROME or tag == "header" and not article:
        return True
    if tag in ("body", "html"):
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def names_chrome(value: str) -> bool:
    """Whether one of the names in a class or id value is a chrome word, or such words and words of places alone."""
    for name in value.lower().split():
        words = [w for w in re.split(r"[_\W\d]+", name) if w]
        if any(w in CHROME_NAMES for w in words) and all(w in CHROME_NAMES or w in PLACES for w in words) and (len(words) < 3 or words[0] != words[-1]):
            return True
        if words in (["site", "header"], ["page", "header"]):
            return True
    return False


def marked(tag: str, attributes: str) -> bool:
    """Whether a class, an id or a role calls an element chrome."""
    if tag in ARTICLE or tag in ("body", "html"):
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "role" and value.lower() in CHROME_ROLES or name in ("class", "id") and names_chrome(value):
            return True
    return False


class Scanner:
    """Finds a page's markup from front to back; what was looked for in vain is not looked for again, so the work is linear."""

    def __init__(self, page: str):
        self.page, self.n = page, len(page)
        self.dead: set[int] = set()  # quotes from which no tag ends
        self.seen: dict[str, tuple[int, int]] = {}  # of a mark: the place it was sought from last, and where it is
        self.ends: dict[str, re.Pattern] = {}

    def find(self, mark: str, at: int) -> int:
        """Like str.find for places that never fall; the length of the page if there is none."""
        asked, got = self.seen.get(mark, (0, -1))
        if not asked <= at <= got:
            got = self.page.find(mark, at)
            got = self.n if got < 0 else got
            self.seen[mark] = at, got
        return got

    def stop(self, at: int) -> int:
        """The next end of a tag or quote."""
        return min(self.find(">", at), self.find('"', at), self.find("'", at))

    def tag_end(self, at: int) -> int:
        """Where the tag whose attributes begin at ``at`` ends, quotes passed over; -1 if it never does."""
        opened = []
        while (q := self.stop(at)) < self.n:
            c = self.page[q]
            if c == ">":
                return q
            close = -1 if q in self.dead else self.page.find(c, q + 1)
            opened.append(q)
            if close < 0:
                break
            at = close + 1
        self.dead.update(opened)
        return -1

    def raw_end(self, tag: str, at: int) -> int:
        """Where the text of a raw element ends, its end tag included."""
        if tag not in self.ends:
            self.ends[tag] = re.compile(rf"</{re.escape(tag)}\s*>", re.I)
        end = self.ends[tag].search(self.page, at)
        return end.end() if end else self.n

    def tokens(self) -> Iterator[tuple[str, str, str]]:
        """(kind, text or tag, attributes): kinds are text, start and end. Comments and declarations are left out."""
        page, n, at, begun = self.page, self.n, 0, 0
        while (lt := page.find("<", at)) >= 0:
            following, token, end = page[lt + 1 : lt + 2], None, -1
            if following in ("!", "?"):
                if page.startswith("<!--", lt):
                    end = min(n, self.find("-->", lt + 4) + 3)
                elif page.startswith("<![CDATA[", lt):
                    end = min(n, self.find("]]>", lt + 9) + 3)
                else:
                    end = min(n, self.find(">", lt + 2) + 1)
            elif following == "/" and (name := NAME.match(page, lt + 2)):
                gt = self.find(">", name.end())
                if gt < n:
                    token, end = ("end", name[0].lower(), ""), gt + 1
            elif name := NAME.match(page, lt + 1):
                gt = self.tag_end(name.end())
                if gt >= 0:
                    token, end = ("start", name[0].lower(), page[name.end() : gt]), gt + 1
            if end < 0:  # a mere character
                at = lt + 1
                continue
            if lt > begun:
                yield "text", page[begun:lt], ""
            if token:
                yield token
                if token[0] == "start" and token[1] in RAW and not token[2].endswith("/"):
                    end = self.raw_end(token[1], end)
            at = begun = end
        if begun < n:
            yield "text", page[begun:], ""


@dataclass(slots=True)
class Open:
    """An open element: its path, what is around it, and where the nearest element of a block is on the stack."""

    tag: str
    path: int
    article: bool
    marks: int
    gone: bool
    block: int
    number: int


Block = tuple[int, str, int, bool, int, bool, str, int]


def blocks(page: str) -> tuple[list[Block], list[tuple[int, str]]]:
    """(path, text, characters in links, inside an article, chrome marks around, hidden, block tag, element) of every text block in page order.

    Paths of block tags are numbered: one number for each path from the root. So are the elements of block tags, which
    come as (element around it, tag); 0 is the page.
    """
    out: list[Block] = []
    elements: list[tuple[int, str]] = [(-1, "")]
    root = Open("", 0, False, 0, False, -1, 0)
    stack: list[Open] = []
    paths: dict[tuple[int, str], int] = {}
    at: dict[str, list[int]] = defaultdict(list)  # of each tag: its places on the stack
    held: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(held)).split())
        if text:
            top = stack[-1] if stack else root
            out.append((top.path, text, linked, top.article, top.marks, top.gone, stack[top.block].tag if top.block >= 0 else "", top.number))
        held.clear()
        linked = 0

    def close(i: int) -> None:
        """Closes the stack from element i on."""
        if stack[-1].block >= i:
            flush()
        while len(stack) > i:
            at[stack.pop().tag].pop()

    def last(tags: Iterable[str]) -> int:
        return max((at[t][-1] for t in tags if at[t]), default=-1)

    for kind, tag, attributes in Scanner(page).tokens():
        if kind == "text":
            held.append(tag)
            if at["a"]:
                linked += len(tag)
        elif kind == "end":
            if tag == "br":
                held.append(" ")
            i = last((tag,))
            if i >= 0 and not (tag in INLINE and i < stack[-1].block):
                close(i)
        elif tag in RAW and not attributes.endswith("/"):
            continue
        elif tag in VOID:
            held.append(" " if tag == "br" else "")
            if tag == "hr":
                flush()
        else:
            if tag in CLOSES_P and stack and at["p"] and at["p"][-1] == stack[-1].block:
                close(at["p"][-1])
            if tag in IMPLIED:
                gone, stop = IMPLIED[tag]
                i = last(gone)
                if i >= 0 and i > last(stop):
                    close(i)
            around = stack[-1] if stack else root
            inline = tag in INLINE
            if not inline:
                flush()
            path = around.path if inline else paths.setdefault((around.path, tag), len(paths) + 1)
            if not inline:
                elements.append((around.number, tag))
            at[tag].append(len(stack))
            gone = around.gone or hidden(tag, attributes, around.article)
            stack.append(Open(tag, path, around.article or tag in ARTICLE, around.marks + marked(tag, attributes), gone, around.block if inline else len(stack), around.number if inline else len(elements) - 1))
    flush()
    return out, elements


def scores(found: list[Block]) -> np.ndarray:
    """Fused, smoothed ratio of every block's path; paths under other marks are other paths."""
    total: dict[tuple, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0, 0.0])
    for path, text, linked, article, marks, *_ in found:
        s = total[path, article, marks]
        s[0] += len(text)
        s[1] += len(PUNCTUATION.findall(text))
        s[2] += min(linked, len(text))
        s[3] += 1
    sums = [total[b[0], b[3], b[4]] for b in found]
    text = np.array([s[0] / s[3] for s in sums])
    marks = np.array([s[1] / s[3] for s in sums])
    free = np.array([1 - s[2] / s[0] for s in sums])
    reach = math.ceil(3 * SIGMA)
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * SIGMA**2))

    def smooth(x: np.ndarray) -> np.ndarray:
        weight = np.convolve(np.ones_like(x), kernel, "full")[reach:-reach]
        return np.convolve(x, kernel, "full")[reach:-reach] / weight

    return smooth(text) * (1 + smooth(marks)) * free


def content(found: list[Block]) -> list[bool]:
    """Whether a block's path reaches the threshold, under its weights."""
    score = scores(found) * np.array([MARKED ** b[4] for b in found])
    limit = SHARE * math.sqrt(float(np.mean(score**2)))
    best: dict[tuple, float] = defaultdict(float)
    for b, s in zip(found, score):
        s *= (IN_ARTICLE if b[3] else 1) * (HEADING if b[6] in HEADINGS else 1)
        best[b[0], b[3], b[4]] = max(best[b[0], b[3], b[4]], s)
    return [0 < best[b[0], b[3], b[4]] >= limit and (b[3] or b[2] < 0.5 * len(b[1])) for b in found]


def article_blocks(found: list[Block], elements: list[tuple[int, str]], wanted: list[bool]) -> list[bool]:
    """Whether a block stands in the element that holds the content paths' text, outside chrome and lists of links.

    Where that is the page's body, between the first and the last block of content.
    """
    n = len(elements)
    text, links, held, times = (np.zeros(n, dtype=np.int64) for _ in range(4))
    marks = np.full(n, 1 << 30, dtype=np.int64)
    for b, w in zip(found, wanted):
        e = b[7]
        text[e] += len(b[1])
        links[e] += min(b[2], len(b[1]))
        times[e] += 1
        held[e] += len(b[1]) * w
        marks[e] = min(marks[e], b[4])
    for e in range(n - 1, 0, -1):  # an element comes after the one around it
        up = elements[e][0]
        for sums in (text, links, held, times):
            sums[up] += sums[e]
        marks[up] = min(marks[up], marks[e])
    most, home = held[0], 0
    for e in range(1, n):
        if elements[e][0] == home and held[e] >= HELD * most:
            home = e
    e = home
    while e > 0 and elements[e][1] not in ARTICLE:
        e = elements[e][0]
    home = e if e > 0 else home
    body = elements[home][1] in ("", "html", "body")
    inside, linked = [False] * n, [False] * n
    for e in range(n):
        up = elements[e][0]
        inside[e] = e == home or up >= 0 and inside[up]
        linked[e] = up >= 0 and linked[up] or inside[e] and e != home and (times[e] > 1 or elements[e][1] == "header") and links[e] >= LINKS * max(text[e], 1)
    first, last = wanted.index(True), len(wanted) - wanted[::-1].index(True)
    return [inside[b[7]] and not linked[b[7]] and b[4] <= marks[home] and (not body or first <= i < last) for i, b in enumerate(found)]


def main_text(page: str) -> str:
    """The article's blocks in page order, joined by one space; empty if there are none."""
    every, elements = blocks(page)
    found = [b for b in every if not b[5]]
    wanted = content(found) if found else []
    if not any(wanted):
        return ""
    whole = article_blocks(found, elements, wanted)
    return " ".join(b[1] for b, w, x in zip(found, wanted, whole) if w or x)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every input row: the main text of the whole page and its code points.

    Null and empty pages and pages without content give the empty text. Markup may be broken: tags that are not
    closed end where HTML implies it, an unfinished tag is text, and raw elements that never end hold the rest of
    the page. Repeated rows give repeated rows; an empty table an empty result; other columns are not read.
    """

    def make():
        def f(columns, texts):
            got = [main_text(t) for t in texts]
            return {"page_id": columns[0], "url": columns[1], "text": pa.array(got, pa.string()), "n_chars": pa.array(map(len, got), pa.int64())}

        return f

    kinds = dict(pages.dtypes)
    return map_text(pages.select(id_col, url_col, html_col), make, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long", 2)
