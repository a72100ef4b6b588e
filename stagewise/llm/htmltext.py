"""Main-text extraction from web pages by tag-path ratios.

A page is read as a sequence of text blocks, each with its path of tags from the root. Per path, text length and
punctuation are added up over all its blocks and divided by their number: the paragraphs of an article share a path
with long, punctuated text, while menus, captions and buttons stand on paths of short pieces. Both ratios are smoothed
along the page over neighbouring blocks, fused by their product, and the paths above a share of the page's spread are
its content. An article or main element only weighs in as a factor of the ratios inside it. Headings and short pieces
belong to the content by the elements around them, paths made of links do not.

Elements that never hold an article's own text (scripts, styles, forms, navigation, headers and footers of the page,
asides) and those whose class, id or role says so (adverts, notices, sidebars, comments ...) are left out beforehand.

NULL or empty html, or a page without content: empty text. Unclosed, misnested and unknown tags are read as browsers
do in simple cases. Repeated rows get equal answers. Other columns of the input are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from math import sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of HTML: elements without content, with raw text, that start a block, and that close one another.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select option canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - frozenset("body caption dd dt head html legend li summary tbody td tfoot th thead tr".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("ul ol menu dl table".split())

# Elements and name parts that mark what is not the article.
OUTSIDE = frozenset("nav header footer aside form button dialog menu head label fieldset".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# Names that mark an element wherever they begin or end a class or id ("post-comments"), and those that do so only
# as a whole name or beside words of layout ("site-header", but not "entry-header" or "legal-analysis").
STRONG_NAMES = frozenset(
    "ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies gdpr popup modal nav navbar navigation breadcrumb breadcrumbs sidebar "
    "comment comments commentlist disqus respond replies reply related recommended recommendations newsletter subscribe signup pagination pager".split()
)
OUTSIDE_NAMES = STRONG_NAMES | frozenset(
    "ad promo promotion banner consent notice notices overlay menu aside rail widget footer foot masthead header topbar toolbar "
    "discussion share sharing social subscription login search copyright disclaimer legal skip toc".split()
)
POSITIONS = frozenset(
    "site page main global top bottom left right upper lower sticky fixed primary secondary list box bar block area section wrapper wrap container inner outer row col column "
    "item items link links button buttons icon icons form panel body content text title head wide small large mobile desktop c js".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist reply replies respond related recommended ad advert promo sponsored".split())
LAYOUT = frozenset("has with without no is".split())  # "has-sidebar" says something about the page, not the element
ARTICLE = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/)?(?P<name>[A-Za-z][^\s/>]*)|(?P<text>[^<]+|<)", re.S)
TAG_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++)))?")
NAME_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
ARTICLE_WEIGHT = 2.0  # factor of ratios inside article and main elements
LINKED = 0.5  # share of a path's text in links from which it is a list of links
NEARLY_ALL = 0.9  # share of the content that the element with the article's headings and short pieces holds
SPACE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")


def _outside(name: str, attrs: str) -> bool:
    if name in OUTSIDE:
        return True
    if not attrs or name in ("html", "body"):
        return False
    for m in ATTRIBUTE.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and "display:none" in value.replace(" ", "").lower():
            return True
        if key == "role" and value.lower() in OUTSIDE_ROLES:
            return True
        if key in ("class", "id"):
            for token in value.split():
                parts = [p.lower() for p in NAME_PART.findall(token)]
                if not parts or parts[0] in LAYOUT:
                    continue
                if name in ARTICLE:
                    if {parts[0], parts[-1]} & COMMENT_NAMES:
                        return True
                elif {parts[0], parts[-1]} & STRONG_NAMES or OUTSIDE_NAMES.intersection(parts) and all(p in OUTSIDE_NAMES or p in POSITIONS for p in parts):
                    return True
    return False


class Block(NamedTuple):
    """A text block: number of its tag path, number of the element around its own (-1: none), its own tag, text, characters in links."""

    path: int
    around: int
    tag: str
    text: str
    linked: int


class Page:
    """Text blocks of a page outside the elements that are left out, in time linear in its length.

    Open block elements are one stack; inline ones are counted per block element, as they matter by being left out or
    a link only. Paths and elements are numbered and refer to their parents, so that no path is ever written out.
    """

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.path_of: dict[tuple[int, str], int] = {}  # (number of the path above, tag)
        self.element_above: list[int] = []  # by element, without html and body
        self.element_tag: list[str] = []
        self._parts: list[str] = []
        self._linked = self._dropped = self._links = 0
        self._open: Counter[str] = Counter()
        # (tag, left out, path, element, element above, inline elements open in it: tag -> left out or not)
        self._stack: list[tuple[str, bool, int, int, int, dict[str, list[bool]]]] = [("", False, -1, -1, -1, {})]
        self._scopes: list[Counter[str]] = [Counter()]  # open list and table items of each list around
        self._read(page)

    def _flush(self) -> None:
        if self._parts:
            text = SPACE.sub(" ", html.unescape("".join(self._parts))).strip()
            if text:
                tag, _, path, _, above, _ = self._stack[-1]
                self.blocks.append(Block(path, above, tag, text, self._linked))
            self._parts.clear()
            self._linked = 0

    def _pop(self) -> None:
        self._flush()
        tag, out, _, _, _, inline = self._stack.pop()
        self._dropped -= out + sum(sum(held) for held in inline.values())
        self._links -= len(inline.get("a", ()))
        self._open[tag] -= 1
        if tag in LISTS:
            self._scopes.pop()
        elif tag in SIBLINGS:
            self._scopes[-1][tag] -= 1

    def _push(self, tag: str, out: bool) -> None:
        self._flush()
        _, _, path, element, above, _ = self._stack[-1]
        number = self.path_of.setdefault((path, tag), len(self.path_of))
        if tag in ("html", "body"):
            around, own = element, element
        else:
            around, own = element, len(self.element_above)
            self.element_above.append(element)
            self.element_tag.append(tag)
        self._stack.append((tag, out, number, own, around, {}))
        self._dropped += out
        self._open[tag] += 1
        if tag in LISTS:
            self._scopes.append(Counter())
        elif tag in SIBLINGS:
            self._scopes[-1][tag] += 1

    def _text(self, text: str) -> None:
        if not self._dropped:
            self._parts.append(text)
            if self._links:
                self._linked += len(text)

    def _end(self, name: str) -> None:
        if name in BLOCK:
            if self._open[name]:
                while self._stack[-1][0] != name:
                    self._pop()
                self._pop()
            elif name == "p":
                self._flush()
        elif name == "br":
            self._flush()
        else:  # an inline element ends, others inside it go on
            held = self._stack[-1][5].get(name)
            if held:
                self._dropped -= held.pop()
                self._links -= name == "a"

    def _start(self, name: str, attrs: str) -> None:
        if name == "br":
            if self._parts:
                self._parts.append(" ")
            return
        if name in VOID:
            if name == "hr":
                self._flush()
            return
        if name in ENDS_P and self._stack[-1][0] == "p":
            self._pop()
        if name in SIBLINGS and any(self._scopes[-1][n] for n in SIBLINGS[name]):
            while self._stack[-1][0] not in SIBLINGS[name]:
                self._pop()
            self._pop()
        out = bool(self._dropped) or _outside(name, attrs) and not (name == "header" and any(self._open[n] for n in ARTICLE))
        if name in BLOCK:
            if attrs.endswith("/"):
                self._flush()
            else:
                self._push(name, out)
        elif not attrs.endswith("/"):
            self._stack[-1][5].setdefault(name, []).append(out)
            self._dropped += out
            self._links += name == "a"

    def _read(self, page: str) -> None:
        at, lowered, never, quotes = 0, None, set(), True
        while m := MARKUP.match(page, at):
            at, name = m.end(), m["name"]
            if name is None:
                if text := m["text"] or m["cdata"]:
                    self._text(text)
                continue
            rest = TAG_REST.match(page, at) if quotes else None
            if rest:
                attrs, at = rest[1], rest.end()
            else:  # a quote that never ends, here or for all that follows: the tag goes to the next >
                quotes = False
                stop = page.find(">", at) if ">" not in never else -1
                if stop < 0:
                    never.add(">")
                    self._text(m[0])
                    continue
                attrs, at = page[at:stop], stop + 1
            name = name.lower()
            if m["close"]:
                self._end(name)
            elif name in RAW:
                if not attrs.rstrip().endswith("/"):
                    lowered = lowered if lowered is not None else page.lower()
                    end = lowered.find(f"</{name}", at) if name not in ("option", "select") and name not in never else -1
                    if end >= 0:
                        stop = page.find(">", end)
                        at = stop + 1 if stop >= 0 else len(page)
                    else:
                        never.add(name)
                        if name in ("script", "style", "textarea", "title", "noscript", "iframe"):
                            at = len(page)
            else:
                self._start(name, attrs)
        while len(self._stack) > 1:
            self._pop()
        self._flush()


def path_ratios(at: np.ndarray, length: np.ndarray, marks: np.ndarray, smooth: float = 1.0, weight: np.ndarray | float = 1.0) -> np.ndarray:
    """Fused ratio of each path: text length and punctuation per use of the path, each smoothed along the page.

    `at` is the path number of each block, `weight` a factor of each block's fused ratio.
    """
    uses = np.bincount(at)
    width = int(np.ceil(smooth))
    kernel = np.exp(-np.arange(-width, width + 1) ** 2 / (2 * smooth**2)) if len(at) > 2 * width else np.ones(1)
    near = np.convolve(np.ones(len(at)), kernel, "same")

    def smoothed(values: np.ndarray) -> np.ndarray:
        return np.convolve((np.bincount(at, values) / uses)[at], kernel, "same") / near

    return np.bincount(at, weight * np.sqrt(smoothed(length) * (1 + smoothed(marks)))) / uses


def _inside(above: list[int], marked: set[int]) -> list[bool]:
    """Of each element, whether it is marked or inside a marked one; elements are numbered after those around them."""
    out: list[bool] = []
    for i, parent in enumerate(above):
        out.append(i in marked or parent >= 0 and out[parent])
    return out


def main_text(page: str | None, smooth: float = 1.0, share: float = 0.5, article_weight: float = ARTICLE_WEIGHT) -> str:
    """Text of the content blocks, joined by blank lines.

    A path is content if its fused ratio reaches the mean of the page's paths less `share` of their spread, both
    weighted by text. `article_weight` is the factor of ratios inside article and main elements. Shorter pieces
    belong to the content if the element around a content block holds them too, or if the least element with nearly
    all content does and they are headings, lie between content blocks or that element is an article; lists of links
    do not. Headings right before the content are its headlines.
    """
    if not page:
        return ""
    read = Page(page)
    found = read.blocks
    if not found:
        return ""
    order: dict[int, int] = {}
    at = np.array([order.setdefault(f.path, len(order)) for f in found])
    if len(order) == 1:
        return "\n\n".join(f.text for f in found)
    above = read.element_above
    in_article = _inside(above, {i for i, tag in enumerate(read.element_tag) if tag in ARTICLE})
    weight = np.array([article_weight if f.tag in ARTICLE or f.around >= 0 and in_article[f.around] else 1.0 for f in found])
    length = np.array([len(f.text) for f in found], float)
    ratio = path_ratios(at, length, np.array([len(PUNCTUATION.findall(f.text)) for f in found], float), smooth, weight)
    held = np.bincount(at, length)
    mean = float(np.average(ratio, weights=held))
    spread = sqrt(float(np.average((ratio - mean) ** 2, weights=held)))
    linked = np.bincount(at, [min(f.linked, len(f.text)) for f in found]) >= LINKED * held
    headed = np.array([f.tag in HEADINGS for f in found])
    link_list = linked[at] & ~headed
    chosen = (ratio >= mean - share * spread - 1e-9)[at] & ~link_list
    if not chosen.any():
        return ""
    # Content characters in each element, added up from the inside out; the last element with nearly all is the least.
    content = np.zeros(len(above))
    for f, c in zip(found, chosen):
        if c and f.around >= 0:
            content[f.around] += len(f.text)
    for i in range(len(above) - 1, -1, -1):
        if above[i] >= 0:
            content[above[i]] += content[i]
    most = np.flatnonzero(content >= NEARLY_ALL * length[chosen].sum())
    root = int(most[-1]) if len(most) else -1
    in_holder = _inside(above, {f.around for f, c in zip(found, chosen) if c and f.around >= 0})
    in_root = _inside(above, {root})
    first, last = np.flatnonzero(chosen)[[0, -1]]
    for i, f in enumerate(found):
        if not chosen[i] and not link_list[i] and f.around >= 0:
            chosen[i] = in_holder[f.around] or in_root[f.around] and (headed[i] or first < i < last or in_article[root])
    first = int(np.flatnonzero(chosen)[0])
    while first > 0 and headed[first - 1]:  # a headline in an element of its own, right before the content
        first -= 1
        chosen[first] = True
    return "\n\n".join(f.text for f, c in zip(found, chosen) if c)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return pages.selectExpr("CAST(page_id AS BIGINT) AS page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
