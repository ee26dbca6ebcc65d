"""Main text of web pages: parser events to lines, text-to-tag ratios, Gaussian smoothing, threshold clustering."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section "
    "select summary table tbody td template textarea tfoot th thead title tr ul iframe object svg math video audio canvas".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that by HTML's own meaning hold no article text, wherever they stand.
_NEVER = frozenset(
    "head title script style noscript template nav aside footer form iframe object svg button select textarea dialog menu search option canvas "
    "audio video math".split()
)
#: Tags that a tag's start closes if it is the innermost open block.
_CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "body": {"head"},
} | {t: {"p"} for t in _BLOCKS - {"p", "li", "dt", "dd", "tr", "td", "th", "option", "body"}}
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id names that speak against a block. They don't decide: each line of such a block counts as many
#: tags more, which lowers its text-to-tag ratio.
_MARKS = frozenset(
    "ad ads advert advertisement advertising sponsor sponsored promo promotion cookie cookies consent notice popup overlay newsletter subscribe "
    "sidebar comment comments reply replies related recommended share social menu navbar navigation breadcrumb masthead header footer widget".split()
)
MARK_TAGS = 40
#: Blocks of running text, and lists and tables of it.
_RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr tbody thead tfoot caption figcaption summary".split())
_LISTS = frozenset("ul ol dl table figure".split())
_NAME = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_ROOTS = frozenset({"html", "body", "article", "main"})


class Line(NamedTuple):
    """A block's text, the tags and link characters in it, marks against it, and the number of the innermost block."""

    text: str
    tags: int
    linked: int
    marks: int
    block: int


class _Lines(HTMLParser):
    """Streams a page into lines and the tree of blocks that they stand in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool, int]] = []  # tag, number, never content, marks (its own and inherited)
        self.parents: dict[int, int] = {}
        self.names: dict[int, str] = {}
        self.numbers = 0
        self.data: list[str] = []
        self.tags = self.linked = self.links = 0
        self.lines: list[Line] = []
        self.mute = 0

    def _flush(self) -> None:
        if self.data:
            text = " ".join("".join(self.data).split())
            self.data = []
            if text and not (self.open and self.open[-1][2]):
                self.lines.append(Line(text, self.tags, self.linked, self.open[-1][3] if self.open else 0, self.open[-1][1] if self.open else 0))
                self.tags = 0
            self.linked = 0

    def _never(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in _NEVER:
            return True
        inside = any(t in ("article", "main") for t, *_ in self.open)
        if tag == "header":
            return not inside
        if tag == "article" and any(t == "article" for t, *_ in self.open):
            return True  # an article in an article is, by HTML's own meaning, a reader's comment on it
        if tag in _ROOTS:
            return False
        return any(
            (name == "role" and value in _ROLES) or name == "hidden" or (name == "aria-hidden" and value == "true")
            or (name == "style" and value is not None and re.search(r"display\s*:\s*none", value) is not None)
            for name, value in attrs
        )

    @staticmethod
    def _marked(tag: str, attrs: list[tuple[str, str | None]]) -> int:
        if tag in _ROOTS:
            return 0
        words = [w.lower() for name, value in attrs if name in ("class", "id") for w in _NAME.findall(_CAMEL.sub(" ", value or ""))]
        return int(any(w in _MARKS for w in words))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag not in _BLOCKS:
            if tag == "br":
                self.data.append(" ")
            elif tag in ("script", "style"):
                self.mute += 1
            elif tag == "a":
                self.links += 1
            elif attrs and tag not in _VOID and (self._never(tag, attrs) or self._marked(tag, attrs)):
                self._flush()
                self._push(tag, attrs)
            return
        self._flush()
        if tag in _VOID:
            return
        closes = _CLOSES.get(tag, ())
        while self.open and self.open[-1][0] in closes:
            self.open.pop()
        self._push(tag, attrs)

    def _push(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.numbers += 1
        _, parent, never, marks = self.open[-1] if self.open else ("", 0, False, 0)
        self.parents[self.numbers], self.names[self.numbers] = parent, tag
        self.open.append((tag, self.numbers, never or self._never(tag, attrs), marks + self._marked(tag, attrs)))

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in ("script", "style"):
            self.mute = max(0, self.mute - 1)
            return
        if tag == "a":
            self.links = max(0, self.links - 1)
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == tag), None)
        if tag in _BLOCKS or at is not None:
            self._flush()
        if at is not None:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        if not self.mute:
            self.data.append(data)
            if self.links:
                self.linked += len(data.strip())


def smoothed(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing with weights renormalised at both ends."""
    radius = int(np.ceil(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(values, kernel)[radius : radius + len(values)] / np.convolve(np.ones(len(values)), kernel)[radius : radius + len(values)]


def two_clusters(values: np.ndarray) -> float:
    """The threshold between low and high values: half way between the means of the two sides, to a fixed point."""
    threshold = values.mean()
    for _ in range(50):
        low, high = values[values < threshold], values[values >= threshold]
        if not len(low) or not len(high):
            break
        moved = (low.mean() + high.mean()) / 2
        if abs(moved - threshold) < 1e-9:
            break
        threshold = moved
    return threshold


def content_lines(lines: list[Line], sigma: float = 1.0) -> list[bool]:
    """Which lines are of the high cluster of smoothed text-to-tag ratios."""
    ratios = np.array([len(line.text) / max(1, line.tags + MARK_TAGS * line.marks) for line in lines])
    smooth = smoothed(ratios, sigma)
    # the mean of neighbours lifts no line that is marked, and a threshold between equal lines parts none
    return ((smooth >= two_clusters(smooth) - 1e-9) & (np.array([line.marks for line in lines]) == 0)).tolist()


def main_text(html: str | None, sigma: float = 1.0, share: float = 0.9) -> str:
    """The article's blocks, one a line.

    Lines of the high cluster of smoothed text-to-tag ratios select the regions of content: the article is the
    innermost element that holds ``share`` of their text, and of what stands in it each block that holds such a
    line, or, of links, mostly such lines. Paragraphs and headings beside them belong to the article, short ones too,
    and so do lists and tables without links; other link lists, boxes and marked blocks don't.
    """
    if not html:
        return ""
    page = _Lines()
    page.feed(html)
    page.close()
    page._flush()
    lines = page.lines
    if not lines:
        return ""

    def chain(number: int) -> list[int]:
        out = []
        while number:
            out.append(number)
            number = page.parents[number]
        return out[::-1]

    chains = {n: chain(n) for n in {line.block for line in lines}}
    high = content_lines(lines, sigma)
    if not any(high):
        high = [True] * len(lines)
    held: dict[int, int] = {}
    texts: dict[int, int] = {}
    links: dict[int, int] = {}
    tags: Counter[str] = Counter()
    for line, chosen in zip(lines, high, strict=True):
        for n in chains[line.block]:
            texts[n] = texts.get(n, 0) + len(line.text)
            links[n] = links.get(n, 0) + line.linked
            if chosen:
                held[n] = held.get(n, 0) + len(line.text)
        if chosen and line.block:
            tags[page.names[line.block]] += len(line.text)
    total = sum(len(line.text) for line, chosen in zip(lines, high, strict=True) if chosen)
    region = max((n for n, size in held.items() if size >= share * total), key=lambda n: len(chain(n)), default=0)
    around = chain(region)
    region = next((n for n in around if page.names[n] == "article"), next((n for n in around if page.names[n] == "main"), region))
    # where the page itself names one article in the region that holds most of its content, that is it
    named = [n for n, size in held.items() if page.names[n] == "article" and size > 0.5 * total and (not region or region in chain(n))]
    if len(named) == 1:
        region = named[0]
    # a single paragraph is no region of its own: what stands beside it belongs to it
    while region and page.names[region] in _RUNNING | _LISTS:
        region = page.parents[region]
    usual = tags.most_common(1)[0][0] if tags else ""

    def belongs(line: Line) -> bool:
        way = chains[line.block]
        if region:
            if region not in way:
                return False
            way = way[way.index(region) + 1 :]
        for n in way:
            name, linked = page.names[n], 2 * links[n] >= texts[n]
            # smoothing lifts a list's first and last line beside a paragraph: of links more than that must be high
            if name in ("html", "body") or 2 * held.get(n, 0) >= texts[n] or (held.get(n) and not linked):
                continue
            if line.marks or (name not in _RUNNING and name != usual and (name not in _LISTS or linked)):
                return False
        return True

    return "\n".join(line.text for line in lines if belongs(line))


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with text (the main text of the whole html) and n_chars, its code points.

    Null and empty html give an empty text, as pages without an article do. Character references are
    decoded, white space inside a block is one space. Every row stays, whatever its other columns
    hold; columns named text or n_chars are replaced. Nothing is shuffled.
    """

    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for htmls in tidy(batches):
            yield pd.Series([main_text(h) for h in htmls], dtype=object)

    return pages.withColumn("text", extract(F.col(html_col))).withColumn("n_chars", F.length("text").cast("long"))
