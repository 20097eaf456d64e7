"""Main text of web pages from parser events and text-to-tag ratios.

The parser's events make lines (blocks of text between block-level tags), each with its characters and its tags. The ratios of
the lines are smoothed with a Gaussian kernel and split by a threshold into content and the rest. The content lines
name the region: the articles that hold nearly all of their text, or else the innermost container that holds all of it. Within it every
line is kept but those of menus, forms, notices, adverts, comments and the like, which the tags and their names mark. A name
never drops the page, an article or an element with most of the content.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyloom.llm.common import add_columns, texts_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: their text is never shown, or never part of the article
DROPPED = frozenset(
    "head title script style noscript template svg math iframe object canvas audio video map nav footer aside form button select option "
    "textarea input label fieldset dialog menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr "
    "html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: an open element of these ends where one of the second set begins
CLOSED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: elements that can be the region: those that name the article, else any container
ARTICLES, CONTAINERS = frozenset(("article", "main")), frozenset("article body center div html main section table tbody td".split())
#: never dropped for their names
KEPT = frozenset("html body article main".split())
#: words that mark, in class, id or role, what does not belong to the article: a class marks if it has no other words
MARKED = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner masthead nav navbar navigation menu menubar breadcrumb "
    "breadcrumbs sidebar aside complementary footer contentinfo header topbar toolbar cookie cookies consent gdpr notice notices popup modal overlay dialog alert "
    "newsletter subscribe subscription signup login search share sharing social related recommended widget pagination pager comment comments commentlist "
    "respond reply replies disqus discussion hidden".split())
#: words of a name that mark it beside words of place or shape, these words, and first words that tell a state
STRONG = frozenset("comment comments sidebar footer ad ads advert adverts advertisement cookie cookies newsletter share sharing social related nav navbar navigation menu breadcrumb breadcrumbs".split())
STRUCTURAL = frozenset(
    "area list box wrap wrapper container holder bar left right top bottom main primary secondary site page post posts widget widgets section inner outer block panel "
    "button buttons icons links item items row col column group thread form title wp js".split())
STATES = frozenset("has with no not without is are".split())
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
BLANKS = re.compile(r"\s+")


@dataclass(frozen=True)
class Settings:
    """sigma: width of the kernel in lines; share: part of the deviation that a content line's ratio exceeds; held: part of the content's text that articles hold to be the region."""

    sigma: float = 1.0
    share: float = 0.5
    held: float = 0.9


class Lines(HTMLParser):
    """Streams events into lines: text, tags, and the elements that were open (by their number, outermost first)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []  # tag, number, whether its text is dropped whatever it holds
        self.named: set[int] = set()  # elements that their names mark
        self.numbers = 0
        self.tag_of = {0: "html"}
        self.lines: list[tuple[str, int, tuple[int, ...], bool]] = []
        self.text: list[str] = []
        self.tags = 0
        self.path: tuple[int, ...] = ()
        self.dropped = False

    def flush(self) -> None:
        text = BLANKS.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append((text, self.tags, self.path, self.dropped))
            self.tags = 0
        self.text.clear()

    def moved(self) -> None:
        self.path = tuple(number for _, number, _ in self.open)
        self.dropped = bool(self.open) and self.open[-1][2]

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        block = tag in BLOCKS
        drops = tag in DROPPED or any(hides(k, v) for k, v in attrs)
        in_article = any(name in ARTICLES for name, _, _ in self.open)
        named = tag not in KEPT and any(marks(k, v, in_article) for k, v in attrs)
        if block or drops or named:
            self.flush()
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        if block:
            for at in range(len(self.open) - 1, -1, -1):
                name = self.open[at][0]
                if tag in CLOSED_BY.get(name, ()):
                    del self.open[at:]
                    break
                if name in BLOCKS:
                    break
        outer = bool(self.open) and self.open[-1][2]
        if tag == "header" and not any(name in ("article", "main") for name, _, _ in self.open):
            drops = True
        self.numbers += 1
        if tag in CONTAINERS:
            self.tag_of[self.numbers] = tag
        if named:
            self.named.add(self.numbers)
        self.open.append((tag, self.numbers, outer or drops))
        self.moved()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                if any(name in BLOCKS or drop or number in self.named for name, number, drop in self.open[at:]):
                    self.flush()
                del self.open[at:]
                self.moved()
                return
        if tag in BLOCKS:
            self.flush()

    def handle_data(self, data):
        self.text.append(data)

    def parse_marked_section(self, i, report=1):
        """``<![...>`` in a page is a comment that ends at the next ``>``, however it is written."""
        return self.rawdata.find(">", i) + 1 or -1

    def close(self):
        super().close()
        self.flush()


def marks(name: str, value: str | None, in_article: bool = False) -> bool:
    """Whether a class (id, role) names something beside the article.

    Its words are all marked (``cookie-notice``), or a strong one stands first or last and the others only say where or what sort
    of box it is (``comments-area``, ``site-footer``). A state of the page (``has-sidebar``) marks nothing, nor does a header within an article.
    """
    if name not in ("class", "id", "role"):
        return False
    for token in (value or "").split():
        words = [w.lower() for w in NAME_WORDS.findall(token)]
        if not words or words[0] in STATES or in_article and {"header", "banner", "masthead"}.intersection(words):
            continue
        others = {w for w in words if w not in MARKED}
        if not others or others <= STRUCTURAL and (words[0] in STRONG or words[-1] in STRONG):
            return True
    return False


def hides(name: str, value: str | None) -> bool:
    if name == "style":
        return bool(HIDDEN_STYLE.search(value or ""))
    return name == "hidden" or name == "aria-hidden" and value == "true"


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel is normalised over what there is."""
    reach = max(1, math.ceil(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights = np.convolve(np.ones(len(ratios)), kernel)[reach:-reach]
    return np.convolve(ratios, kernel)[reach:-reach] / weights


def content_of(lines: list[tuple], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Characters of each line, and whether its smoothed ratio makes it content."""
    sizes = np.array([len(x[0]) for x in lines], float)
    ratios = smoothed(sizes / np.maximum(1, [x[1] for x in lines]), settings.sigma)
    content = ratios >= settings.share * ratios.std()
    if not content.any():
        content[:] = True
    return sizes, content


def unmarked(lines: list[tuple], parser: Lines, settings: Settings) -> list[tuple]:
    """The lines outside the elements that their names drop: not those with most of the content, unless an article is elsewhere."""
    if not parser.named or not lines:
        return lines
    sizes, content = content_of(lines, settings)
    total, held = (sizes * content).sum(), dict.fromkeys(parser.named, 0.0)
    free = False  # whether an article that no name marks has content
    for (_, _, path, _), size in zip(lines, sizes * content, strict=True):
        inside = parser.named.intersection(path)
        for e in inside:
            held[e] += size
        free |= bool(size) and not inside and any(parser.tag_of.get(e) in ARTICLES for e in path)
    dropped = {e for e, n in held.items() if 2 * n <= total or free}
    return [x for x in lines if dropped.isdisjoint(x[2])]


def main_text(html: str, settings: Settings = Settings()) -> str:  # noqa: B008
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines = unmarked([x for x in parser.lines if not x[3]], parser, settings)
    if not lines:
        return ""
    sizes, content = content_of(lines, settings)
    texts: dict[int, float] = {0: 0.0}  # characters of content in each container; 0 is the page
    depth = {0: 0}
    in_articles = 0.0
    outermost: set[int] = set()
    for (_, _, path, _), size, own in zip(lines, sizes, content, strict=True):
        if own:
            if article := next((e for e in path if parser.tag_of.get(e) in ARTICLES), 0):
                outermost.add(article)
                in_articles += size
            for level, element in enumerate((0, *path)):
                if element in parser.tag_of:
                    texts[element] = texts.get(element, 0.0) + size
                    depth[element] = level
    by_article = outermost and in_articles >= settings.held * texts[0]
    most = in_articles if by_article else texts[0]
    holding = [e for e, n in texts.items() if n == most and not (by_article and parser.tag_of[e] not in ARTICLES)]
    regions = {max(holding, key=depth.__getitem__)} if holding else outermost
    return " ".join(text for text, _, path, _ in lines if 0 in regions or not regions.isdisjoint(path))


def extract(pages: DataFrame, html: str = "html", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """``pages`` with ``text``, the main text ('' if none), and ``n_chars``, its code points.

    Character references are decoded, white space inside a block is one blank, blocks are joined in page order by one blank;
    nothing is cut at any length. A null page has no text; nulls elsewhere, repeated rows and other columns pass through; an
    empty table gives an empty table; columns named like the new ones are replaced.
    """

    def run(batch: pa.RecordBatch) -> list[list]:
        texts = [main_text(t, settings) for t in texts_of(batch, html)]
        return [texts, [len(t) for t in texts]]

    return add_columns(pages, "text string, n_chars long", run)
