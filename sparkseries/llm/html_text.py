"""Main text of web pages from text-to-tag ratios of lines.

Parser events become lines, one for each block. Subtrees that by element, role or style are not the
article take no part. The ratio of text length to tags of each line is smoothed by a Gaussian and split
into two clusters, lines of articles and mains with more weight. The content is the nearest container
of all lines of the upper cluster, or the article around it, with all of its lines; where that is the
page itself, what lies between the first and the last part that hold such a line. A subtree whose class
or id names comments, adverts, sidebars, notices and the like is left out, however long it is, unless it
holds an article, a main or a first heading, or there is nothing else; names that also occur inside articles
(related, social, notice and others) decide beside an article only, and inside one the subtree is smoothed by itself
and left out if it holds no line of the upper cluster.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

# Elements of HTML by their part in a page.
HIDDEN = set("script style noscript template svg math head title iframe object embed canvas audio video "
             "select option textarea button datalist".split())
ASIDE = set("nav footer aside form dialog menu search".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
REGIONS = set("article main section div td header".split())
ARTICLE_WEIGHT = 2.0
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# A new start tag of the left ends an open element of the right.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"},
}
# Names of what is never the article, wherever it lies and however long it is.
NEVER = set(
    "ad ads advert advertisement adverts sponsor sponsored promo promotion cookie cookies consent gdpr popup "
    "modal overlay newsletter subscribe subscription signup login share sharing comment comments disqus reply "
    "replies sidebar nav navbar navigation menu breadcrumb breadcrumbs pagination pager".split()
)
# Names of what is not the article beside it; inside one its lines decide.
BESIDE = set(
    "banner aside widget footer header masthead notice notices social related recommended toolbar skip hidden".split()
)
# Names of layout parts: one that holds another of its name lays a page out and is no such part.
LAYOUT = set("sidebar nav navbar menu banner header footer widget".split())
# Names of an article that is a reader's.
READERS = set("comment comments disqus reply replies".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar "
            "toolbar".split())
# A name with one of these tells of the layout around a part, not of the part.
MODIFIERS = set("has no not with without is fixed sticky overflow layout enabled".split())
SPLIT = re.compile(r"[^a-z0-9]+")


def _aside(tag: str, attrs: dict[str, str | None], in_article: bool) -> bool:
    if tag in HIDDEN or tag in ASIDE or tag == "header" and not in_article:
        return True
    if tag in ("html", "body", "article", "main") or tag in HEADINGS:
        return False
    if "hidden" in attrs or (attrs.get("role") or "").lower() in ROLES:
        return True
    if (attrs.get("aria-hidden") or "").lower() == "true":
        return True
    style = (attrs.get("style") or "").replace(" ", "").lower()
    if "display:none" in style or "visibility:hidden" in style:
        return True
    return False


def _names(tag: str, attrs: dict[str, str | None], in_article: bool) -> set[str]:
    """The words of class and id that tell of something beside the article."""
    if tag in ("html", "body", "main") or tag in HEADINGS:
        return set()
    words = set()
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        parts = set(SPLIT.split(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))
        if not parts & MODIFIERS:
            words |= parts
    if tag == "article":
        return words & READERS
    if in_article and tag == "header":
        words -= {"header", "masthead", "banner"}
    return words & (NEVER | BESIDE)


class Lines(HTMLParser):
    """Lines of a page: text, tags before and in it, the region and the named subtree that hold it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # Element, whether it takes no part, region, innermost named subtree (0: none).
        self.open: list[tuple[str, bool, int, int]] = []
        # How often each block is open, and each inline element in the innermost block and those around it.
        self.blocks: dict[str, int] = {}
        self.inline: list[dict[str, int]] = [{}]
        self.lines: list[tuple[str, int, int, int]] = []
        self.text: list[str] = []
        self.tags = 0
        self.article: set[int] = set()
        self.parent = [0]  # the region around each; 0 is the page
        self.heads: set[int] = set()  # lines of headings
        self.around = [0]  # the named subtree around each
        self.holds = [True]  # whether it holds an article, main or first heading
        self.names: list[set[str]] = [set()]
        self.never = [False]  # whether its names alone tell that it is not the article

    def _state(self) -> tuple[bool, int, int]:
        return self.open[-1][1:] if self.open else (False, 0, 0)

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            if any(entry[0] in HEADINGS for entry in self.open[-3:]):
                self.heads.add(len(self.lines))
            self.lines.append((text, self.tags, *self._state()[1:]))
            self.tags = 0
        self.text = []

    def _close(self, at: int) -> None:
        self.flush()
        self._drop(at)

    def _drop(self, at: int) -> None:
        while len(self.open) > at:
            tag = self.open.pop()[0]
            if tag in BLOCKS:
                self.blocks[tag] -= 1
                self.inline.pop()
            else:
                self.inline[-1][tag] -= 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS or tag in HIDDEN:
            self.flush()
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        if tag in CLOSES and self.open and self.open[-1][0] in CLOSES[tag]:
            self._close(len(self.open) - 1)
        if tag in BLOCKS:  # a block ends an open paragraph, with what is open in it
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == "p":
                    self._close(k)
                    break
                if self.open[k][0] in BLOCKS:
                    break
        aside, region, named = self._state()
        in_article = region in self.article
        aside = aside or _aside(tag, dict(attrs), in_article)
        names = set() if aside else _names(tag, dict(attrs), in_article)
        if names:
            at = named
            while at:  # a part of that name inside: what is around lays the page out
                self.holds[at] |= bool(names & self.names[at] & LAYOUT)
                at = self.around[at]
            self.around.append(named)
            self.holds.append(False)
            self.names.append(names)
            self.never.append(not in_article or bool(names & (NEVER | READERS)))
            named = len(self.holds) - 1
        if not aside and tag in REGIONS:
            self.parent.append(region)
            region = len(self.parent) - 1
            if in_article or tag in ("article", "main"):
                self.article.add(region)
        if not aside and (tag in ("main", "h1") or tag == "article" and not names):
            at = named
            while not self.holds[at]:
                self.holds[at] = True
                at = self.around[at]
        self.open.append((tag, aside, region, named))
        if tag in BLOCKS:
            self.blocks[tag] = self.blocks.get(tag, 0) + 1
            self.inline.append({})
        else:
            self.inline[-1][tag] = self.inline[-1].get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "span", "b", "i", "em", "strong"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS or tag in HIDDEN:
            self.flush()
        # An inline end does not leave its block; one that is not open ends nothing.
        if not (self.blocks if tag in BLOCKS else self.inline[-1]).get(tag):
            return
        at = len(self.open) - 1
        while self.open[at][0] != tag:
            at -= 1
        if tag in HIDDEN or tag in BLOCKS:
            self._close(at)
        else:
            self._drop(at)

    def handle_data(self, data: str) -> None:
        if not self._state()[0]:
            self.text.append(data)

    def done(self) -> None:
        self.close()
        self.flush()
        gone = [False] * len(self.holds)
        for n in range(1, len(gone)):
            gone[n] = gone[self.around[n]] or self.never[n] and not self.holds[n]
        stay = [i for i, line in enumerate(self.lines) if not gone[line[3]]]
        if stay:
            self.heads = {k for k, i in enumerate(stay) if i in self.heads}
            self.lines = [self.lines[i] for i in stay]
        # Subtrees that hold an article are like what is around them.
        own = list(range(len(self.holds)))
        for n in own[1:]:
            self.around[n] = own[self.around[n]]
            if self.holds[n]:
                own[n] = self.around[n]
        self.lines = [(text, tags, region, own[n]) for text, tags, region, n in self.lines]


def _smooth(ratio: np.ndarray, sigma: float) -> np.ndarray:
    reach = math.ceil(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratio, reach, mode="edge"), kernel / kernel.sum(), "valid")


def _upper(values: np.ndarray) -> np.ndarray:
    """The upper one of two clusters; all, if the values do not part."""
    low, high = values.min(), values.max()
    if high < 2 * low + 1:
        return np.ones(len(values), bool)
    for _ in range(20):
        cut = (low + high) / 2
        below, above = values[values <= cut], values[values > cut]
        if not len(below) or not len(above) or (below.mean(), above.mean()) == (low, high):
            break
        low, high = below.mean(), above.mean()
    return values > (low + high) / 2


def _content(
    parent: list[int], inside: np.ndarray, region: np.ndarray, upper: np.ndarray, heads: np.ndarray
) -> np.ndarray:
    """Which lines are content. Regions are numbered in the order of their starts."""
    last = list(range(len(parent)))  # the last region in each
    for r in range(len(parent) - 1, 0, -1):
        last[parent[r]] = max(last[parent[r]], last[r])
    chosen = region[upper]
    low, high = int(chosen.min()), int(chosen.max())
    common = low
    while last[common] < high:
        common = parent[common]
    while common and inside[parent[common]]:  # an article is not cut
        common = parent[common]
    if common:
        return (region >= common) & (region <= last[common])

    def part(line: int) -> np.ndarray:
        """The lines of the part of the page that holds ``line``; one that is in none is its own."""
        r = int(region[line])
        if not r:
            return np.array([line])
        while parent[r]:
            r = parent[r]
        return np.nonzero((region >= r) & (region <= last[r]))[0]

    lines = np.nonzero(upper)[0]
    first, end = part(lines[0])[0], part(lines[-1])[-1]
    while first and heads[first - 1]:  # headings of what follows
        first -= 1
    take = region == 0
    take[first:end + 1] = True
    if inside[chosen].any():
        take |= inside[region]
    return take


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The main text of a page: its blocks in order, one a line; empty if there is none."""
    page = Lines()
    page.feed(html or "")
    page.done()
    if not page.lines:
        return ""
    ratio = np.array([len(text) / max(tags, 1) for text, tags, *_ in page.lines])
    region, named = (np.array(x) for x in zip(*[line[2:] for line in page.lines]))
    inside = np.zeros(len(page.parent), bool)  # regions in an article or main
    inside[list(page.article)] = True
    ratio *= np.where(inside[region], ARTICLE_WEIGHT, 1)
    order = np.argsort(named, kind="stable")
    smooth = np.empty(len(ratio))
    for part in np.split(order, np.nonzero(np.diff(named[order]))[0] + 1):
        smooth[part] = _smooth(ratio[part], sigma)
    upper = _upper(smooth)
    live = np.zeros(len(page.around), bool)
    live[named[upper]] = live[0] = True
    for n in range(len(live) - 1, 0, -1):
        live[page.around[n]] |= live[n]
    kept = live[named]
    own = upper & (ratio >= smooth[upper].min())  # not lifted by their neighbours alone
    upper = own if own.any() else upper
    at = np.nonzero(kept)[0]
    take = _content(page.parent, inside, region[at], upper[at], np.isin(at, list(page.heads)))
    return "\n".join(page.lines[i][0] for i in at[take])


def extract(
    pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages``.

    The whole html is parsed; null counts as empty. A page without content has an empty text.
    Character references are decoded, white space inside a block becomes one space, and blocks are
    joined by a line feed. Repeated rows and null ids stay. An empty table gives an empty result;
    other columns are not looked at.
    """

    @F.pandas_udf("string")
    def text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([main_text(h) for h in part], dtype=object)

    return (
        pages.select(
            F.col(f"`{id}`").alias("page_id"), F.col(f"`{url}`").alias("url"),
            text(text_of(html)).alias("text"),
        )
        .select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
    )
