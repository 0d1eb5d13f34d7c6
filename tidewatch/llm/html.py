"""Main-text extraction from HTML by smoothed text-to-tag ratios.

The standard library's parser streams a page's events into lines: a line ends at
every block-level tag, and holds its text, its number of tags, and the content
region (the innermost article, main, section, division or body) it stands in.
Subtrees that are never content (menus, headers, footers, sidebars, forms,
scripts, adverts, notices, comments, by element, role, class or id words) give
no line.  Each line's ratio of text characters to tags is smoothed over its
neighbours with a Gaussian window, and lines are clustered by a threshold, the
ratios' standard deviation.  Ratios count up to 300, beyond which a line is
text in any case.  A region is content if most of its
text stands in lines above it; if a page has articles or main elements with
text, only regions within these compete.  All lines of content regions are kept.

Defined cases: null html is empty; a page without text, and an empty page, give
the empty text; a page whose regions all stay below gives the region of most
text; unclosed elements end with the page; repeated rows are extracted alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

ship(__name__)

# Element and attribute words of pages.
NEVER = {"head", "title", "style", "script", "noscript", "template", "nav", "header", "footer", "aside", "form", "button",
         "select", "textarea", "iframe", "svg", "canvas", "object", "dialog", "menu", "label", "fieldset"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
          "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
          "time", "tt", "u", "var", "wbr"}
REGIONS = {"article", "main", "section", "div", "body"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu",
         "menubar", "toolbar"}
WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment",
         "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav",
         "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promoted", "related",
         "replies", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar",
         "widget"}
#: Words that make a class name speak of the layout around the element ("has-sidebar").
LAYOUT = {"no", "not", "has", "with", "without", "wrapper", "layout", "container"}
#: A start of the key ends an open element of the value (end tags that pages leave out).
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}}
DENSE = 300
_SPLIT = re.compile(r"[^a-z]+")


def _boilerplate(tag: str, attrs: list) -> bool:
    if tag in NEVER:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    for name, value in attrs:
        value = value or ""
        if name in ("hidden",) or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.strip().lower() in ROLES:
            return True
        if name in ("class", "id"):
            for part in value.split():
                words = set(_SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", part).lower()))
                if WORDS & words and not LAYOUT & words:
                    return True
    return False


class Lines(HTMLParser):
    """Collects lines as [text parts, tags, region, within an article]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, bool]] = []  # tag, skipped, region, within
        self.names: Counter = Counter()  # of the open tags
        self.skipped, self.region, self.within, self.regions = 0, 0, False, 0
        self.lines: list[list] = [[[], 0, 0, False]]

    def _line(self):
        last = self.lines[-1]
        if last[0]:
            self.lines.append([[], 0, self.region, self.within])
        else:
            last[2], last[3] = self.region, self.within

    def handle_starttag(self, tag, attrs):
        for name in ENDS.get(tag, ()):
            if self.open and self.open[-1][0] == name:
                self._pop()
        if not self.skipped:
            self.lines[-1][1] += 1
            if tag == "br":
                self.lines[-1][0].append(" ")
            elif tag not in INLINE:
                self._line()
        if tag in VOID:
            return
        skip = _boilerplate(tag, attrs)
        self.open.append((tag, skip, self.region, self.within))
        self.names[tag] += 1
        if skip:
            if not self.skipped and tag in INLINE:
                self.lines[-1][0].append(" ")
            self.skipped += 1
        elif not self.skipped and tag in REGIONS:
            if tag in ("article", "main"):
                self.within = True
            if not (self.within and tag in ("div", "section")):  # parts of an article stay with it
                self.regions += 1
                self.region = self.regions
            self._line()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.skipped:
            self.lines[-1][1] += 1
        if not self.names[tag]:
            return
        while self._pop() != tag:
            pass

    def _pop(self) -> str:
        tag, skip, region, within = self.open.pop()
        self.names[tag] -= 1
        if skip:
            self.skipped -= 1
        self.region, self.within = region, within
        if not self.skipped and tag not in INLINE:
            self._line()
        return tag

    def handle_data(self, data):
        if not self.skipped:
            self.lines[-1][0].append(data)


_OPENS = re.compile(r"<[a-zA-Z/!?]")


def _closed(html: str) -> str:
    """The page without a tag that its end cuts off (nothing after the last ``>`` can be one)."""
    last = html.rfind(">") + 1
    cut = _OPENS.search(html, last)
    return html[:cut.start()] if cut else html


def extract_text(html: str, sigma: float = 1.0) -> str:
    import numpy as np

    parser = Lines()
    parser.feed(_closed(html))
    parser.close()
    lines = [(" ".join("".join(parts).split()), tags, region, within) for parts, tags, region, within in parser.lines]
    lines = [x for x in lines if x[0]]
    if not lines:
        return ""
    if any(x[3] for x in lines):
        lines = [x for x in lines if x[3]]
    if len({x[2] for x in lines}) > 1:
        ratio = np.minimum([len(t) / max(1, tags) for t, tags, *_ in lines], DENSE)
        reach = max(1, round(3 * sigma))
        window = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
        padded = np.pad(ratio, reach, mode="edge")
        smooth = np.convolve(padded, window / window.sum(), mode="valid")
        high = smooth >= ratio.std()
        size: dict[int, int] = {}
        above: dict[int, int] = {}
        for (t, _, region, _), h in zip(lines, high):
            size[region] = size.get(region, 0) + len(t)
            above[region] = above.get(region, 0) + (len(t) if h else 0)
        kept = {r for r in size if 2 * above[r] >= size[r]} or {max(size, key=size.get)}
        lines = [x for x in lines if x[2] in kept]
    return " ".join(x[0] for x in lines)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", sigma: float = 1.0) -> DataFrame:
    """Add the main text of every page; one pass over the scan, no shuffle."""

    @F.pandas_udf("string")
    def main_text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([extract_text(h, sigma) if h else "" for h in part], dtype=object)

    return pages.withColumn(text_col, main_text(F.col(html_col)))
