"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, two clusters."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, replace
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Standard deviation of the smoothing, in lines.
SIGMA = 1.0

# Elements by their role in HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike"
                    " strong sub sup time tt u var wbr br img".split())
_DROPPED = frozenset("nav header footer aside form script style noscript template iframe svg canvas button select option"
                     " textarea dialog head title object menu datalist audio video".split())
_SECTION = frozenset("body div section td th main article center".split())
_IMPLIED_END = frozenset("p li dt dd td th tr option".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_NAMES = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr"
                   " notice notices alert popup modal overlay sidebar menu menus nav navbar navigation breadcrumb breadcrumbs header"
                   " masthead footer comment comments disqus reply replies share sharing social newsletter subscribe signup related"
                   " recommended widget toolbar pagination pager skip hidden login search".split())
# Words that make a name tell what an element holds or is laid out with, not what it is.
_HOLDS = frozenset("with has have no without layout".split())
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass
class Line:
    """Text between two block borders."""

    text: str
    tags: int
    region: int
    kept: bool
    central: bool = False


def _boilerplate(tag: str, attributes: list[tuple[str, str | None]]) -> bool:
    if tag in _DROPPED:
        return True
    given = dict(attributes)
    if "hidden" in given or given.get("aria-hidden") == "true" or (given.get("role") or "").lower() in _ROLES:
        return True
    if re.search(r"display\s*:\s*none", given.get("style") or ""):
        return True
    names = f"{given.get('class') or ''} {given.get('id') or ''}"
    words = [{t.lower() for t in _TOKEN.findall(name)} for name in names.split()]
    return tag not in ("body", "html", "main") and any(w & _NAMES and not w & _HOLDS for w in words)


class Lines(HTMLParser):
    """Cuts a page into lines as its events come; keeps open elements that matter, no tree."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = 0
        self.dropped: list[str] = []  # the open boilerplate element, and those of its kind that are open in it
        self.inside: Counter[str] = Counter()  # elements open in it
        self.around: Counter[str] = Counter()  # elements open around it
        self.sections: list[tuple[str, int]] = [("", 0)]
        self.regions = 0

    def border(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.tags, self.sections[-1][1], not self.dropped,
                                   self.inside["article"] + self.inside["main"] > 0))
            self.tags = 0
        self.parts.clear()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag not in _INLINE
        if self.dropped:
            if len(self.dropped) == 1 and self.dropped[0] in _IMPLIED_END and tag == self.dropped[0]:
                self.border()
                self.resume()  # the next one of its kind ends it
            elif tag not in _VOID:
                if block:
                    self.border()
                self.inside[tag] += 1
                if tag == self.dropped[0]:
                    self.dropped.append(tag)
        if not self.dropped and tag not in _VOID and _boilerplate(tag, attrs):
            self.border()
            self.tags += 1
            self.dropped.append(tag)
            return
        if block:
            self.border()
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if not self.dropped and tag not in _VOID:
            self.around[tag] += 1
        if not self.dropped and tag in _SECTION:
            inside = self.sections[-1]
            if inside[0] in ("article", "main"):  # parts of an article are one region
                self.sections.append((inside[0], inside[1]))
            else:
                self.regions += 1
                self.sections.append((tag, self.regions))

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in _INLINE or self.dropped[:1] == [tag]:
            self.border()
        if self.dropped:
            if tag == self.dropped[0]:
                self.dropped.pop()
                if not self.dropped:
                    self.resume()
                    return
            if self.inside[tag] > 0:
                self.inside[tag] -= 1
                return
            if tag in _INLINE or not self.around[tag]:
                return
            self.resume()  # left open: its parent's end ends it
        self.around[tag] -= self.around[tag] > 0
        if tag in _SECTION and len(self.sections) > 1:
            self.sections.pop()

    def resume(self) -> None:
        self.dropped.clear()
        self.inside.clear()

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![...`` up to the next ``>`` is a comment, as in browsers, whatever word stands in it."""
        end = self.rawdata.find(">", i + 3)
        return -1 if end < 0 else end + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)  # browsers ignore the slash

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel)[reach:reach + len(values)]
    return np.convolve(values, kernel)[reach:reach + len(values)] / weight


def threshold(values: np.ndarray) -> float:
    """Between the means of two clusters (Lloyd's algorithm from the extremes)."""
    low, high = float(values.min()), float(values.max())
    while low < high:
        cut = (low + high) / 2
        new = float(values[values <= cut].mean()), float(values[values > cut].mean())
        if new == (low, high):
            return cut
        low, high = new
    return low - 1


def main_text(html: str | None) -> str:
    """The article's blocks, joined by an empty line.

    Lines that stand in a menu, header, footer, sidebar, form, notice, advert or comment only count for the smoothing.
    The others are judged by their smoothed ratio of text to tags; a region (an article, or else a section) with a line
    in the upper cluster is content, with all its lines, short ones too. If no region has one, the best line decides.
    Any markup is read, as browsers do: a struck element that is left open ends with its parent, and a page that stands in
    struck elements as a whole keeps the articles in them.
    """
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    parser.border()
    lines = parser.lines
    if not any(x.kept for x in lines):
        # the whole page stands in struck elements: what they hold as its article is kept
        lines = [replace(x, kept=x.central) for x in lines]
    if not any(x.kept for x in lines):
        return ""
    ratio = smoothed(np.log1p([len(x.text) / max(x.tags, 1) for x in lines]))
    cut = min(threshold(ratio), max(r for r, x in zip(ratio, lines) if x.kept) - 1e-9)
    regions = {x.region for r, x in zip(ratio, lines) if x.kept and r > cut}
    return "\n\n".join(x.text for x in lines if x.kept and x.region in regions)


def extract(html: Column) -> Column:
    """Main text of a page's html (null or empty: empty text). Pages are independent, so repeated rows repeat."""

    @F.pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(h) for h in pages], dtype=object)

    return of(html)
