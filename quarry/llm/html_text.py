"""HTML extraction: parser events into lines, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser streams events; each block element starts a line with its text and its number of tags. A line's
ratio of characters to tags is smoothed with a Gaussian over its neighbours; lines whose smoothed ratio reaches a share of
the page's standard deviation (or mean, if less) form the content cluster. The cluster selects the region: the innermost
article or main element that holds at least half of the cluster's text. Of that region every line stays, list items and
headings too; of the article or main elements around it, those in the cluster; elsewhere, those that reach eight times its
threshold. Without such a region the cluster itself is the text.

Left out before, whatever their ratio: navigation, footer, aside, script, style, form controls and the like, a header outside
a region, and blocks with a whole class or id name of clutter (adverts, menus, reader comments, ...). A name counts for
nothing where its block holds the main element or all lines. A form is left out unless it holds at least half of the text.

Defined results: null or empty html gives an empty text; repeated rows are answered singly; unclosed and stray tags are
tolerated, and a missing end of the head is implied; columns named text or n_chars are replaced; white space inside a block
is one space, blocks are joined by one space in page order; very long pages are parsed whole; a page of nothing but clutter
by name gives an empty text, unless one such block holds all of it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Element names (fixed values).
SKIPPED = frozenset("script style noscript template iframe svg object annotation annotation-xml nav footer aside button select option textarea label dialog menu head title".split())
BLOCKS = frozenset("p div article main section header h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th blockquote pre figure figcaption br hr address body html details summary center fieldset caption form".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IN_HEAD = frozenset("head title meta link style script base noscript template".split())
#: Whole class and id names of clutter: a word of this list, or two joined by a hyphen or an underscore (fixed values).
WORDS = "ads?|advert|advertisement|adslot|banner|promo|promotion|sponsor|sponsored|cookies?|consent|gdpr|newsletter|subscribe|popup|modal|overlay|sidebar|widget|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|masthead|share|sharing|social|related|recommended|comments?|repl(?:y|ies)|respond|disqus(?:[_-]thread)?|login|signup|search|copyright"
PARTS = "user|reader|visitor|guest|post|article|site|page|main|top|bottom|left|right|box|block|bar|list|section|container|wrapper|wrap|area|slot|unit|notice|form|posts|links|items?|icons|buttons|[0-9]+"
CLUTTER = re.compile(rf"(?i)(?:(?:{PARTS})[_-])?(?:{WORDS})(?:[_-](?:{WORDS}|{PARTS}))*")
SITE = re.compile(r"(?i)(?:(?:site|page|main|top|global)[_-])?(?:header|footer)")
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert".split())
REGIONS = frozenset(("article", "main"))


class Open(NamedTuple):
    """An open element, with the numbers of the clutter by name, the regions and the forms that it lies in or is."""

    tag: str = ""
    out: bool = False
    named: tuple[int, ...] = ()
    regions: tuple[int, ...] = ()
    forms: tuple[int, ...] = ()


class Line(NamedTuple):
    text: str
    tags: int
    named: tuple[int, ...]
    regions: tuple[int, ...]
    forms: tuple[int, ...]


class Lines(HTMLParser):
    """Collects a Line for each block of a page, but for the elements left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack: list[Open] = []
        self.around_main: set[int] = set()
        self.text: list[str] = []
        self.tags = self.number = 0

    def cut(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            at = self.stack[-1] if self.stack else Open()
            if not at.out:
                self.lines.append(Line(text, self.tags, at.named, at.regions, at.forms))
            self.tags = 0
        self.text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in IN_HEAD and any(x.tag == "head" for x in self.stack):
            self.handle_endtag("head")
        over = self.stack[-1] if self.stack else Open()
        bad, named = tag in SKIPPED or (tag == "header" and not over.regions), False
        form = tag == "form"
        own = {k: v or "" for k, v in attrs} if attrs else {}
        if own and tag not in ("html", "body", "main"):
            bad = bad or own.get("role") in ROLES or "hidden" in own or own.get("aria-hidden") == "true"
            form = form or own.get("role") == "form"
            names = [*own.get("class", "").split(), own.get("id", "")]
            named = any(CLUTTER.fullmatch(x) or (not over.regions and SITE.fullmatch(x)) for x in names)
        if tag in BLOCKS or bad or named:
            self.cut()
        self.tags += 1
        if tag in EMPTY:
            return
        if tag == "p" and over.tag == "p":
            self.stack.pop()
            over = self.stack[-1] if self.stack else Open()
        self.number += 1
        if tag == "main":
            self.around_main.update(over.named)
        add = lambda old, new: (*old, self.number) if new else old
        self.stack.append(Open(tag, over.out or bad, add(over.named, named), add(over.regions, tag in REGIONS), add(over.forms, form)))

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in SKIPPED:
            self.cut()
        self.tags += 1
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                outer = self.stack[i - 1] if i else Open()
                if any(x.out != outer.out or x.named != outer.named for x in self.stack[i:]):
                    self.cut()
                del self.stack[i:]
                return
            if self.stack[i].tag in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                return

    def handle_data(self, data: str) -> None:
        self.text.append(data)


def smoothed(x: np.ndarray, sigma: float) -> np.ndarray:
    r = int(3 * sigma)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, r, mode="edge"), k / k.sum(), "valid")


def _read(html: str) -> list[Line]:
    """The page's lines but for clutter by name and small forms."""
    p = Lines()
    p.feed(html)
    p.close()
    p.cut()
    if not p.lines:
        return []
    over_all = p.around_main.union(set.intersection(*(set(x.named) for x in p.lines)))
    lines = [x for x in p.lines if over_all.issuperset(x.named)]
    total = sum(len(x.text) for x in lines)
    held: Counter[int] = Counter()
    for x in lines:
        for f in x.forms:
            held[f] += len(x.text)
    return [x for x in lines if all(2 * held[f] >= total for f in x.forms)]


def main_text(html: str | None, sigma: float = 1.0, share: float = 0.25, outside: float = 8.0) -> str:
    lines = _read(html) if html else []
    if not lines:
        return ""
    size, tags = (np.array(x) for x in zip(*((len(x.text), x.tags) for x in lines), strict=True))
    ratio = smoothed(size / np.maximum(1, tags), sigma)
    # one giant line makes a deviation that no other reaches; on short pages, smoothing leaves next to none
    need = share * min(ratio.std(), ratio.mean())
    cluster = ratio >= need
    held: Counter[int] = Counter()
    for x, ok in zip(lines, cluster, strict=True):
        for r in x.regions:
            held[r] += ok * len(x.text)
    # regions are numbered from the outside in
    chosen = max((r for r, n in held.items() if 2 * n >= size[cluster].sum() > 0), default=None)
    if chosen is not None:
        path = next(x.regions[: x.regions.index(chosen)] for x in lines if chosen in x.regions)
        around = [bool(x.regions) and path[: len(x.regions)] == x.regions for x in lines]
        cluster = [chosen in x.regions or r >= need * (1 if near else outside) for x, r, near in zip(lines, ratio, around, strict=True)]
    return " ".join(x.text for x, ok in zip(lines, cluster, strict=True) if ok)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text and n_chars in place of the html."""
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(h) for h in b[html_col]]
            yield b[kept].assign(text=text, n_chars=[len(t) for t in text])

    schema = pages.select(*kept).withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema
    return pages.select(*kept, html_col).mapInPandas(run, schema)
