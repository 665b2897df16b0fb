"""Main text of web pages from streaming parser events, by text-to-tag ratios.

The standard library's parser reads a page once. Its events give lines, one for each block element,
with the characters and tags of each. Ratios of characters to tags are smoothed by a Gaussian and
split in two clusters; the lines of the upper cluster mark the content, and the innermost element
that holds all of it is the article, or the outermost `article` or `main` around it; without those, one
around it that has headings beside it. Every line of that element is kept, so short paragraphs and
headings stay. Footers, sidebars, scripts and styles that are elements of their own, or name such a
role, never count. Forms, menus and class words only cast doubt on a block: its lines are read all
the same, and it stays doubtful unless it holds most of the page's running text and something speaks for
it (see `cleared`). Class words of inline elements say nothing. Where the content has no element of its own, lines that are links before the first
and after the last marked one go too.

Defined results: null or empty pages and pages without text give an empty string; unclosed and
stray tags are repaired as browsers do for paragraphs and list items; other markup errors only cost
structure, never text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm import kernels as K

#: Fixed values of HTML: elements that begin a line, that have no end tag, and that aren't page text.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title iframe object svg canvas audio video map select textarea button datalist aside footer dialog menu".split())
#: Silent as a rule, but some pages lie in one as a whole, by design or for want of an end tag: doubtful, like class words.
MEASURED = frozenset(("form", "nav"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_PARAGRAPH = BLOCKS - {"body", "html", "caption", "tbody", "tfoot", "thead", "tr"}
CELLS = frozenset("td th br".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar status".split())
#: Class and id words of what isn't the article.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert warning popup modal overlay "
    "newsletter subscribe subscription signup login sidebar sidebars rail widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar "
    "share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond pagination pager copyright legal disclaimer search hidden skip".split()
)
#: Those of the words above that name no layout: what they say of an element rarely has another reason.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored banner cookie cookies consent gdpr notice notices alert warning popup modal overlay newsletter "
    "subscribe subscription signup login footer comment comments commentlist disqus reply replies respond copyright legal disclaimer hidden".split()
)
#: Class words that name the article itself and outweigh the ones above.
OWN = frozenset("article content entry main post story".split())
SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Elements that can be the article.
HOMES = frozenset(("article", "main", "section", "div", "td", "body", "html", ""))
SIGMA, LINKED = 1.0, 0.8
FEED = 1 << 16


class Lines(HTMLParser):
    """Lines of a page: text, tags, characters in links, the element each lies in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.name = [-1], [""]
        self.open: list[tuple[str, int, bool, bool]] = []  # name, element, whether it silences its text, whether it names an article
        self.count: dict[str, int] = {}
        self.silent = self.links = self.articles = 0
        self.doubt: dict[int, tuple[bool, bool]] = {}  # doubtful elements: by a strong word, and whether the words leave another reading
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.text: list[str] = []
        self.ratio: list[float] = []
        self.link_share: list[float] = []
        self.element: list[int] = []

    def at(self) -> int:
        return self.open[-1][1] if self.open else 0

    def within(self, element: int) -> Iterator[int]:
        """The element and all around it, inside out."""
        while element >= 0:
            yield element
            element = self.parent[element]

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.text.append(text)
            self.ratio.append(len(text) / (self.tags + 1))
            self.link_share.append(self.linked / len(text))
            self.element.append(self.at())
            self.tags = 0
        self.parts, self.linked = [], 0

    def judged(self, tag: str, attrs: dict[str, str | None]) -> tuple[bool, bool, tuple[bool, bool] | None]:
        """Whether the element silences its text, whether it names an article, and its doubt if any."""
        tokens = [{w.lower() for w in SPLIT.split(t) if w} for t in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split()]
        words = set().union(*tokens)
        own = tag in ("article", "main") or bool(words & OWN - {"main"} and not words & WORDS)
        if tag in SILENT or "hidden" in attrs or attrs.get("aria-hidden") == "true" or (attrs.get("role") or "").lower() in ROLES:
            return True, own, None
        if tag in ("html", "body", "main"):
            return False, own, None
        if (tag == "header" and not self.articles) or HIDING.search(attrs.get("style") or ""):
            return True, own, None
        if tag in MEASURED:
            return False, False, (False, tag == "form")
        if not words & WORDS or (words & OWN and tag in ("article", "section")) or tag not in BLOCKS | CELLS:
            return False, own, None
        strong = bool(words & STRONG)
        named = any(t & OWN and not t & WORDS for t in tokens)
        mixed = bool(words & OWN) or not any(t <= WORDS for t in tokens)
        return False, False, (strong, named or (mixed and not strong))

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in CELLS:
            self.parts.append(" ")
        if tag in BLOCKS:
            self.end_line()
            if tag in ENDS_PARAGRAPH and self.count.get("p"):
                self.leave("p")
            if tag == "li" and self.count.get("li"):
                self.leave("li", "ul ol menu")
            if tag in ("dt", "dd"):
                for other in ("dt", "dd"):
                    if self.count.get(other):
                        self.leave(other, "dl")
        if tag in VOID:
            return
        silent, own, doubt = self.judged(tag, dict(attrs))
        self.parent.append(self.at())
        self.name.append(tag)
        if doubt:
            self.doubt[len(self.parent) - 1] = doubt
        self.open.append((tag, len(self.parent) - 1, silent, own))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.silent += silent
        self.links += tag == "a"
        self.articles += own

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in CELLS:
            self.parts.append(" ")
        if tag in BLOCKS:
            self.end_line()
        if self.count.get(tag):
            self.leave(tag)

    def leave(self, tag: str, within: str = "") -> None:
        """Close the innermost open `tag` and all inside it, unless an element of `within` comes first."""
        if within:
            stop = within.split()
            for name, *_ in reversed(self.open):
                if name == tag:
                    break
                if name in stop:
                    return
        while self.open:
            name, _, silent, own = self.open.pop()
            self.count[name] -= 1
            self.silent -= silent
            self.links -= name == "a"
            self.articles -= own
            if name == tag:
                return

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratio, kernel)[reach : reach + len(ratio)] / np.convolve(np.ones(len(ratio)), kernel)[reach : reach + len(ratio)]


def upper_cluster(x: np.ndarray) -> np.ndarray:
    """Whether each value lies in the upper of two clusters (two means on a logarithmic scale)."""
    x = np.log1p(x)
    lo, hi = x.min(), x.max()
    if hi - lo < 0.7:
        return np.ones(len(x), bool)
    for _ in range(50):
        up = x > (lo + hi) / 2
        new = x[~up].mean(), x[up].mean()
        if new == (lo, hi):
            break
        lo, hi = new
    return x > (lo + hi) / 2


def cleared(page: Lines) -> set[int]:
    """The doubtful elements that are content after all.

    Such an element holds more than half of the running text: of the articles of the page, or of the
    whole page where it has none. Beside that, class words allow another reading (the name of an article
    among them, or a layout word in a compound such as `has-sidebar`), or there is a first-rank heading in
    it, or an article where only layout words cast the doubt.
    """
    prose = [len(t) if share < LINKED else 0 for t, share in zip(page.text, page.link_share, strict=True)]
    chains = [list(page.within(e)) for e in page.element]
    strong = {e for e, (s, _) in page.doubt.items() if s}
    inside = [any(page.name[e] in ("article", "main") for e in c) and not any(e in strong for e in c) for c in chains]
    scope = inside if any(n for n, i in zip(prose, inside, strict=True) if i) else [True] * len(chains)
    held: dict[int, int] = {}
    kinds: dict[int, set[str]] = {}
    for n, chain, counts in zip(prose, chains, scope, strict=True):
        below: set[str] = set()
        for e in chain:
            below.add(page.name[e])
            if e in page.doubt:
                held[e] = held.get(e, 0) + n * counts
                kinds.setdefault(e, set()).update(below)
    total = sum(n for n, counts in zip(prose, scope, strict=True) if counts)
    out = set()
    for e, n in held.items():
        is_strong, readable = page.doubt[e]
        speaks = readable or "h1" in kinds[e] or (not is_strong and kinds[e] & {"article", "main"})
        if 2 * n > total and speaks:
            out.add(e)
    return out


def without_doubtful(page: Lines) -> None:
    """Take the lines of doubtful elements out of the page."""
    noise = page.doubt.keys() - cleared(page) if page.doubt else set()
    if not noise:
        return
    stay = [i for i, e in enumerate(page.element) if not any(x in noise for x in page.within(e))]
    for name in ("text", "ratio", "link_share", "element"):
        setattr(page, name, [getattr(page, name)[i] for i in stay])


def main_text(html: str | None) -> str:
    page = Lines()
    for at in range(0, len(html or ""), FEED):
        page.feed(html[at : at + FEED])
    page.close()
    page.end_line()
    without_doubtful(page)
    if not page.text:
        return ""
    ratio, linked = np.array(page.ratio), np.array(page.link_share)
    marked = upper_cluster(smoothed(ratio)) & (linked < LINKED)
    if not marked.any():
        marked = linked < LINKED
    if not marked.any():
        return ""
    size = np.array([len(t) for t in page.text])
    holds: dict[int, list[int]] = {}  # marked lines and headings in each element
    for i, e in enumerate(page.element):
        heading = any(page.name[x] in HEADINGS for x in page.within(e)) and linked[i] < LINKED
        for x in page.within(e):
            own = holds.setdefault(x, [0, 0])
            own[0] += bool(marked[i])
            own[1] += heading
    home = max(e for e, (n, _) in holds.items() if n == marked.sum())  # elements are numbered outside in
    around = list(page.within(home))
    named = [e for e in around if page.name[e] in ("article", "main")]
    for e in around:
        if e in named or page.name[home] not in HOMES or (not named and holds[e][1] > holds[home][1]):
            home = e
    keep = np.zeros(len(size), bool)
    for i, e in enumerate(page.element):
        while e > home:
            e = page.parent[e]
        keep[i] = e == home
    if page.name[home] in ("", "html", "body"):
        first, last = np.flatnonzero(marked)[[0, -1]]
        at = np.arange(len(size))
        keep &= ((at >= first) & (at <= last)) | (linked < LINKED)  # menus before and after
    lists: dict[int, list[int]] = {}
    for i in np.flatnonzero(keep).tolist():
        e = page.element[i]
        while e > home:
            if page.name[e] in ("ul", "ol"):
                lists.setdefault(e, []).append(i)
                break
            e = page.parent[e]
    first = int(np.flatnonzero(marked)[0])
    for own in lists.values():
        if len(own) >= 3 and (linked[own] * size[own]).sum() > LINKED * size[own].sum() and not (named and own[0] > first):
            keep[own] = False  # a menu; after the text of an article such a list is its references
    return "\n".join(t for t, k in zip(page.text, keep, strict=True) if k)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.chunks(batches, html):
            text = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], [key, url, "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select(key, url, html).mapInArrow(run, f"{key} {kinds[key]}, {url} {kinds[url]}, text string, n_chars bigint")
