"""Main text of web pages: parser events, text-to-tag ratios per line, Gaussian smoothing and threshold clustering.

The standard library's HTML parser streams events. Block tags cut the page into lines, each with its text, the number
of tags in it, its characters inside links and its element. Elements that are never article text (navigation, footers,
sidebars, scripts, styles, hidden elements) are left out as they stream by. Forms, page headers and elements
whose class, id or role names an advert, notice, menu or reader comments are left out once the page is read, and only
if they are no layout around the article: one that holds most of the page's text, with no article or main element
beside it, or most of the text of the article it stands in, is left to the ratios. A name counts only if each of its
parts is such a word or a container's (``related-posts``, not ``related-work``); ``article``, ``main``, ``html`` and ``body`` are
not judged by names, headings, paragraphs and sections not by anchors such as ``id="alerts"``, and modifiers such as
``has-sidebar`` are no names. What holds most of a page's text is a layout only if that text reads like an article's: at
least two lines of it have ``PROSE`` characters or more outside links. A page of boilerplate only gives the empty text.

Each line's text-to-tag ratio is its characters over its tags. The ratios are smoothed by a Gaussian, and lines whose
smoothed ratio exceeds the threshold (a share of the standard deviation) form the content cluster. The content region
is the innermost element that holds nearly all of the cluster's text, raised to the article or main element around it
if there is one. If that is wider than an article or main element which holds most of the cluster, that element is
taken, unless another one holds a part too. Where the region is no article or main element, the lines beside it are looked at
too: those before it that are headings or as dense as its own lines, with what stands between them, are its title and
lead; up to ``CLOSING`` dense lines that follow it are its end, and more are a text of their own. Within the region, runs of at least two lines that lie outside articles,
consist of links and have a ratio below the threshold are menus without a name and go; every other line stays, short ones too,
since a low ratio alone does not tell a short paragraph from a menu.

Time and memory are linear in the page, however deep its elements nest: elements have parent pointers and numbers in
page order, so counts roll up in one sweep and the lines of an element are an interval.

Text that a page hides (``hidden``, ``display:none``) is left out as markup; ``aria-hidden`` text is seen and stays.

Defined cases: null and empty pages give an empty text; unclosed elements and pages cut off anywhere are read as far as
they go; very long and very deep pages are read whole; repeated rows stay; null ids and urls are passed on; an empty
table gives an empty table; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead "
    "tr ul".split()
)
#: Elements without article text.
DROP = frozenset(
    "head title script style noscript template nav footer aside button select textarea input iframe object svg canvas dialog "
    "menu audio video map".split()
)
#: The elements, end tags of which may be left out, that a start tag closes.
CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table div article section main body td th".split())
_BOILER = frozenset(
    "ad ads adslot adbox adbanner adunit adsense adwrap advert adverts advertisement advertisements advertising sponsor sponsored promo promos "
    "promotion promotions banner sidebar sidebars cookie cookies consent gdpr notice notices alert alerts announcement announcements popup modal "
    "overlay newsletter subscribe subscription signup share sharing social related recommended trending breadcrumb breadcrumbs menu menus nav "
    "navbar navigation pagination pager footer comment comments commentlist respond replies disqus toolbar skiplink widget widgets copyright".split()
)
#: Parts of a name that say where a thing is or how it is boxed.
_CONTAINER = frozenset(
    "site page main global top bottom left right upper lower primary secondary header head foot outer inner post posts article articles entry "
    "story stories link links list lists item items box boxes bar block blocks wrap wrapper container section area unit units slot module panel "
    "group row col column columns grid button buttons btn icon icons form message msg text title heading body bg image img desktop mobile sticky "
    "fixed floating small large sm md lg xl".split()
)
#: Class tokens that say what an element has or lacks, and not what it is.
_MODIFIER = re.compile(r"(?:^|[_-])(?:with|without|has|have|no|not|is|show|hide|enable|disable)(?:[_-]|$)|--")
#: Names that no layout has: such an element must hold nearly all text to be read.
_NO_LAYOUT = frozenset("ad ads advert adverts cookie cookies consent gdpr popup newsletter comment comments commentlist respond replies disqus".split())
_PAGE_HEADER = frozenset("header site-header page-header main-header global-header masthead topbar top-bar".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar alert dialog alertdialog".split())
#: Elements whose ids are anchors for links into the text.
_ANCHORED = frozenset("h1 h2 h3 h4 h5 h6 p section li dt dd figure table blockquote pre".split())
ARTICLE = frozenset(("article", "main"))
LAYOUT = 0.6  # share of the text
NEARLY = 0.9
LINKED = 0.9  # share of a line's characters
PROSE = 40  # characters outside links
DENSE = 0.5  # of the median ratio of the region's cluster
BYLINES = 3  # lines between a title and its article
CLOSING = 3
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MENU_LINES = 2


def boilerplate_share(name: str, anchor: bool = False) -> float:
    """The share of the text that makes a layout of an element with this class or id; 0 if the name says nothing."""
    parts = [p.rstrip("0123456789") for p in re.split(r"[_-]", name)]
    parts = [p for p in parts if p]
    words = [p for p in parts if p in _BOILER]
    if not words or _MODIFIER.search(name) or any(p not in _BOILER and p not in _CONTAINER for p in parts):
        return 0.0
    if any(p in _NO_LAYOUT for p in words):
        return NEARLY
    return 0.0 if anchor else LAYOUT


class Page(HTMLParser):
    """Collects lines. Block elements and doubtful ones are numbered in page order, each with its parent's number."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool, int]] = []  # tag, element (0: inline), left out, doubt
        self.at: dict[str, list[int]] = defaultdict(list)  # places of each tag in ``open``
        self.blocks: list[int] = []
        self.scopes: list[int] = []
        self.dropped = 0
        self.names, self.parents, self.articles = [""], [0], [0]  # of elements; the article or main that holds it
        self.doubts: list[tuple[int, int, float]] = [(0, 0, 0.0)]  # parent, article around, share that makes it a layout
        self.doubt = 0
        self.read: list[tuple[list[tuple[str, int, bool]], int, int]] = []  # parts, tags, element
        self.parts: list[tuple[str, int, bool]] = []  # text, innermost doubt, in a link
        self.tags = 0

    @property
    def element(self) -> int:
        return self.open[self.blocks[-1]][1] if self.blocks else 0

    def cut(self) -> None:
        if self.parts:
            self.read.append((self.parts, self.tags, self.element))
            self.parts = []
        self.tags = 0

    def rolled(self, own: list[float]) -> list[float]:
        """Sums over each element and all in it."""
        out = list(own)
        for i in range(len(out) - 1, 0, -1):
            out[self.parents[i]] += out[i]
        return out

    def last_inside(self) -> list[int]:
        """The highest number inside each element."""
        out = list(range(len(self.names)))
        for i in range(len(out) - 1, 0, -1):
            out[self.parents[i]] = max(out[self.parents[i]], out[i])
        return out

    def boilerplate(self) -> list[bool]:
        """For each doubtful element, whether it or one around it is no layout."""
        own, held, in_article = [0] * len(self.names), [0] * len(self.doubts), [0] * len(self.doubts)
        prose = [0] * len(self.doubts)
        total = in_articles = 0
        for parts, _, element in self.read:
            if len(" ".join("".join(t for t, _, linked in parts if not linked).split())) >= PROSE:
                prose[parts[0][1]] += 1
            for text, doubt, _ in parts:
                n = len("".join(text.split()))
                total += n
                own[element] += n
                held[doubt] += n
                if self.articles[element]:
                    in_articles += n
                    in_article[doubt] += n
        chars = self.rolled(own)
        for i in range(len(held) - 1, 0, -1):
            held[self.doubts[i][0]] += held[i]
            in_article[self.doubts[i][0]] += in_article[i]
            prose[self.doubts[i][0]] += prose[i]
        out = [False] * len(self.doubts)
        for i in range(1, len(out)):
            around, article, share = self.doubts[i]
            beside = not article and in_articles - in_article[i] > (0.1 * total if share < NEARLY else 0)
            out[i] = out[around] or beside or prose[i] < 2 or held[i] < share * (chars[article] if article else total)
        return out

    def lines(self) -> list[tuple[str, int, int, float]]:
        """(text, tags, element, share in links) of the lines with text, without the doubtful elements that are no layout."""
        out, lines = self.boilerplate(), []
        for parts, tags, element in self.read:
            kept = [(t, linked) for t, doubt, linked in parts if not out[doubt]]
            text = " ".join("".join(t for t, _ in kept).split())
            if text:
                linked = sum(len("".join(t.split())) for t, linked in kept if linked)
                lines.append((text, tags, element, linked / len(text.replace(" ", ""))))
        return lines

    def pop(self, to: int) -> None:
        while len(self.open) > to:
            tag, element, out, doubt = self.open.pop()
            self.at[tag].pop()
            if element:
                self.blocks.pop()
            if tag in SCOPE:
                self.scopes.pop()
            self.dropped -= out
            if doubt:
                self.doubt = self.doubts[doubt][0]

    def unwanted(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in DROP:
            return True
        return any(k == "hidden" or (k == "style" and v and "display:none" in v.replace(" ", "").lower()) for k, v in attrs)

    def doubtful(self, tag: str, attrs: list[tuple[str, str | None]]) -> float:
        """The share of the text that makes a layout of an element that looks like boilerplate; 0 if it doesn't."""
        inside = bool(self.articles[self.element])
        share = LAYOUT if tag == "form" or (tag == "header" and not inside) else 0.0
        for k, v in attrs:
            if k in ("class", "id") and v and tag not in ("html", "body") and tag not in ARTICLE:
                for name in v.lower().split():
                    if not inside and name in _PAGE_HEADER:
                        share = max(share, LAYOUT)
                    else:
                        share = max(share, boilerplate_share(name, k == "id" and tag in _ANCHORED))
            elif k == "role" and v and v.lower() in _ROLES:
                share = max(share, LAYOUT)
        return share

    def handle_starttag(self, tag, attrs):
        block = tag in BLOCK
        if block:
            self.cut()
            closed = CLOSES.get(tag, ()) if tag not in BLOCK else (*CLOSES.get(tag, ()), "p")
            place = max((self.at[t][-1] for t in closed if self.at[t]), default=-1)
            if place >= 0 and place >= (self.scopes[-1] if self.scopes else 0):
                self.pop(place)
        self.tags += 1
        if tag in VOID:
            if tag == "br" and not self.dropped:
                self.parts.append((" ", self.doubt, False))
            return
        out = self.unwanted(tag, attrs)
        share = 0.0 if out or self.dropped else self.doubtful(tag, attrs)
        doubt = number = 0
        if share:
            doubt = len(self.doubts)
            self.doubts.append((self.doubt, self.articles[self.element], share))
            self.doubt = doubt
        if block:
            number, around = len(self.names), self.element
            self.names.append(tag)
            self.parents.append(around)
            self.articles.append(number if tag in ARTICLE else self.articles[around])
            self.blocks.append(len(self.open))
        if tag in SCOPE:
            self.scopes.append(len(self.open))
        self.at[tag].append(len(self.open))
        self.open.append((tag, number, out, doubt))
        self.dropped += out

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.cut()
        self.tags += 1
        place = self.at[tag][-1] if self.at[tag] else -1
        if place >= 0 and (tag in BLOCK or place > (self.blocks[-1] if self.blocks else -1)):  # a stray inline end tag closes no block
            self.pop(place)

    def handle_data(self, data):
        if not self.dropped:
            self.parts.append((data, self.doubt, bool(self.at["a"])))


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def unnamed_menus(lines: list[tuple[str, int, int, float]], low: np.ndarray, in_article: list[int]) -> list[bool]:
    """For each line, whether it is in a run of lines that are links, have a low ratio and stand outside articles."""
    menu = [bool(low[k]) and linked >= LINKED and not in_article[e] for k, (_, _, e, linked) in enumerate(lines)]
    start = 0
    for k in range(len(menu) + 1):
        if k == len(menu) or not menu[k]:
            if k - start < MENU_LINES:
                menu[start:k] = [False] * (k - start)
            start = k + 1
    return menu


def take_beside(inside: list[bool], lines: list[tuple[str, int, int, float]], ratios: np.ndarray, content: np.ndarray, page: Page) -> None:
    """Add the lines of a title and lead before the region, and of an end after it, to those that are ``inside``."""
    at = [k for k, here in enumerate(inside) if here]
    if not at:
        return
    own = [ratios[k] for k in at if content[k]]
    dense = ratios >= DENSE * np.median(own if own else ratios)
    linked = [share >= LINKED for *_, share in lines]
    k = first = at[0]
    while k > 0 and first - k < BYLINES + 1:
        k -= 1
        if linked[k]:
            break
        if dense[k] or page.names[lines[k][2]] in HEADINGS:
            inside[k:first] = [True] * (first - k)
            first = k
    end = at[-1] + 1
    while end < len(lines) and dense[end] and not linked[end]:
        end += 1
    if end - at[-1] - 1 <= CLOSING:
        inside[at[-1] + 1 : end] = [True] * (end - at[-1] - 1)


def main_text(html: str | None, sigma: float = 1.0, share: float = 0.5, most: float = 0.6, nearly: float = NEARLY) -> str:
    """Main text of one page: its blocks in page order, joined by newlines."""
    if not html:
        return ""
    page = Page()
    page.feed(html)
    page.close()
    page.cut()
    lines = page.lines()
    if not lines:
        return ""
    ratios = np.array([len(t) / max(1, n) for t, n, _, _ in lines])
    smooth, threshold = smoothed(ratios, sigma), share * ratios.std()
    content = smooth >= min(threshold, smooth.max())
    own = [0] * len(page.names)
    for (text, _, element, _), good in zip(lines, content):
        own[element] += len(text) * bool(good)
    chars, last = page.rolled(own), page.last_inside()
    total = chars[0]

    def innermost(least: float) -> int:
        """Innermost element with that share of the cluster, 0 for none."""
        return max((i for i in range(1, len(chars)) if chars[i] >= least * total), default=0)  # all lie on one path

    def outer(element: int, names) -> int:
        """The innermost of ``names`` that holds the element or is it, 0 for none."""
        while element and page.names[element] not in names:
            element = page.parents[element]
        return element

    region, other = innermost(nearly), 0
    article = outer(region, ARTICLE)
    if not article:
        article = outer(innermost(most), ARTICLE)
        if article:
            other = sum(len(t) for (t, _, e, _), good in zip(lines, content) if good and page.articles[e] and not article <= e <= last[article])
    if article and other <= (1 - nearly) * total:
        region = article
    else:  # one paragraph is no region
        region = outer(region, ("body", "html", "div", "section", "td"))
    menu = unnamed_menus(lines, ratios < threshold, page.articles)
    inside = [not region or region <= e <= last[region] for _, _, e, _ in lines]
    if region and page.names[region] not in ARTICLE:
        take_beside(inside, lines, ratios, content, page)
    kept = [(t, m) for (t, *_), m, here in zip(lines, menu, inside) if here]
    return "\n".join(t for t, m in kept if not m) or "\n".join(t for t, _ in kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for each row of ``pages``."""

    def run(batches):
        for b in batches:
            texts = pa.array([main_text(h) for h in b.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), texts], ["page_id", "url", "text"])

    kinds = {k: pages.schema[k].dataType.simpleString() for k in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
