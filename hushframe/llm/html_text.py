"""Main text of web pages by text-to-tag ratio.

A streaming parser turns a page into lines, one per block of text, with the number of tags met since the line
before and the chain of containers around it.  Parts that markup names as something else (menus, page headers,
footers, sidebars, notices, adverts, forms, comments, scripts, styles) are left out.  The ratio of text to tags per
line is smoothed with a Gaussian; lines above the spread of the smoothed ratios are the content cluster, and the
container that holds most of its text (an article, the main part, or else the smallest one) is the content region.
All of that region's lines are returned, short ones too.  Articles next to it whose text lies in the cluster as well are
part of it, and so are the headline before them and the cluster's lines around them within their container.  Some names
of markup are a hint only (``HINTS``): such a block within the region stays if the cluster's ratios say that it is text.

Defined results: null counts as empty and gives an empty text; inline markup and ``<br>`` do not end a block; a page
whose every line is left out by markup falls back to its articles, then to its forms; unclosed and stray tags are read as
browsers do; an unfinished tag at the end of a page is text.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.catalog import query, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
CONTAINER = frozenset("article div main section table td".split())
DROPPED = frozenset("aside audio button canvas datalist dialog footer form head iframe menu nav noscript object script search select style svg template textarea title video".split())
#: Elements whose start ends an open one of the second set.
CLOSES = {
    **dict.fromkeys("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), ("p",)),
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",),
}
#: An open element is not looked for beyond these.
FENCE = {"p": frozenset("article aside body div footer form header main nav section td th".split()), "li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]),
         "tr": frozenset(["table"]), "td": frozenset(["tr", "table"]), "th": frozenset(["tr", "table"])}
OTHER = frozenset(
    "ad ads adbox adsense advert advertisement advertising adverts alert alerts banner breadcrumb breadcrumbs captcha comment comments commentlist consent cookie cookies copyright "
    "discussion disclaimer disqus footer gdpr hidden legal login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup "
    "promo promoted promotion recommended register related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar "
    "tracking widget widgets".split())
#: Of those, names that a block of text may carry as well.
HINTS = frozenset("alert alerts banner disclaimer legal overlay recommended register related respond search share sharing social tracking widget widgets".split())
HEADINGS = frozenset("h1 h2 h3".split())
HINTED = "hint"
PAGE_ONLY = frozenset(["header"])  # other than content outside an article, part of it inside
OWN = frozenset("article body content entry main post story text".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
SIGMA = 1.0


@dataclass
class Line:
    text: str
    tags: int
    chain: tuple[int, ...]  # numbers of the containers around it, outermost first
    article: int  # number of the outermost article around it, or 0
    main: bool
    dropped: str  # by what markup, or empty
    heading: bool = False
    hinted: int = 0  # number of the element that only a hint drops, or 0


def _named(tag: str, attrs: list[tuple[str, str | None]], article: bool) -> str:
    """Whether an element's names say that it is something else than content: not (empty), by a hint, or by its tag's name."""
    names, own = [], False
    for key, value in attrs:
        value = value or ""
        if key in ("class", "id"):
            names += value.split()
        elif key == "role" and value.strip().lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and HIDDEN.search(value.lower()):
            return tag
    if not names or tag in ("html", "body"):
        return ""
    found = ""
    for name in names:
        tokens = {t.lower() for t in TOKEN.findall(name)}
        if tokens & OTHER or not article and tokens & PAGE_ONLY:
            found = tag if (tokens & OTHER) - HINTS or not tokens & OTHER else found or HINTED
        elif tokens & OWN:
            own = True
    return "" if own else found


@dataclass
class Open:
    tag: str
    dropped: str  # by what markup, or empty
    silent: bool  # within a dropped inline element: its text joins no line
    number: int  # if it is a container
    article: int
    main: bool
    hinted: int = 0


class Lines(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack = [Open("", "", False, 0, 0, False)]
        self.parts: list[str] = []
        self.tags = self.made = self.hints = 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        for closed in CLOSES.get(tag, ()):
            self._close(closed, FENCE.get(closed, frozenset()))
        if tag in BLOCK:
            self._end_line()
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        up = self.stack[-1]
        dropped, silent, inside, hinted = up.dropped, up.silent, up.article > 0 or up.main, up.hinted
        if not dropped or dropped == HINTED:  # what is dropped by a hint may hold what is dropped for good
            why = tag if tag in DROPPED or tag == "header" and not inside else _named(tag, attrs, inside) if attrs else ""
            if why and why != dropped:
                dropped, silent = why, tag not in BLOCK
                self.hints += why == HINTED
                hinted = self.hints if why == HINTED and not silent else 0
        self.made += tag in CONTAINER
        article = up.article or (self.made if tag == "article" else 0)
        self.stack.append(Open(tag, dropped, silent, self.made if tag in CONTAINER else 0, article, up.main or tag == "main", hinted))

    def handle_startendtag(self, tag, attrs):  # a slash does not close an element, as in browsers
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self._end_line()
        self._close(tag, frozenset())

    def handle_data(self, data):
        if not self.stack[-1].silent:
            self.parts.append(data)

    def _close(self, tag: str, fence: frozenset) -> None:
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].tag == tag:
                if tag in BLOCK:
                    self._end_line()
                del self.stack[at:]
                return
            if self.stack[at].tag in fence:
                return

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            up = self.stack[-1]
            self.lines.append(Line(text, self.tags, tuple(x.number for x in self.stack if x.number), up.article, up.main, up.dropped, any(x.tag in HEADINGS for x in self.stack[-3:]), up.hinted))
            self.tags = 0

    def parse_marked_section(self, i, report=1):
        """``<![…>`` is a comment, as in browsers; the library's parser refuses keywords that it does not know."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def unknown_decl(self, data):
        pass

    def close(self):
        super().close()
        self._end_line()


def lines_of(html: str) -> list[Line]:
    parser = Lines()
    parser.feed(html)
    parser.close()
    return parser.lines


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = math.ceil(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def content(lines: list[Line]) -> list[Line]:
    """The lines of the content region."""
    kept = [x for x in lines if not x.dropped] or [x for x in lines if x.article] or [x for x in lines if x.dropped == "form"]
    if not kept:
        return []
    ratios = smoothed(np.array([len(x.text) / max(1, x.tags) for x in kept]))
    dense = [x for x, r in zip(kept, ratios) if r >= ratios.std()] or kept
    by_article: dict[int, int] = defaultdict(int)
    for x in dense:
        by_article[x.article] += len(x.text)
    best = max(by_article, key=by_article.get)
    if best:
        region = _story(kept, dense, by_article, best)
        return _with_hinted(lines, region, ratios.std())
    if main := [x for x in kept if x.main]:
        return main
    own: dict[tuple[int, ...], int] = defaultdict(int)
    for x in dense:
        own[x.chain] += len(x.text)
    chain = max(own, key=own.get)
    while chain and _belongs(chain, kept, dense):
        chain = chain[:-1]
    return [x for x in kept if x.chain[: len(chain)] == chain]


def _story(kept: list[Line], dense: list[Line], by_article: dict[int, int], best: int) -> list[Line]:
    """Lines of the best article, of its siblings in the content cluster, and the headline and dense lines around them."""
    above = next(x.chain[: x.chain.index(best)] for x in kept if x.article == best)
    whole: dict[int, int] = defaultdict(int)
    for x in kept:
        if x.article and x.chain[: x.chain.index(x.article)] == above:
            whole[x.article] += len(x.text)
    chosen = {a for a, n in whole.items() if 2 * by_article[a] >= n and 4 * by_article[a] >= by_article[best]} | {best}
    near = lambda x: not x.article and (x.main or bool(above) and x.chain[: len(above)] == above)
    first, thick = next(k for k, x in enumerate(kept) if x.article in chosen), {id(x) for x in dense}
    return [x for k, x in enumerate(kept) if x.article in chosen or near(x) and (id(x) in thick or x.heading and k < first)]


def _with_hinted(lines: list[Line], region: list[Line], spread: float) -> list[Line]:
    """The region and, in page order, the blocks in its articles that a hint dropped and the ratio takes back.

    Such a block has at least three lines in the cluster, which make up most of its text and a tenth of the region's.
    """
    articles, size = {x.article for x in region if x.article}, sum(len(x.text) for x in region)
    blocks: dict[int, list[Line]] = defaultdict(list)
    for x in lines:
        if x.hinted and x.dropped == HINTED and x.article in articles:
            blocks[x.hinted].append(x)
    back = set()
    for block in blocks.values():
        thick = [x for x, r in zip(block, smoothed(np.array([len(x.text) / max(1, x.tags) for x in block]))) if r >= spread]
        text = sum(len(x.text) for x in thick)
        if len(thick) >= 3 and 2 * text >= sum(len(x.text) for x in block) and 10 * text >= size:
            back |= {id(x) for x in block}
    mine = {id(x) for x in region} | back
    return [x for x in lines if id(x) in mine]


def _belongs(chain: tuple[int, ...], kept: list[Line], dense: list[Line]) -> bool:
    """Whether the container around ``chain`` holds more of its text: of the lines it adds at least half are dense.

    The page itself, where anything may stand, has to add a tenth of the dense text as well.
    """
    def added(lines: list[Line]) -> list[Line]:
        return [x for x in lines if x.chain[: len(chain) - 1] == chain[:-1] and x.chain[: len(chain)] != chain]

    more = added(dense)
    text = sum(len(x.text) for x in dense if x.chain[: len(chain)] == chain)
    return bool(more) and 2 * len(more) >= len(added(kept)) and (len(chain) > 1 or sum(len(x.text) for x in more) > 0.1 * text)


def main_text(html: str | None) -> str:
    return "\n".join(x.text for x in content(lines_of(html or "")))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with their main text added as ``text``, ``html`` left out; columns of that name, whatever their case, are replaced."""
    held = pages.toDF(*[f"c{k}" for k in range(len(pages.columns))])  # names may differ in case only, or hold a dot
    kept = [k for k, c in enumerate(pages.columns) if c != html and c.lower() != "text"]
    places = [f"c{k}" for k in kept]
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in held.schema.fields if f.name in places], "text string"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(h.as_py()) for h in b.column(b.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], [*places, "text"])

    found = held.select(*places, F.col(f"c{pages.columns.index(html)}").alias("text")).mapInArrow(run, schema)
    return found.toDF(*[pages.columns[k] for k in kept], "text")


@query("op8_html_extraction")
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
