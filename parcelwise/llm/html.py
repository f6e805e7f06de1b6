"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser feeds a page as events. Every block (paragraph, heading, cell ...) is a line with
its text, the number of tags in it and the element it stands in. Lines of an element that is a menu, header,
footer, sidebar, notice, advert, form or reader comment by its tag, role, id or class are boilerplate. Of the
others (runs of lines that are links alone left out, too), the text-to-tag ratio is smoothed over neighbouring lines and split
into two clusters. The upper cluster chooses the content region of every page: the elements that name themselves articles if
half of its text lies in them, else the smallest element that holds most of it. All lines of the region that are not
boilerplate are the article, short ones too.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_SILENT = frozenset("script style noscript template head title iframe object svg math canvas audio video select textarea button".split())
_FRAME = frozenset("nav footer aside form dialog menu".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement adbox banner promo promoted sponsor sponsored sidebar sidebars aside nav navbar navigation menu menus "
    "breadcrumb breadcrumbs header masthead footer foot comments comment commentlist disqus respond replies cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe signup login form share sharing social related recommended "
    "recommendations widget toolbar topbar bottombar pagination pager skip copyright".split()
)
_EDGES = frozenset("header masthead footer foot".split())
_CONTENT = frozenset("article post-content entry-content article-body main-content".split())
_CLOSES_P = _BLOCK - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot"}
_SCOPE = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}
_SIBLINGS = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}
_OWN = frozenset("site page global top main".split())
_LAYOUT = frozenset("has no not with without open opened closed enabled disabled layout".split())


def _named(attrs: list[tuple[str, str | None]]) -> tuple[bool, bool, bool, bool, bool]:
    """Boilerplate by role, by a whole name, by a part of a name; content; hidden."""
    role = frame = part = content = hidden = False
    for key, value in attrs:
        written, value = value or "", (value or "").lower()
        if key == "role":
            role |= value in _ROLES
            content |= value in ("main", "article")
        elif key in ("id", "class"):
            for name in written.split():
                parts = {p.lower() for p in re.split(r"[-_:]+|(?<=[a-z0-9])(?=[A-Z])", name)}
                name = name.lower()
                content |= name in _CONTENT
                own = parts & _EDGES  # entry-header is the article's own, site-header is not
                # has-sidebar and comments-open tell of a layout, not of what the element is
                frame |= name in _NAMES
                part |= not parts & _LAYOUT and bool(parts & _NAMES - _EDGES or own and parts & _OWN)
        elif key == "hidden" or key == "aria-hidden" and value == "true":
            hidden = True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
    return role, frame, part, content, hidden


class _Events(HTMLParser):
    """Collects lines: text, tags, the innermost element around it, whether it is boilerplate, whether all of it is links.

    Elements are numbered in page order from 1, and each knows the one around it. No event walks the open elements,
    so the work grows with the page however deep it nests.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # tag, element number, silent, boilerplate (by 1: part of a name, 2: name, 3: tag, role or hidden), in an article
        self.stack: list[tuple[str, int, bool, int, bool]] = []
        self.open: dict[str, list[int]] = {}  # places in the stack of the open elements of a tag
        self.blocks: list[int] = []  # and of all open blocks
        self.parents = [0]  # element around each element, 0 around the page
        self.articles: set[int] = set()  # numbers of article elements
        self.pages: set[int] = set()  # of html and body
        self.mains: set[int] = set()  # of others that name themselves content
        self.text: list[str] = []
        self.tags = 0
        self.linked = 0  # characters of the line that lie in links
        self.lines: list[tuple[str, int, int, int, bool]] = []

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            links = self.linked >= 0.9 * len("".join(text.split()))
            _, element, _, boiler, _ = self.stack[-1] if self.stack else ("", 0, False, 0, False)
            self.lines.append((text, self.tags, element, boiler, links))
        if text or self.tags:
            self.tags = 0
        self.text, self.linked = [], 0

    def _last(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element of these tags, -1 if there is none."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def _pop_to(self, at: int) -> None:
        if self.blocks and self.blocks[-1] >= at:
            self._flush()
        for tag, *_ in reversed(self.stack[at:]):
            self.open[tag].pop()
        del self.stack[at:]
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _CLOSES_P or tag == "p":
            if self.blocks and self.stack[self.blocks[-1]][0] == "p":
                self._pop_to(self.blocks[-1])
        elif tag in _SCOPE:
            at = self._last(_SIBLINGS.get(tag, (tag,)))
            if at > self._last(_SCOPE[tag]):
                self._pop_to(at)
        if tag in _BLOCK:
            self._flush()
        self.tags += 1
        if tag in _VOID:
            if tag == "br":
                self.text.append(" ")
            return
        element, inside = len(self.parents), bool(self.stack) and self.stack[-1][4]
        self.parents.append(self.stack[-1][1] if self.stack else 0)
        role, frame, part, content, hidden = _named(attrs)
        silent, boiler = (self.stack[-1][2], self.stack[-1][3]) if self.stack else (False, 0)
        holds = tag in ("article", "main") or content
        if tag == "header":  # an article's own header holds its headline
            role |= not inside
        elif holds and not role and not frame and boiler < 2:
            # what names itself an article overrules parts of names, its own and those around it
            (self.articles if tag == "article" else self.mains).add(element)
            inside |= tag == "article"
            part = False
            boiler = 0
        if tag in ("body", "html"):
            self.pages.add(element)
            role = frame = part = False
        boiler = max(boiler, 3 if tag in _FRAME or role or hidden else 2 if frame else 1 if part else 0)
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in _BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, element, silent or tag in _SILENT, boiler, inside))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag not in _BLOCK and self.stack and self.stack[-1][0] == tag:
            self._pop_to(len(self.stack) - 1)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        at = self._last((tag,))
        # an inline end tag does not reach out of its block
        if at >= 0 and (tag in _BLOCK or not self.blocks or self.blocks[-1] < at):
            self._pop_to(at)

    def handle_data(self, data: str) -> None:
        if not (self.stack and self.stack[-1][2]):
            self.text.append(data)
            if self.open.get("a"):
                self.linked += len("".join(data.split()))

    def done(self) -> None:
        self.close()
        self._flush()

    def within(self, elements: set[int]) -> list[bool]:
        """Of each element, whether it is one of these or inside one."""
        out = [False] * len(self.parents)
        for e in range(1, len(out)):  # what is around an element has a smaller number
            out[e] = e in elements or out[self.parents[e]]
        return out

    def held(self, texts: Iterable[tuple[int, int]]) -> list[int]:
        """Characters inside each element, from (element, characters) of the lines."""
        out = [0] * len(self.parents)
        for element, n in texts:
            out[element] += n
        for e in range(len(out) - 1, 0, -1):
            out[self.parents[e]] += out[e]
        return out


def smoothed_ratios(lines: list[tuple], sigma: float = 1.0) -> np.ndarray:
    """Characters per tag of each line, Gaussian weights over its neighbours."""
    ratio = np.array([len(text) / max(1, tags) for text, tags, *_ in lines], float)
    reach = int(np.ceil(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights /= weights.sum()
    padded = np.concatenate((np.repeat(ratio[:1], reach), ratio, np.repeat(ratio[-1:], reach)))
    return np.convolve(padded, weights, "valid")


def threshold(values: np.ndarray) -> float:
    """Border between the two clusters of a one-dimensional two-means split of the logarithms."""
    logs = np.log1p(values)
    low, high = logs.min(), logs.max()
    for _ in range(50):
        upper = logs >= (low + high) / 2
        if upper.all() or not upper.any():
            break
        now = logs[~upper].mean(), logs[upper].mean()
        if now == (low, high):
            break
        low, high = now
    # clusters less than twice apart are one
    return float(np.expm1((low + high) / 2)) if high - low > np.log(2) else 0.0


def main_text(page: str | None) -> str:
    """The article's blocks, joined by blank lines; empty for a null or empty page or one without content."""
    if not page:
        return ""
    events = _Events()
    events.feed(page)
    events.done()
    size = lambda lines: sum(len(line[0]) for line in lines)
    live = [line for line in events.lines if not line[3]]
    # parts of names that hold nearly all text name the page's layout; whole names are believed unless nothing else is left
    wider = [line for line in events.lines if line[3] < 2]
    if 50 * size(live) < size(wider):
        live = wider
    live = live or [line for line in events.lines if line[3] < 3]
    if not live:
        return ""
    # lines of links that follow each other are a menu, whatever it is called
    menu = [a[4] and (b[4] or c[4]) for a, b, c in zip(live, [("",) * 4 + (False,), *live], [*live[1:], ("",) * 4 + (False,)], strict=False)]
    every, live = live, [line for line, drop in zip(live, menu, strict=True) if not drop]
    clustered = live or every
    values = smoothed_ratios(clustered)
    upper = values >= threshold(values)
    held = events.held((line[2], len(line[0])) for line, above in zip(clustered, upper, strict=True) if above)
    total = held[0]
    for named in (events.articles, events.mains):
        inside = events.within(named)
        chosen = sum(len(line[0]) for line, above in zip(clustered, upper, strict=True) if above and inside[line[2]])
        if 2 * chosen >= total:  # teasers may be marked up as articles, too
            return "\n\n".join(line[0] for line in every if inside[line[2]])
    if not live:
        return ""
    # elements are numbered in page order and nest, so of those that hold most of the text the last is the smallest
    region = max((e for e, n in enumerate(held) if n >= 0.8 * total), default=0)
    inside = events.within({region})
    if not region or region in events.pages:
        return "\n\n".join(line[0] for line in live if not region or inside[line[2]])
    # in the region of a story, links that follow its text are a list of the story's own
    within = [(line, drop) for line, drop in zip(every, menu, strict=True) if inside[line[2]]]
    first = next(k for k, (_, drop) in enumerate(within) if not drop)
    return "\n\n".join(line[0] for line, _ in within[first:])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per input row.

    Null or empty html, or a page without content: empty text, 0 characters. White space inside a block is one
    space, character references are decoded, blocks are joined by two \\n in page order. A cut-off page gives
    what it has. Other columns are not read, so their names cannot clash; repeated rows get a row each, null ids
    stay, an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(p.as_py()) for p in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, part.column(2).type), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars long")
