"""Main text of web pages by line-block distribution.

Markup is stripped into *lines*, one for each block of the page; what lies in menus, page headers, footers, asides,
forms, scripts and styles leaves an empty line, and an article's borders leave a window of empty lines. A line's length is 0 if it is
mostly links, or a few words that stand in a ``div`` by themselves. Lengths are summed over windows of ``WINDOW`` lines.
From the densest window the text is followed up to its *surge* and down to its *dive*: the points behind which no line with
a length comes within a window, nor, within ``REACH`` lines, a window with ``SURGE`` characters; labels don't count as lines
there, however many they are. All lines between are kept, and articles that reach into that are kept whole.

Markup helps in two ways only. Elements that are called advert, notice, comments or the like by class, id or role are left
out, but never so that nothing is left: where they hold nearly all of the page, the largest is no such element. And
class and id of inline elements, of ``body`` and of ``main`` say nothing.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: A line of which more than this share is link text has no length: a menu without a mark.
LINKS = 0.5
#: Fewer characters than this in a ``div`` of their own are a label, not a paragraph.
LABEL = 100
#: Beyond a window of empty lines the text goes on if, within so many lines, a window has so many characters.
REACH, SURGE = 12, 40
#: Elements that are left out by their names must leave this share of the text, or an article, or a first heading.
LEAST = 0.25

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/>]+)")
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table caption tbody td tfoot th thead tr ul".split())
_SKIP = set("nav footer aside form head button select svg canvas object audio video map menu dialog math datalist search".split())
_ARTICLE = {"article", "main"}
#: A start tag of these ends an open one of the same kind before it, up to the nearest of the elements after it.
_SIBLINGS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_PLAIN = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "tablist", "toolbar"}
_NAMES = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot banner banners sponsor sponsored sponsors promo promos promotion sidebar sidebars sidenav menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar cookie cookies cookiebar consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup comment comments commentlist reply replies respond disqus share sharing social related recommended recommendations recommendation widget widgets toolbar pagination pager hidden copyright legal disclaimer login paywall skip".split()
)
_NOT = {"has", "with", "no", "without", "is", "not", "js"}


def _named(names: str) -> bool:
    for name in names.lower().split():
        parts = re.split(r"[-_:]+", re.sub(r"\d+$", "", name))
        if parts[0] in _NOT:
            continue
        # sidebar, sidebar-left, site-footer, post-comments; also top-ad-slot
        if any(p in _NAMES for p in parts) and "content" not in parts and "body" not in parts:
            return True
    return False


def _named_so(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element's class, id, role or style says that it holds none of the article."""
    if not attributes or tag in ("html", "body", "main"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = (m[1] or m[5] or "").lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            if _named(value) or (not inside and value.lower() in ("header", "page-header", "site-header")):
                return True
        elif name == "role" and value.lower() in _ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


@dataclass
class Line:
    """A block: its text, the share of link text, the article that it stands in (0: none), the innermost element around it that
    names would leave out (0: none), and whether it is a first heading or stands in a ``div`` by itself."""

    text: str
    links: float
    article: int
    named: int
    heading: bool = False
    alone: bool = False

    def label(self) -> bool:
        return self.alone and 0 < len(self.text) < LABEL and self.links <= LINKS

    def length(self) -> int:
        return 0 if self.links > LINKS or self.label() else len(self.text)


class _Open:
    """The open elements, with where the last one of each name is: no start or end tag looks through them all."""

    def __init__(self) -> None:
        self.items: list[tuple[str, bool, int, int]] = []  # name, skipped, article, named
        self.where: dict[str, list[int]] = {}

    def last(self, *names: str) -> int:
        """The place of the innermost open element of one of these names, -1 if there is none."""
        return max((at[-1] for n in names if (at := self.where.get(n))), default=-1)

    def push(self, item: tuple[str, bool, int, int]) -> None:
        self.where.setdefault(item[0], []).append(len(self.items))
        self.items.append(item)

    def cut(self, n: int) -> None:
        for name, *_ in self.items[n:]:
            self.where[name].pop()
        del self.items[n:]

    def top(self) -> tuple[str, bool, int, int]:
        return self.items[-1] if self.items else ("", False, 0, 0)


def lines(page: str) -> tuple[list[Line], list[int]]:
    """A page's blocks in order; what is skipped, and an article's borders, give lines without text. And of each element that names
    would leave out, counted from 1, the one around it: a parent comes before its children."""
    out: list[Line] = []
    parents = [0]
    tags = _Open()
    text: list[str] = []
    linked = links = articles = 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                name, _, article, named = tags.top()
                out.append(Line(whole, min(1.0, linked / len(whole)), article, named, tags.last("h1") >= 0, name == "div"))
            text.clear()
        linked = 0

    def gap(n: int) -> None:
        out.extend(Line("", 0.0, tags.top()[2], 0) for _ in range(n))

    def close(n: int) -> None:
        flush()
        was, borders = tags.top()[1], sum(t[0] == "article" for t in tags.items[n:])
        tags.cut(n)
        if was and not tags.top()[1]:
            gap(1)
        elif borders and not was:
            gap(WINDOW)

    def add(raw: str) -> None:
        nonlocal linked
        if not tags.top()[1] and raw:
            piece = html.unescape(raw)
            text.append(piece)
            if links:
                linked += len(piece)

    at = 0
    while True:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[3] is None:
            if m[1]:
                add(m[1])
            continue
        tag = m[3].lower()
        if m[2]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag not in _PLAIN:
                n = tags.last(tag)
                if n >= 0:
                    close(n)
                elif tag in _BLOCK:
                    flush()
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*(?:[^>]*)(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in _BLOCK:
            links = 0 if tag in ("p", "article", "section", "nav", "footer") else links  # a link that was never closed
            if tags.top()[0] == "p":
                close(len(tags.items) - 1)
            if tag in _SIBLINGS:
                pair = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
                n = tags.last(*pair)
                if n > tags.last(*_SIBLINGS[tag]):
                    close(n)
            flush()
        if tag == "br":
            text.append(" ")
        if tag == "a":
            links += 1
        if tag in _VOID or tag in _PLAIN:
            continue
        if tag == "body" and (n := tags.last("head")) >= 0:  # a head that was never closed ends here
            close(n)
        _, skip, article, named = tags.top()
        hides = skip or tag in _SKIP or (tag == "header" and not article)
        if hides and not skip:
            flush()
        if not hides:
            if tag in _ARTICLE and (tag == "article" or article == 0):
                if tag == "article":
                    gap(WINDOW)
                articles += 1
                article = article or articles
            if _named_so(tag, m[4], article > 0):
                parents.append(named)
                named = len(parents) - 1
        tags.push((tag, hides, article, named))
    flush()
    return out, parents


def left(found: list[Line], parents: list[int]) -> list[Line]:
    """The lines with empty ones for what names leave out, if enough is left; else the largest such element counts as text, and so
    on. An element is never larger than the one around it, so they count in one order, from the outside in."""
    own, size, main = [0] * len(parents), [0] * len(parents), [False] * len(parents)
    for x in found:
        own[x.named] += len(x.text)
        main[x.named] |= bool(x.text and (x.article or x.heading))
    for e in range(len(parents) - 1, 0, -1):
        size[e] += own[e]
        size[parents[e]] += size[e]
    least = LEAST * sum(own)
    text, enough, counts = own[0], main[0], [True] + [False] * (len(parents) - 1)
    for e in sorted(range(1, len(parents)), key=lambda e: (-size[e], e)):
        if enough or text >= least:
            break
        counts[e], text, enough = True, text + own[e], enough or main[e]
    return [x if counts[x.named] else Line("", 0.0, 0, 0) for x in found]


def densest(lengths: list[int], window: int = WINDOW) -> int:
    """The first line with text of the densest window of lines; some line must have text."""
    sums = [sum(lengths[i : i + window]) for i in range(len(lengths))]
    peak = max(range(len(sums)), key=sums.__getitem__)
    return next(i for i in range(peak, len(lengths)) if lengths[i])


def surge_and_dive(lengths: list[int], window: int = WINDOW) -> tuple[int, int]:
    """The first line and the line after the last of the text around the densest window of lines."""
    if not any(lengths):
        return 0, 0

    def follow(lengths: list[int], at: int) -> int:
        """The last line of the text from ``at`` on."""
        while True:
            near = [i for i in range(at + 1, min(at + 1 + window, len(lengths))) if lengths[i]]
            if near:
                at = near[-1]
                continue
            far = next((i for i in range(at + 1, min(at + 1 + REACH, len(lengths))) if sum(lengths[i : i + window]) >= SURGE), None)
            if far is None:
                return at
            at = next(i for i in range(far, len(lengths)) if lengths[i])

    peak = densest(lengths, window)
    return len(lengths) - 1 - follow(lengths[::-1], len(lengths) - 1 - peak), follow(lengths, peak) + 1


def main_text(page: str | None) -> str:
    """The page's main text, a block a line; empty if there is none."""
    found = left(*lines(page or ""))
    lengths = [x.length() for x in found]
    if any(lengths):
        # labels neither are text nor part it
        told = [i for i, x in enumerate(found) if not x.label()]
        first, end = surge_and_dive([lengths[i] for i in told])
        first, end = told[first], told[end - 1] + 1
    else:
        lengths = [len(x.text) for x in found]  # nothing but labels and links
        first, end = surge_and_dive(lengths)
    reached = {x.article for x, n in zip(found[first:end], lengths[first:end], strict=True) if x.article and n}
    return "\n".join(x.text for i, x in enumerate(found) if x.text and (first <= i < end or x.article in reached))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, url, text, n_chars`` of every row: its main text and the number of its code points.

    Character references are decoded, white space inside a block is one space, blocks are joined by a line feed. A null
    or empty page, or one without main text, gives an empty text. Of windows that are equally dense the first counts. A page's
    work grows with its size, however long it is and whatever tags are left open. Null ids and urls stay null, repeated rows stay
    repeated, an empty table gives an empty one; other columns are not read. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                texts = [main_text(p) for p in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    source = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
