"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines, one for each block-level element's own text, and each line gets a weight: its length, or
0 if it is mostly links. Lines in what its element or names mark as furniture (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, comments) are left out. A name counts as a whole; html, body, main, article
and what holds them are never furniture by name, and neither is a block with most of the page's text, if no article is
elsewhere.

The weights are summed over sliding windows of lines. Where the sums reach a level is a surge, where they fall below it
a dive. A surge in an ``article`` or ``main`` element makes the element text, from its first line to its last, however
short they are; a page may have several such. Where no element of these kinds has text, it is the stretch between a
surge and a dive that holds most. On pages, and on elements, with little text the level is half of the largest sum.

Defined results. Null, empty and markup-only html: empty text. Unclosed comments, scripts and elements end with the
page; a tag that does not end before the next unquoted ``<`` is text. Repeated rows each give their row. Columns other
than page_id, url and html are not read. Time is linear in the length of a page.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textkit as tk

WINDOW = 3
#: Characters in a window of lines that make it text: a sentence or so.
SURGE = 60
#: Share of characters in links beyond which a line is a menu.
LINKED = 0.6

SKIPPED = frozenset("script style noscript template head svg math iframe object canvas video audio select option button textarea datalist".split())
FURNITURE = frozenset("nav footer aside form dialog menu".split())
ROOTS = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
#: Words of class, id or role that name furniture.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion menu menubar nav navbar navigation breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar "
    "cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus respond reply replies share sharing "
    "pagination pager search complementary contentinfo".split()
)
#: Names that are furniture outside of the article only.
OUTER_NAMES = frozenset("header head".split())
#: Names that are furniture outside of the article, and in it where the line is mostly links.
SOFT_NAMES = frozenset("notice notices alert social copyright legal disclaimer related recommended recommendations".split())
#: What a name may be joined with and still say the same: site-footer is a footer, no-sidebar is no sidebar.
QUALIFIERS = frozenset("site page main top bottom global primary secondary box bar block list area section wrapper wrap container widget form link links button buttons item items posts post articles slot unit zone inner outer fixed sticky mobile desktop text body".split())
NEVER = frozenset(("html", "body", "main", "article"))

# What follows a tag's name, up to its end: nothing is read on beyond a "<" outside of a quoted value.
_REST = r"((?:[^<>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|\"[^\"<>]*+\"|'[^'<>]*+'|[\"'](?=[^<>]*>))*+)>"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|textarea|svg)\b{_REST}.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+){_REST}|<[!?/][^<>]*>",
    re.DOTALL | re.IGNORECASE,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
#: Start tags that end an open element of these names, for the end tags that pages leave out.
_CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}


def _names(attributes: str) -> set[str]:
    """Names of furniture among the class, id and role tokens."""
    known = NAMES | OUTER_NAMES | SOFT_NAMES
    found = set()
    for m in _NAMED.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").lower().split():
            parts = [w for w in re.split(r"[^a-z0-9]+", token) if w]
            if all(w in known or w in QUALIFIERS or w.isdigit() for w in parts):
                found.update(known.intersection(parts))
    return found


def _furniture(name: str, attributes: str, in_root: bool) -> str:
    """What makes an element furniture: its "own" kind, its "name", its name if mostly links ("soft"), or nothing."""
    if name in FURNITURE or name in SKIPPED or name == "header" and not in_root or attributes and _HIDDEN.search(attributes):
        return "own"
    words = _names(attributes) if attributes else set()
    if words & NAMES or not in_root and words & (OUTER_NAMES | SOFT_NAMES):
        return "name"
    return "soft" if words & SOFT_NAMES else ""


class Line(NamedTuple):
    text: str
    linked: float  # share of its characters in links
    furniture: bool
    root: int  # number of the article or main element it lies in, or 0


class Open(NamedTuple):
    """An open element, with what it has from those around it."""

    name: str
    furniture: bool
    soft: bool  # furniture where mostly links
    named: int  # number of the closest element that its names mark, or -1
    root: int
    link: bool


_PAGE = Open("", False, False, -1, 0, False)


class _Named:
    """Elements that their names mark as furniture: the marked one around each, whether it lies in a root, and whether it is no furniture for all that."""

    def __init__(self) -> None:
        self.above: list[int] = []
        self.inside: list[bool] = []
        self.exempt: list[bool] = []

    def add(self, around: Open) -> int:
        self.above.append(around.named)
        self.inside.append(around.root > 0)
        self.exempt.append(False)
        return len(self.above) - 1

    def holds_text(self, k: int) -> None:
        while k >= 0 and not self.exempt[k]:
            self.exempt[k], k = True, self.above[k]

    def marks(self) -> list[bool]:
        """Whether what lies in each element is furniture; an element stands behind those around it."""
        out: list[bool] = []
        for above, exempt in zip(self.above, self.exempt, strict=True):
            out.append(not exempt or above >= 0 and out[above])
        return out


def lines_of(page: str) -> list[Line]:
    """The lines of a page in order."""
    out: list[Line] = []
    of_line: list[int] = []  # the marked element of each line
    stack, named = [_PAGE], _Named()
    opened: Counter[str] = Counter()
    buffer: list[str] = []
    linked = roots = 0

    def end_line() -> None:
        nonlocal linked
        if buffer:
            # A character reference may be cut by nothing but markup: decode the joined text, then its white space.
            text = _SPACE.sub(" ", entities.unescape("".join(buffer))).strip()
            if text:
                top, share = stack[-1], min(1.0, linked / len(text))
                out.append(Line(text, share, top.furniture or top.soft and share > LINKED, top.root))
                of_line.append(top.named)
            buffer.clear()
        linked = 0

    def text(raw: str) -> None:
        nonlocal linked
        buffer.append(raw)
        if stack[-1].link:
            linked += len(raw.strip())

    def close(k: int) -> None:
        opened.subtract(s.name for s in stack[k:])
        del stack[k:]

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name, attributes = (m[4] or "").lower(), m[5] or ""
        if not name:
            continue
        if name not in INLINE:
            end_line()
        elif name in VOID:
            buffer.append(" " if name == "br" else "")
        if name in VOID:
            continue
        if m[3]:
            if opened[name] > 0:
                k = len(stack) - 1
                # An inline element ends within its block.
                while stack[k].name != name and (name not in INLINE or stack[k].name in INLINE):
                    k -= 1
                if k and stack[k].name == name:
                    close(k)
            continue
        if name not in INLINE:
            # A block starts: open paragraphs end, and with them the inline elements left open in them.
            while stack[-1].name in INLINE or stack[-1].name == "p" or stack[-1].name in _CLOSES.get(name, ()):
                close(len(stack) - 1)
        around = stack[-1]
        kind = _furniture(name, attributes, around.root > 0)
        if name in NEVER:
            # Comments may be articles of their own, with names that say so: they don't speak for what holds them.
            if name != "article" or kind != "name":
                named.holds_text(around.named)
            kind = kind if kind == "own" else ""
        if attributes.endswith("/") and name not in INLINE:
            continue
        root = around.root
        if not root and name in ROOTS:
            root = roots = roots + 1
        stack.append(Open(name, around.furniture or kind == "own", around.soft or kind == "soft", named.add(around) if kind == "name" else around.named, root, around.link or name == "a"))
        opened[name] += 1
    text(page[at:])
    end_line()
    # Most of the text makes a block no furniture within an article, or where the page has none.
    marks = named.marks()
    has_root = any(line.root and not line.furniture and not (k >= 0 and marks[k]) for line, k in zip(out, of_line, strict=True))
    held, total = [0] * len(marks), 0
    for line, k in zip(out, of_line, strict=True):
        if not line.furniture and line.linked <= LINKED:
            total += len(line.text)
            if k >= 0:
                held[k] += len(line.text)
    for k in range(len(held) - 1, -1, -1):
        if (named.inside[k] or not has_root) and held[k] >= SURGE and 2 * held[k] > total:
            named.exempt[k] = True
        if named.above[k] >= 0:
            held[named.above[k]] += held[k]
    marks = named.marks()
    return [line._replace(furniture=line.furniture or k >= 0 and marks[k]) for line, k in zip(out, of_line, strict=True)]


def stretches(weights: list[int], window: int, level: float) -> list[tuple[int, int]]:
    """(surge, dive): lines from where the sums of a window before or behind reach the level to where they fall below it."""
    total = [0]
    for w in weights:
        total.append(total[-1] + w)
    out, n, since = [], len(weights), None
    level = min(level, max(total[min(n, i + window)] - total[i] for i in range(n)) / 2) if n else level
    for i in range(n):
        is_text = max(total[min(n, i + window)] - total[i], total[i + 1] - total[max(0, i + 1 - window)]) >= max(level, 1)
        if is_text and since is None:
            since = i
        if not is_text and since is not None:
            out.append((since, i))
            since = None
    return out if since is None else [*out, (since, n)]


def reaches(weights: list[int], window: int, level: float) -> bool:
    """Whether the sum of some window is at the level."""
    return any(sum(weights[i : i + window]) >= level for i in range(len(weights)))


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE, linked: float = LINKED) -> str:
    # Furniture takes no part in the windows: an advert within an article is no dive.
    lines = [x for x in lines_of(page or "") if not x.furniture]
    weights = [len(x.text) if x.linked <= linked else 0 for x in lines]
    of_root: dict[int, list[int]] = {}
    for x, w in zip(lines, weights, strict=True):
        if x.root:
            of_root.setdefault(x.root, []).append(w)
    heaviest = max(map(sum, of_root.values()), default=0)
    if heaviest:
        # The element with most text, and all others that have a surge of their own.
        roots = {r for r, own in of_root.items() if sum(own) == heaviest or reaches(own, window, surge)}
        chosen = [x for x in lines if x.root in roots]
    else:
        found = stretches(weights, window, surge)
        a, b = max(found, key=lambda s: sum(weights[s[0] : s[1]]), default=(0, 0))
        while a < b and not weights[a]:
            a += 1
        while a < b and not weights[b - 1]:
            b -= 1
        chosen = lines[a:b]
    return "\n\n".join(x.text for x in chosen)


def _extract(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            texts = [main_text(h) for h in tk.strings(part.column("html"))]
            yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
