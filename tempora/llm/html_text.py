"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of the page in page order. A line's weight is the length of its text
outside links with a target; what stands in elements that never hold the article is marked and weighs nothing. The sums
of the weights over `window` neighbouring lines rise where text surges and fall where it dives. The heaviest stretch
between a surge and its dive says where the article is: in the smallest element that holds most of its weight. Lines of
that element stay, light ones too; those outside need a stretch of their own, with a good share of the article's weight,
and so menus, notices and adverts go whatever they are named. A name that only hints at an aside marks an element as
long as less than half of the page's text stands in it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm._common import in_arrow, slices

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TARGET = re.compile(r"(?:^|\s)href\s*=", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
#: Elements whose content is no text, elements and names that never hold the article, and elements that begin a line.
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "select", "button", "xmp"}
_ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head", "figure"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption",
    "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "legend", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul",
} | _ASIDE
#: Of these, those that hold other blocks rather than text; and those whose lines are headings.
_CONTAINER = {"address", "article", "body", "center", "details", "div", "fieldset", "html", "main", "section", "td"} | _ASIDE
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Names that say what an element is, if one of its names is nothing else; reader comments, in any part of a name; and names that hint.
_SURE_NAME = re.compile(r"(?:^|(?<=\s))(?:ad|ads|advert|adverts|advertisement|sidebar|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|footer|masthead|cookies?|consent|newsletter|complementary|contentinfo)(?=\s|$)", re.I)
_COMMENT_NAME = re.compile(r"(?:^|[\s_-])(?:comment|comments|disqus|reply|replies|respond)(?=$|[\s_-])", re.I)
_ASIDE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|menu|nav|navbar|navigation|breadcrumb|breadcrumbs"
    r"|sidebar|side|aside|widget|footer|header|masthead|topbar|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|signup|login"
    r"|discussion|share|sharing|social|related|recommended|pagination|pager|tags|search)(?=$|[\s_-])",
    re.I,
)
#: Names that say what a wrapper has beside it, not what it is; and those of headers, which in an article hold its title.
_WITH = re.compile(r"(?:^|(?<=\s))(?:with|has|no)[-_]\S*", re.I)
_HEADER = re.compile(r"(?:(?<=^)|(?<=[\s_-]))header(?=$|[\s_-])", re.I)
#: Weights that a window takes in where text surges and where it dives, and the share of the heaviest window that is enough on light pages.
SURGE, DIVE, SHARE = 100, 40, 0.5
#: Shares of the article's weight with which other stretches, or other article elements, stay: of one line, and of several.
ALONE, SEVERAL = 0.25, 0.1


class Line(NamedTuple):
    """A line: its text with white space turned to single spaces, its weight, whether it is marked as aside or hidden, its container, and whether it is a heading."""

    text: str
    weight: int
    marked: bool
    node: int
    heading: bool


class Page(NamedTuple):
    """The lines of a page and its containers: the name of each, and the number of the one around it, which is smaller."""

    lines: list[Line]
    names: list[str]
    around: list[int]


class _Open:
    __slots__ = ("aside", "hint", "name", "node")

    def __init__(self, name: str, aside: bool, hint: int | None, node: int):
        self.name, self.aside, self.hint, self.node = name, aside, hint, node


def _kind(name: str, attributes: str, outside: bool) -> tuple[bool, bool]:
    """Whether an element is surely an aside or hidden, and whether its names hint at an aside. `outside` of article and main, headers and figures are asides."""
    if name in _ASIDE and (outside or name not in ("header", "figure")) or attributes and _HIDDEN.search(attributes):
        return True, False
    if not attributes or name in ("body", "html", "article", "main"):
        return False, False
    named = [_WITH.sub("", x) for m in _NAMES.finditer(attributes) for x in m.groups() if x]
    if any(_SURE_NAME.search(x) or _COMMENT_NAME.search(x) for x in named):
        return True, False
    return False, any(_ASIDE_NAME.search(x if outside else _HEADER.sub("", x)) for x in named)


def page_of(page: str) -> Page:
    """The page's lines and containers."""
    lines: list[tuple[str, int, bool, int, bool, tuple[int, ...]]] = []
    names, around = ["html"], [-1]
    parts: list[str] = []
    linked: list[str] = []
    aside = n_hints = 0
    open_: list[_Open] = []
    link: int | None = None  # how many elements were open where the open link began

    def close_line() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                links = " ".join(html.unescape("".join(linked)).split())
                heading = any(o.name in _HEADING for o in open_[-3:])
                lines.append((text, max(0, len(text) - len(links)), aside > 0, open_[-1].node if open_ else 0, heading, tuple(o.hint for o in open_ if o.hint is not None)))
            parts.clear()
        linked.clear()

    at = 0
    while token := _TOKEN.search(page, at):
        if token.start() > at:
            parts.append(page[at : token.start()])
            if link is not None:
                linked.append(parts[-1])
        at = token.end()
        name = (token[1] or "").lower()
        if not name:
            continue
        closing = page[token.start() + 1] == "/"
        if name in _RAW:
            if not closing and (end := re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)):
                at = end.end()
            elif not closing and name in ("script", "style"):
                at = len(page)
            continue
        if name == "a":
            if closing:
                link = None
            elif _TARGET.search(token[2]):
                link = len(open_)
            linked.append(" ")
        if name not in _BLOCK:
            continue
        close_line()
        if name in _VOID:
            continue
        if closing:
            at_open = next((k for k in range(len(open_) - 1, -1, -1) if open_[k].name == name), None)
            if at_open is not None:
                aside -= sum(o.aside for o in open_[at_open:])
                del open_[at_open:]
                if link is not None and link > len(open_):
                    link = None
            continue
        if name == "p" and open_ and open_[-1].name == "p":
            aside -= open_.pop().aside
            if link is not None and link > len(open_):
                link = None
        sure, hinted = _kind(name, token[2], not any(o.name in ("article", "main") for o in open_))
        n_hints += hinted
        node = open_[-1].node if open_ else 0
        if name in _CONTAINER:
            names.append(name)
            around.append(node)
            node = len(names) - 1
        open_.append(_Open(name, sure, n_hints if hinted else None, node))
        aside += sure
    if at < len(page):
        rest = page[at:]
        parts.append(rest[: rest.rfind("<")] if re.search(r"<[a-zA-Z/!][^>]*$", rest) else rest)
    close_line()
    # a hint holds for an element with less than half of the text
    total, inside = 0, [0] * (n_hints + 1)
    for _, weight, off, _, _, hints in lines:
        if not off:
            total += weight
            for h in hints:
                inside[h] += weight
    made = []
    for text, weight, off, node, heading, hints in lines:
        marked = off or any(2 * inside[h] < total or not total for h in hints)
        made.append(Line(text, 0 if marked else weight, marked, node, heading))
    return Page(made, names, around)


def _stretches(weight: list[int], window: int, surge: float, dive: float) -> list[tuple[int, int]]:
    """The first line and that after the last of each stretch: window sums of `dive` or more, one of `surge` or more among them, trimmed to lines that weigh something."""
    half, out, k = window // 2, [], 0
    sums = [sum(weight[max(0, k - half) : k + half + 1]) for k in range(len(weight))]
    while k < len(sums):
        end = k
        while end < len(sums) and sums[end] > 0 and sums[end] >= dive:
            end += 1
        heavy = [j for j in range(k, end) if weight[j] > 0]
        if heavy and max(sums[k:end]) >= surge:
            out.append((heavy[0], heavy[-1] + 1))
        k = end + 1
    return out


def _held(page: Page, weights: dict[int, int]) -> list[int]:
    """The weight of each container's lines, those of the containers in it included."""
    held = [0] * len(page.names)
    for j, w in weights.items():
        held[page.lines[j].node] += w
    for node in range(len(held) - 1, 0, -1):
        held[page.around[node]] += held[node]
    return held


def _within(page: Page, chosen: set[int]) -> list[bool]:
    """Which lines stand in the chosen containers."""
    inside = [False] * len(page.names)
    for node in range(len(inside)):
        inside[node] = node in chosen or node > 0 and inside[page.around[node]]
    return [inside[line.node] for line in page.lines]


def _article(page: Page, best: tuple[int, int]) -> tuple[set[int], bool]:
    """The containers of the article, and whether they are elements that say so."""
    weights = {j: page.lines[j].weight for j in range(*best)}
    held, total = _held(page, weights), sum(weights.values())
    said = [n for n, name in enumerate(page.names) if name in ("article", "main")]
    first = max(said, key=lambda n: (held[n], n), default=None)
    if first is not None and held[first] >= ALONE * total:
        whole = _held(page, {j: line.weight for j, line in enumerate(page.lines)})
        return {n for n in said if n == first or whole[n] >= ALONE * whole[first]}, True
    node = 0
    for n in range(1, len(held)):
        if page.around[n] == node and 2 * held[n] > total:
            node = n
    return {node}, False


def _own(page: Page, line: Line) -> int:
    """The container that a line is text of; a cell's is that of its table."""
    node = line.node
    while page.names[node] == "td":
        node = page.around[node]
    return node


def kept_lines(page: Page, window: int = 3, surge: int = SURGE, dive: int = DIVE) -> list[bool]:
    """Which lines stay. Where no window weighs surge / SHARE, both thresholds shrink with the heaviest one, so that short pages have text too.

    All unmarked lines of an article or main element stay. Of another container those stay that stand between the first and
    the last line of its stretches; before and after, those that are text of the same containers, up to the first that isn't,
    if they weigh something or are headings; and the heading nearest above, if it stands in an element around the article.
    """
    lines = page.lines
    weight = [line.weight for line in lines]
    half = window // 2
    heaviest = max((sum(weight[max(0, k - half) : k + half + 1]) for k in range(len(weight))), default=0)
    scale = min(1.0, SHARE * heaviest / surge)
    stretches = _stretches(weight, window, surge * scale, dive * scale)
    keep = [False] * len(lines)
    if not stretches:
        return keep
    chosen, said = _article(page, max(stretches, key=lambda s: sum(weight[s[0] : s[1]])))
    inside = _within(page, chosen)
    if said:
        keep = inside[:]
    else:
        heavy = [j for a, b in stretches for j in range(a, b) if inside[j] and weight[j] > 0]
        owners = {_own(page, lines[j]) for j in heavy}
        for j in range(heavy[0], heavy[-1] + 1):
            keep[j] = inside[j]
        for j, step in ((heavy[0] - 1, -1), (heavy[-1] + 1, 1)):
            while 0 <= j < len(lines) and (lines[j].marked or inside[j] and _own(page, lines[j]) in owners):
                keep[j] = weight[j] > 0 or lines[j].heading
                j += step
        article = sum(w for w, i in zip(weight, inside, strict=True) if i)
        for a, b in _stretches([0 if i else w for w, i in zip(weight, inside, strict=True)], window, surge * scale, dive * scale):
            own = [j for j in range(a, b) if not inside[j]]
            several = sum(weight[j] >= dive * scale for j in own) > 1
            if sum(weight[j] for j in own) >= (SEVERAL if several else ALONE) * article:
                for j in own:
                    keep[j] = True
    _keep_heading(page, keep, chosen, surge * scale)
    return [k and not line.marked for k, line in zip(keep, lines, strict=True)]


def _keep_heading(page: Page, keep: list[bool], chosen: set[int], surge: float) -> None:
    first = next((j for j, k in enumerate(keep) if k), 0)
    if page.lines[first].heading:
        return
    above, node = {0}, min(chosen)
    while node > 0:
        above.add(node)
        node = page.around[node]
    j = first - 1
    while j >= 0 and page.lines[j].weight < surge and not (page.lines[j].heading and not page.lines[j].marked):
        j -= 1
    if j < 0 or not page.lines[j].heading:
        return
    own = page.lines[j].node
    if own in above or page.around[own] in above and page.around[own] > 0:
        for i in range(j, first):
            keep[i] = page.lines[i].node == own and (page.lines[i].weight > 0 or i == j)


def main_text(page: str | None, window: int = 3, surge: int = SURGE, dive: int = DIVE) -> str:
    """The kept lines, joined by one space."""
    found = page_of(page or "")
    return " ".join(line.text for line, k in zip(found.lines, kept_lines(found, window, surge, dive), strict=True) if k)


def _texts(html_col: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, html_col):
        made = [main_text(page) for page in batch.column(html_col).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.string())], names=[*batch.schema.names[:-1], "text"])


def page_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each page, from the whole html.

    Null and empty html give empty text; so does a page whose lines all weigh nothing. Null ids and urls and repeated
    rows keep their rows; an empty table gives none.
    """
    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (id_col, url_col))
    return in_arrow(rows, lambda batches: _texts(html_col, batches), f"{kinds}, text string").withColumn("n_chars", F.char_length("text").cast("long"))
