"""Main text of converted or collected HTML files.

One pass of parser events cuts a page into lines (its blocks). Each line has a text-to-tag ratio: characters outside links
for each tag met since the line before. The ratios are smoothed with a Gaussian over the neighbouring lines and clustered
by a threshold, their standard deviation; lines above it are content. The content region is the article, or else the
smallest element that holds all content lines; its lines are returned, short ones between long ones too, without those
that an element marks as something else (menus, forms, notices, adverts, reader comments).

Names mark an element only as far as the clusters allow. A class name or a form marks nothing where it wraps the page: the
article that holds the clustered text, or most of that text itself. Inside the article, and on sections, a name of which
a listed word is only a part marks an element only while its own ratio is below the threshold. Headings, tables and quotations are never
marked by a name, sections not by an id, which is their heading as a rule.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, type_of

# HTML element names.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
          "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li",
          "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
REGIONS = {"article", "main", "section", "div", "body", "td", "aside", "nav", "header", "footer", "form", "html"}
NOT_TEXT = {"head", "script", "style", "noscript", "template", "iframe", "svg", "canvas", "audio", "video", "title",
            "nav", "footer", "aside", "button", "select", "option", "textarea", "input", "dialog", "menu"}
NEVER_NAMED = {"html", "body", "main", "article", "b", "i", "em", "strong", "a", "p", "span", "code", "h1", "h2", "h3", "h4", "h5", "h6", "table",
               "thead", "tbody", "tfoot", "tr", "th", "caption", "pre", "blockquote", "figure", "figcaption", "dl", "dt", "dd", "label"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "note"}
NAMES = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|pop|modal|overlay|newsletter|"
    r"subscri\w+|signup|login|side|sidebar|rail|menu|nav\w*|breadcrumbs?|footer|foot|header|masthead|topbar|toolbar|comments?|disqus|"
    r"respond|repl(?:y|ies)|shar(?:e|ing)|social|related|recommended|widget|pagination|pager|skip|search)(?=$|[-_\s])", re.I)
SURE = re.compile(r"(?:ads?|advert|sponsor|promo|cookies?|consent|gdpr|newsletter|comments?|disqus|respond|repl(?:y|ies)|related|recommended)(?=$|[-_])", re.I)
OF_READERS = re.compile(r"(?:comments?|disqus_thread|respond|replies)$", re.I)
MODIFIER = re.compile(r"(?:has|with|no|without)[-_]", re.I)  # says something of a layout, not what the element is
SPACE = re.compile(r"\s+")
WRAPPED, LEFT_OUT, MARKED = 1, 2, 3  # what a name does: marks no wrapper of the page, marks what the clusters leave out, always marks
ENDED_BY_NEXT = BLOCKS - {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6"}


def _name_marks(tag: str, attrs, in_article: bool) -> int:
    """The strongest of what a class or id of the element does; 0: nothing."""
    if tag == "article":
        return MARKED * any(k in ("class", "id") and v and re.search(r"(?:^|[-_\s])(?:comment|repl(?:y|ies)|advert|promo|related)", v, re.I) for k, v in attrs)
    found = WRAPPED if tag == "form" else 0
    if tag in NEVER_NAMED:
        return found
    for k, v in attrs:
        if k not in ("class", "id") or not v:
            continue
        for name in v.split():
            m = None if MODIFIER.match(name) else NAMES.search(name)
            if not m:
                continue
            if tag == "section" and k == "id":
                found = max(found, MARKED if OF_READERS.match(name) else LEFT_OUT * (not in_article))
            elif m[0] == name or k == "class" and SURE.match(name):
                found = max(found, MARKED)
            elif tag != "td":
                found = max(found, LEFT_OUT if in_article or tag == "section" else WRAPPED)
    return found


class _Lines(HTMLParser):
    """Collects (text, link characters, tags, region, state, name) for every block in page order. Regions and elements marked
    by a name are numbered in page order and know their parents, -1 at the top."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple] = []
        # element, what it holds (surely something else: 1, not read: 2), the innermost element around that a name marks
        self.open: list[tuple[str, int, int]] = []
        self.places: dict[str, list[int]] = {}  # of open elements by tag
        self.stops: dict[str, list[int]] = {"region": [], "block": []}  # and of those that an end tag does not pass
        self.name_parent: list[int] = []
        self.name_marks: list[int] = []
        self.region_parent: list[int] = []
        self.region_kind: list[str] = []
        self.around: dict[int, int] = {}  # of articles: the innermost element around that a name marks
        self.region = -1
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def inside(self, *tags: str) -> bool:
        return any(self.places.get(t) for t in tags)

    def end_line(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.lines.append((text, self.linked, self.tags, self.region, *(self.open[-1][1:] if self.open else (0, -1))))
            self.tags = 0
        self.parts, self.linked = [], 0

    def marked(self, tag: str, attrs) -> bool:
        if tag in NOT_TEXT:
            return True
        if tag == "header":
            return not self.inside("article", "main")
        return any(k == "role" and v and v.lower() in ROLES or k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in BLOCKS:
            self.end_line()
            if tag == "p" or tag == "li":  # these end where the next one begins
                self.shut(tag, "block")
        if tag in VOID:
            return
        state, outer = self.open[-1][1:] if self.open else (0, -1)
        name, marks = outer, _name_marks(tag, attrs, self.inside("article", "main"))
        if marks:
            name = len(self.name_parent)
            self.name_parent.append(outer)
            self.name_marks.append(marks)
        unread = tag in NOT_TEXT and tag not in BLOCKS or tag == "label" and self.inside("form")  # stands inside a line, which must not take its text
        state = max(state, 2 if unread else int(self.marked(tag, attrs)))
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in REGIONS:
            self.stops["region"].append(len(self.open))
            if tag in ("article", "main") and not marks:
                self.around[len(self.region_kind)] = outer
            self.region_parent.append(self.region)
            self.region_kind.append(tag)
            self.region = len(self.region_kind) - 1
        if tag in ENDED_BY_NEXT:
            self.stops["block"].append(len(self.open))
        self.open.append((tag, state, name))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        self.shut(tag, None if tag in REGIONS else "region")

    def shut(self, tag: str, stop: str | None) -> None:
        """Closes the innermost open `tag` and what is open inside it, if no element of `stop` lies between."""
        at = self.places.get(tag)
        if not at or stop and self.stops[stop] and self.stops[stop][-1] > at[-1]:
            return
        begin = at[-1]
        while len(self.open) > begin:
            gone = self.open.pop()[0]
            self.places[gone].pop()
            for places in self.stops.values():
                if places and places[-1] == len(self.open):
                    places.pop()
            if gone in REGIONS:
                self.region = self.region_parent[self.region]

    def handle_data(self, data):
        if self.open and self.open[-1][1] == 2:
            return
        self.parts.append(data)
        if self.places.get("a"):
            self.linked += len(data)


def smoothed(ratios: list[float], sigma: float) -> list[float]:
    """Gaussian-weighted mean over the neighbours that exist, three sigma to each side."""
    import numpy as np
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    pad = len(ratios) + 2 * reach
    weighted = np.convolve(np.pad(ratios, reach), kernel, "same")[reach:pad - reach]
    weight = np.convolve(np.pad(np.ones(len(ratios)), reach), kernel, "same")[reach:pad - reach]
    return (weighted / weight).tolist()


def _held(parents: list[int], own: dict[int, int]) -> list[int]:
    """For every numbered element what it and all elements inside it hold; children have larger numbers."""
    held = [own.get(n, 0) for n in range(len(parents))]
    for n in range(len(parents) - 1, 0, -1):
        if parents[n] >= 0:
            held[parents[n]] += held[n]
    return held


def _by(lines: list[tuple], column: int, value=lambda x: len(x[0])) -> dict[int, int]:
    """Characters, or another value of a line, by the element that a column names."""
    own: dict[int, int] = {}
    for x in lines:
        own[x[column]] = own.get(x[column], 0) + value(x)
    return own


def _dropping(p: _Lines, clustered: list[tuple], threshold: float) -> list[bool]:
    """For every element that a name marks: does it, or one around it, keep its lines out of the text? Wrappers of the page
    do not: what is around an article with at least half of the clustered text, or holds all of that text, or more than
    half if the name is not sure. A name that marks what the clusters leave out does not mark an element whose own ratio
    reaches the threshold."""
    total = sum(len(x[0]) for x in clustered)
    taken, in_region = _held(p.name_parent, _by(clustered, 5)), _held(p.region_parent, _by(clustered, 3))
    text, tags = (_held(p.name_parent, _by(p.lines, 5, v)) for v in (lambda x: len(x[0]) - x[1], lambda x: x[2]))
    free = [k == total or m != MARKED and k * 2 > total or m == LEFT_OUT and n >= threshold * max(1, t)
            for k, n, t, m in zip(taken, text, tags, p.name_marks)]
    for n, outer in p.around.items():
        if in_region[n] * 2 >= total:
            while outer >= 0 and free[outer] != 2:  # 2: what is around it is free already
                free[outer] = 2
                outer = p.name_parent[outer]
    out: list[bool] = []
    for n, parent in enumerate(p.name_parent):
        out.append(not free[n] or parent >= 0 and out[parent])
    return out


def clusters(lines: list[tuple], sigma: float) -> tuple[list[bool], float]:
    """Whether each line's smoothed ratio reaches the threshold, and the threshold."""
    import statistics
    ratios = smoothed([max(0, len(x[0]) - x[1]) / max(1, x[2]) for x in lines], sigma)
    threshold = statistics.pstdev(ratios)
    return [r >= threshold for r in ratios], threshold


def extract(html: str, sigma: float = 1.0) -> str:
    """Main text of one page, blocks joined by line feeds."""
    p = _Lines()
    last = html.rfind("<")
    if last > html.rfind(">") and (html[last + 1:last + 2].isalpha() or html[last + 1:last + 2] == "/"):
        html = html[:last]  # a tag that the page's end cuts off
    p.feed(html)
    HTMLParser.close(p)  # what the parser still holds back
    p.end_line()
    if not p.lines:
        return ""
    taken, threshold = clusters(p.lines, sigma)
    clustered = [x for x, c in zip(p.lines, taken) if c and not x[4]] or [x for x in p.lines if not x[4]]
    dropping = [*_dropping(p, clustered, threshold), False]  # -1: no element
    plain = [x for x in p.lines if not x[4] and not dropping[x[5]]]
    if not plain:
        return ""
    content = [x for x in clustered if not dropping[x[5]]] or plain
    # the region: an article that holds most of the content, or the innermost element that holds all of it
    held, total = _held(p.region_parent, _by(content, 3)), sum(len(x[0]) for x in content)
    articles = [n for n, kind in enumerate(p.region_kind) if kind in ("article", "main")]
    region = max(articles, key=lambda n: (held[n], n), default=-1)
    if region < 0 or held[region] * 2 < total:
        region = max((n for n, k in enumerate(held) if k == total), default=-1)
    within = [region < 0] * (len(held) + 1)  # the last one: outside of every region
    for n, parent in enumerate(p.region_parent):
        within[n] = n == region or parent >= 0 and within[parent] or region < 0
    return "\n".join(x[0] for x in plain if within[x[3]])


def main_text(files: DataFrame, sigma: float = 1.0) -> DataFrame:
    """(file_id, name, text) of HTML files (file_id, name, content): the main text of the whole content, one row per row.

    Character references are decoded, white space inside a block becomes one blank, blocks are joined by one line feed in
    page order. `content` may be a string or UTF-8 bytes (faulty bytes are replaced); null or empty content, or a page
    without text, gives the empty text. Ids and names may be null or repeat; other columns are not read.
    """
    content = F.col("content") if type_of(files, "content") == "string" else F.decode(F.col("content"), "UTF-8")
    src = files.select("file_id", "name", F.coalesce(content, F.lit("")).alias("html"))

    def work(batch):
        return {"file_id": batch.column(0), "name": batch.column(1), "text": [extract(h, sigma) for h in batch.column(2).to_pylist()]}

    return map_arrow(src, work, f"file_id {type_of(files, 'file_id')}, name string, text string")
