"""Main text of web pages: parser events, text-to-tag ratios by line, smoothing and clustering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.llm.shared import slices

# Fixed values of the markup language: what has no end tag, what is not text, what begins a new line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style noscript template svg math iframe object canvas audio video select option button".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
# What may stand in a head: any other element ends it.
METADATA = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
# Elements around the content, those of them that may as well wrap it, and words of a class, id or role that mark others.
AROUND = frozenset("nav aside footer form menu dialog fieldset".split())
WRAPPERS = frozenset(["form", "fieldset"])
AROUND_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo "
    "cookie cookies copyright disqus footer form login masthead menu nav navbar navigation newsletter notice notices popup "
    "promo promotion related replies reply search share sharing sidebar signup social sponsor sponsored subscribe toolbar "
    "widget".split()
)
# Those of them that name what readers wrote.
COMMENT_WORDS = frozenset("comment comments disqus replies reply".split())
# Elements whose open paragraph, item or cell ends where another one begins.
CLOSED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
}
# Elements that end without an end tag.
IMPLIED = frozenset("p li dt dd tr td th thead tbody tfoot caption".split())
CONTAINERS = frozenset("body article main section div td blockquote center".split())
LIST_ROOTS = frozenset("ul ol dl table".split())

# Standard deviation of the Gaussian, in lines; lines of a ratio above the threshold are content.
SIGMA = 2.0
# Articles and main elements are the region of the content if they hold this share of it.
REGIONS = frozenset(["article", "main"])
SHARE = 0.9
# Running text, which is content outside the region too.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 hgroup blockquote pre".split())

_SPACE = re.compile(r"\s+")
_NAMES = re.compile(r"[a-z]+")


class Node:
    """An open or closed element.

    ``mark`` is None, or the kind of surroundings that it marks ("" if certain); ``around`` is the innermost
    marked element, ``region`` the outermost article or main element, ``prose`` the running text it stands in,
    ``depth`` the number of elements that it stands in.
    """

    __slots__ = ("tag", "parent", "depth", "hidden", "mark", "around", "ended", "article", "region", "prose")

    def __init__(self, tag: str, parent: "Node | None", hidden: bool, mark: str | None):
        self.tag, self.parent = tag, parent
        self.depth = 0 if parent is None else parent.depth + 1
        self.hidden, self.mark = hidden, mark
        self.ended = tag in IMPLIED
        self.around = self if mark is not None else parent and parent.around
        self.article = tag == "article" or (parent is not None and parent.article)
        self.region = (parent and parent.region) or (self if tag in REGIONS else None)
        self.prose = tag if tag in PROSE else parent and parent.prose

    def marks(self) -> "Iterator[Node]":
        """Marked elements that it stands in, from the innermost one."""
        mark = self.around
        while mark is not None:
            yield mark
            mark = mark.parent and mark.parent.around


class Line(NamedTuple):
    """A line of text: its tags, the innermost element that it ends in, and whether all of it is links."""

    text: str
    tags: int
    node: Node
    linked: bool


class LineParser(HTMLParser):
    """Collects lines of text (a new one at each block element) with the number of tags in each."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.node = Node("", None, False, None)
        self.open: dict[str, list[Node]] = {}  # open elements by tag, the innermost one last
        self.lines: list[Line] = []
        self._parts: list[str] = []
        self._tags = 0
        self._linked = True

    def _line(self) -> None:
        text = _SPACE.sub(" ", "".join(self._parts)).strip()
        if text:
            self.lines.append(Line(text, self._tags, self.node, self._linked))
        if text or self._tags:
            self._parts, self._tags, self._linked = [], 0, True

    def _enter(self, node: Node) -> None:
        self.node = node
        self.open.setdefault(node.tag, []).append(node)

    def _back_to(self, parent: Node) -> None:
        """Close everything within ``parent``."""
        while self.node is not parent:
            self.open[self.node.tag].pop()
            self.node = self.node.parent

    def _leave(self, node: Node) -> None:
        """Close everything within ``node`` and the element itself."""
        self._line()
        node.ended = True
        self._back_to(node.parent)

    def _innermost(self, tags: frozenset[str]) -> Node | None:
        """The innermost open element of ``tags``, found without a walk however deep the page is."""
        found = (self.open[tag][-1] for tag in tags if self.open.get(tag))
        return max(found, key=lambda node: node.depth, default=None)

    def _open(self, tags: frozenset[str], until: frozenset[str]) -> Node | None:
        """The innermost open element of ``tags``, not looking beyond one of ``until``."""
        node = self._innermost(tags)
        if node is None:
            return None
        limit = self._innermost(until)
        return node if limit is None or limit.depth <= node.depth else None

    def _end_head(self) -> None:
        head = self._innermost(frozenset(["head"]))
        if self.node.hidden and head is not None:
            self._back_to(head.parent)

    def parse_marked_section(self, i, report=1):
        """A section of unknown name is a comment up to the next ``>``, as browsers take it."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            end = self.rawdata.find(">", i + 3)
            return end + 1 if end >= 0 else len(self.rawdata)

    def handle_starttag(self, tag, attrs):
        inside = self.node.tag
        if tag == "body" or (inside == "head" and tag not in METADATA) or (inside == "title" and tag in BLOCKS):
            self._end_head()
        if self.node.hidden:
            if tag not in VOID:
                self._enter(Node(tag, self.node, True, None))
            return
        self._tags += 1
        if tag == "br":
            self._parts.append(" ")
            return
        if tag in BLOCKS:
            paragraph = self._open(frozenset(["p"]), CONTAINERS | LIST_ROOTS | AROUND)
            if paragraph:
                self._leave(paragraph)
            if tag in CLOSED_BY and (sibling := self._open(CLOSED_BY[tag], LIST_ROOTS)):
                self._leave(sibling)
            self._line()
        if tag in VOID:
            return
        hidden = tag in HIDDEN or any(name == "hidden" for name, _ in attrs)
        self._enter(Node(tag, self.node, hidden, self._mark(tag, dict(attrs))))

    def _mark(self, tag: str, attrs: dict) -> str | None:
        if (tag in AROUND and tag not in WRAPPERS) or (tag == "header" and not self.node.article):
            return ""
        if tag in ("html", "body", "main"):
            return None
        values = " ".join(attrs.get(name) or "" for name in ("class", "id", "role", "aria-label"))
        names = _NAMES.findall(values.lower())
        if tag in WRAPPERS or not AROUND_WORDS.isdisjoint(names):
            return " ".join([tag, *names])
        return None

    def handle_startendtag(self, tag, attrs):
        # A slash does not end an element that needs an end tag.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if not self.node.hidden:
            self._tags += 1
        if tag == "br":
            self._parts.append(" ")
            return
        # An inline end tag closes nothing beyond the block that it stands in.
        until = frozenset() if tag in BLOCKS or tag in HIDDEN else BLOCKS
        node = self._open(frozenset([tag]), until)
        if node is None:
            return
        if tag in BLOCKS:
            self._leave(node)
        else:
            node.ended = True
            self._back_to(node.parent)

    def handle_data(self, data):
        if self.node.tag == "head" and not data.isspace():
            self._end_head()
        if not self.node.hidden:
            self._parts.append(data)
            # Marks between links are part of a list of links.
            self._linked = self._linked and (bool(self.open.get("a")) or not any(map(str.isalnum, data)))

    def finish(self) -> list[Line]:
        self.close()
        self._line()
        return self.lines


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing, renormalised at both ends."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weighed = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    return weighed / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def clusters(values: np.ndarray) -> np.ndarray:
    """True for the values in the upper of two clusters: the threshold is the mean of both clusters' means."""
    threshold = values.mean()
    for _ in range(50):
        upper = values >= threshold
        if upper.all():
            break
        new = (values[upper].mean() + values[~upper].mean()) / 2
        if new == threshold:
            break
        threshold = new
    return values >= threshold


def ratios(lines: list[Line]) -> np.ndarray:
    return np.array([len(line.text) / max(1, line.tags) for line in lines])


def comments(kind: str) -> bool:
    """Whether a kind of surroundings names what readers wrote."""
    return not COMMENT_WORDS.isdisjoint(kind.split())


def beside_surroundings(lines: list[Line]) -> list[Line]:
    """Lines but those of surroundings.

    A navigation, footer or the like that is closed is left out.  What its class or a form marks is so too, unless
    elements of that kind hold more text of the upper ratio cluster than stands outside all marks: then they wrap the
    content.  That is not asked where another article or main element is unmarked, unless one of these or an h1
    is within, nor of readers' comments beside an unmarked article, main element, or h1 with running text.  An
    element that nothing closes marks only what comes before its first content (or all of it beside an unmarked
    article).
    """
    if all(line.node.around is None for line in lines):
        return lines
    values = ratios(lines)
    upper = clusters(smoothed(values))
    sharp = clusters(values)
    weights = [len(line.text) if content else 0 for line, content in zip(lines, upper)]
    outside = [line.node for line in lines if line.node.around is None]
    elsewhere = {node.region for node in outside if node.region}
    prose = {node.prose for node in outside}
    # An article without its comments.
    told = bool(elsewhere) or ("h1" in prose and not prose.isdisjoint(("p", "blockquote", "pre")))
    ended: set[int] = set()
    regions: dict[str, set] = {}  # of the elements of each kind
    wraps: set[str] = set()  # kinds with an h1 or an unmarked article within
    kinds: list[list[str]] = []  # of each line, from the outermost one
    for line, content, clear in zip(lines, upper, sharp):
        own, node = [], line.node
        titled = node.prose == "h1"
        for mark in node.marks():
            within = node.region is not None and node.region is not mark.region and node.region.mark is None
            if not mark.ended and id(mark) not in ended:
                alone = bool(elsewhere - {mark.region})
                if within or titled or ((clear or (content and node.prose)) and not alone):
                    ended.add(id(mark))
            if id(mark) in ended:
                continue
            if mark.mark not in own:
                own.append(mark.mark)
            regions.setdefault(mark.mark, set()).add(mark.region)
            if (within or titled) and node.around is mark:
                wraps.add(mark.mark)
        kinds.append(own[::-1])
    released: set[str] = set()
    while True:
        beside, votes = 0, {}
        for own, weight in zip(kinds, weights):
            held = [kind for kind in own if kind not in released]
            if not held:
                beside += weight
            elif "" not in held:
                for kind in held:
                    votes[kind] = votes.get(kind, 0) + weight
        wrapping = [
            kind
            for kind, weight in votes.items()
            if weight > beside and (kind in wraps or (elsewhere <= regions[kind] and not (told and comments(kind))))
        ]
        if not wrapping:
            return [line for line, own in zip(lines, kinds) if released.issuperset(own)]
        released.add(max(wrapping, key=votes.get))


def main_lines(lines: list[Line]) -> list[str]:
    """The lines of the content region.

    Lines outside surroundings whose smoothed text-to-tag ratio is in the
    upper cluster vote, by their length, for the article or main elements that they stand in.
    If these have nearly all votes, lines beyond them go that are neither in the
    upper cluster nor running text; otherwise lines of the lower cluster go that are nothing but links, as in menus.
    """
    lines = beside_surroundings(lines)
    if not lines:
        return []
    content = clusters(smoothed(ratios(lines)))
    total = sum(len(line.text) for line, upper in zip(lines, content) if upper)
    inside = sum(len(line.text) for line, upper in zip(lines, content) if upper and line.node.region)
    whole = inside < SHARE * total
    kept = []
    for line, upper in zip(lines, content):
        region = not line.linked if whole else line.node.region
        if upper or region or line.node.prose:
            kept.append(line.text)
    return kept


def page_text(html: str) -> str:
    parser = LineParser()
    parser.feed(html)
    return "\n".join(main_lines(parser.finish()))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    Blocks of the content region, each with its white space turned into single
    spaces, joined by line breaks; nothing of the region is cut.  Cases: a null or
    empty page, and one without text, give empty text; broken or unclosed
    markup is read as far as it goes: a head ends at the first element of a body, and
    marks of surroundings that wrap the content, or that nothing closes, do not hide it; rows that share an id are each read; a
    null id or url stays null; an empty table gives no rows.  Other columns of ``pages`` are
    not read.  There is no shuffle.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, urls, pages_html in slices(batches, 2):
            texts = [page_text(html) for html in pages_html]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(urls, pa.string()),
                    pa.array(texts, pa.string()),
                    pa.array(map(len, texts), pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    columns = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    )
    return columns.mapInArrow(task, "page_id long, url string, text string, n_chars long")
