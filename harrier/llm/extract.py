"""Main text of web pages by tree scoring.

Every paragraph earns points for its length and its commas and passes them to its ancestors: all to its parent, half to its
grandparent, less further up. A container's points are discounted by the share of its text that is in links. The best container
and those of its siblings that score well, or read like running text, are kept.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .common import lean, without

#: Points go to this many ancestors.
LEVELS = 4
#: Characters of a paragraph under which it earns nothing.
MIN_PARAGRAPH = 25
#: A sibling is kept if its points reach this share of the best container's.
SIBLING_SHARE = 0.2
#: A sibling paragraph of so many characters is kept below ``LINK_DENSITY``.
SIBLING_PARAGRAPH = 80
LINK_DENSITY = 0.25

OUT_SCHEMA = "title string, main_text string, main_score double, main_tag string, n_paragraphs int"

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*>?|<(?P<open>[a-zA-Z][^\s/>]*)", re.S)
_STOP = re.compile(r"[>\"']")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea iframe svg math object".split())
_DROP = frozenset("nav aside footer button select option head".split())
#: What is no text of the page even where nothing scores.
_HIDDEN = frozenset(["head"])
_BLOCK = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
_PARAGRAPH = frozenset("p td pre blockquote li dd".split())
#: Open elements that a new one of the key's kind ends.
_ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDED = frozenset(["p", *(y for x in _ENDS.values() for y in x)])
_SCOPE = frozenset("table ul ol dl select div section article main body".split())
_WHITE = re.compile(r"\s+")


@dataclass
class Page:
    title: str | None
    text: str
    score: float
    tag: str | None
    paragraphs: int


def _tag_end(source: str, at: int) -> int:
    """Where the tag ends whose name ends at ``at``; -1 if nothing ends it outside of quotes."""
    while (stop := _STOP.search(source, at)) and stop[0] != ">":
        at = source.find(stop[0], stop.end()) + 1
        if not at:
            return -1
    return stop.start() if stop else -1


def extract(source: str | None) -> Page:
    """The main text of one page; see ``main_text``."""
    if not source:
        return Page(None, "", 0.0, None, 0)
    tag, parent, end = ["#root"], [-1], [0]
    pieces: list[tuple[int, str]] = []  # the node a piece of text is in, the text
    stack = [0]
    depths: dict[str, list[int]] = {}  # where in the stack elements of a name are
    scopes = [0]  # where in the stack elements are that the ends below do not reach beyond
    title: list[str] | None = None
    title_text: str | None = None
    at = 0

    def text(raw: str) -> None:
        if title is not None:
            title.append(raw)
        elif raw:
            pieces.append((stack[-1], html.unescape(raw) if "&" in raw else raw))

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            end[node] = len(tag)
            if tag[node] in depths:
                depths[tag[node]].pop()
            while scopes[-1] >= max(len(stack), 1):
                scopes.pop()

    def end_nearest(names: tuple[str, ...]) -> None:
        depth = max((depths[x][-1] for x in names if depths.get(x)), default=0)
        if depth > scopes[-1]:
            pop_to(depth)

    size = len(source)
    loose = False  # quotes do not pair up: a tag ends at the next ">", whatever quotes are around it
    while at < size:
        lt = source.find("<", at)
        if lt < 0:
            text(source[at:])
            break
        match = _TOKEN.match(source, lt)
        if match is None:  # a plain "<"
            text(source[at : lt + 1])
            at = lt + 1
            continue
        name = match["open"]
        if name:
            gt = -1 if loose else _tag_end(source, match.end())
            if gt < 0:
                loose, gt = True, source.find(">", match.end())
            if gt < 0:  # no tag ends any more
                text(source[at:])
                break
        if lt > at:
            text(source[at:lt])
        at = gt + 1 if name else match.end()
        if name:
            name, closed = name.lower(), source[gt - 1] == "/"
            if name == "title" and title_text is None:
                title = []
                continue
            if name in _RAW and not closed:
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                at = close.end() if close else size
                continue
            if name in _BLOCK:  # a block ends an open paragraph
                end_nearest(("p",))
            if name in _ENDS:
                end_nearest(_ENDS[name])
            tag.append(name)
            parent.append(stack[-1])
            end.append(len(tag))
            if name == "br":
                pieces.append((len(tag) - 1, "\n"))
            if name not in _VOID and not closed:
                depths.setdefault(name, []).append(len(stack))
                if name in _SCOPE:
                    scopes.append(len(stack))
                stack.append(len(tag) - 1)
        elif match["close"]:
            name = match["close"].lower()
            if name == "title" and title is not None:
                title_text, title = _WHITE.sub(" ", html.unescape("".join(title))).strip(), None
                continue
            if depths.get(name):
                pop_to(depths[name][-1])
        elif match["cdata"]:
            text(match["cdata"])
    if title is not None and title_text is None:
        title_text = _WHITE.sub(" ", html.unescape("".join(title))).strip()
    pop_to(0)

    n = len(tag)
    dropped, linked = [False] * n, [False] * n
    for k in range(1, n):
        dropped[k] = dropped[parent[k]] or tag[k] in _DROP
        linked[k] = linked[parent[k]] or tag[k] == "a"
    length, links, commas, stops = [0] * n, [0] * n, [0] * n, [0] * n
    for k, raw in pieces:
        if not dropped[k]:
            own = len(_WHITE.sub(" ", raw).strip())
            length[k] += own
            commas[k] += raw.count(",") + raw.count("、") + raw.count("，")
            stops[k] += "." in raw
            if linked[k]:
                links[k] += own
    for k in range(n - 1, 0, -1):
        length[parent[k]] += length[k]
        links[parent[k]] += links[k]
        commas[parent[k]] += commas[k]
        stops[parent[k]] += stops[k]
    inside = [False] * n  # an open paragraph already holds it
    score = [0.0] * n
    paragraphs = 0
    for k in range(1, n):
        up = parent[k]
        inside[k] = inside[up] or tag[up] in _PARAGRAPH
        if tag[k] in _PARAGRAPH and not inside[k] and not dropped[k] and length[k] >= MIN_PARAGRAPH:
            paragraphs += 1
            points = 1 + commas[k] + min(length[k] / 100, 3)
            for level in range(LEVELS):
                if up <= 0:
                    break
                score[up] += points if level == 0 else points / 2 if level == 1 else points / (3 * level)
                up = parent[up]
    density = [links[k] / length[k] if length[k] else 0.0 for k in range(n)]
    final = [score[k] * (1 - density[k]) for k in range(n)]
    best = max(range(n), key=lambda k: (final[k], -k))
    if final[best] <= 0:
        best = 0
        kept = [0]
        if not length[0]:
            for k in range(1, n):
                dropped[k] = dropped[parent[k]] or tag[k] in _HIDDEN
    else:
        kept = [
            k for k in range(best if parent[best] < 0 else parent[best] + 1, n)
            if parent[k] == parent[best] and not dropped[k] and (
                k == best or final[k] >= max(10.0, SIBLING_SHARE * final[best])
                or (tag[k] == "p" and ((length[k] > SIBLING_PARAGRAPH and density[k] < LINK_DENSITY) or (0 < length[k] <= SIBLING_PARAGRAPH and links[k] == 0 and stops[k])))
            )
        ]
    home = [0] * n  # the block that an element is in
    for k in range(1, n):
        home[k] = k if tag[k] in _BLOCK else home[parent[k]]
    lines: list[list[str]] = [[]]
    ranges = iter([(k, end[k] if k else n) for k in kept])
    now = next(ranges)
    block = -1
    for k, raw in pieces:
        while now is not None and k >= now[1]:
            now = next(ranges, None)
        if now is None:
            break
        if k < now[0] or dropped[k]:
            continue
        if home[k] != block or raw == "\n" and tag[k] == "br":
            lines.append([])
            block = home[k]
        lines[-1].append(raw)
    out = [_WHITE.sub(" ", "".join(x)).strip() for x in lines]
    return Page(title_text, "\n".join(x for x in out if x), round(final[best], 6), tag[best] if best else None, paragraphs)


def main_text(pages: DataFrame) -> DataFrame:
    """Adds title, main_text, main_score, main_tag and n_paragraphs to pages and drops their html.

    A page without a scoring paragraph has score 0, no tag, and all its text outside of navigation, asides, footers
    and buttons; if there is none, all but the head's. Null and empty html give an empty text and a
    null title. Of containers with equal points the first counts. Unclosed, crossed and stray tags are taken as browsers
    would about take them, and never fail; time grows with a page's length, not faster. Every row is extracted on its own,
    repeated ones too; input columns of these names are replaced. An empty table gives an empty result.
    """
    added = StructType.fromDDL(OUT_SCHEMA)
    pages = without(pages, added.names)
    kept = [c for c in pages.columns if c != "html"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [extract(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array([x.title for x in out], pa.string()), pa.array([x.text for x in out], pa.string()), pa.array([x.score for x in out], pa.float64()), pa.array([x.tag for x in out], pa.string()), pa.array([x.paragraphs for x in out], pa.int32())],
                names=[*kept, *added.names],
            )

    return pages.mapInArrow(run, StructType([*(f for f in pages.schema.fields if f.name != "html"), *added.fields]))
