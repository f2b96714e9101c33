"""Main text of web pages: parser events to lines, text-to-tag ratios, Gaussian smoothing, threshold clusters."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the markup language: elements without an end tag, elements that break a line, elements whose content is no text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td "
    "tfoot th thead title tr ul".split()
)
SILENT = frozenset("script style template noscript iframe object svg math canvas audio video title select textarea button".split())
#: Elements, roles and words of class or id that make main text less likely.
ASIDE = frozenset("nav footer header aside form menu dialog".split())
MARKS = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|ccpa|notices?|popup|modal|newsletter|subscribe|share|sharing|"
    r"social|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|footer|masthead|comments?|respond|replies|related|recommended|"
    r"widgets?|pagination|pager|toolbar|login|signup|search"
)
#: Words that leave a mark a mark when they stand in one class or id with it, as in site-footer.
BESIDE_MARKS = frozenset("site page top bottom left right box list bar primary secondary global".split())
#: An article or main element is marked only as a reader's comment.
COMMENT = re.compile(r"comments?|replies|reply|respond")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Factors on the ratios of lines in an article or main element, and in a marked element.
MAIN_PRIOR, ASIDE_PRIOR = 4.0, 0.05
#: A paragraph ends where one of these begins.
CLOSES_P = BLOCKS - {"br", "body", "html", "head", "option", "summary", "td", "th", "tr", "caption", "tbody", "thead", "tfoot"}

SIGMA = 1.0
SPACE = re.compile(r"\s+")


def marked(names: str, words: re.Pattern) -> bool:
    """Whether one of the blank-separated ``names`` is made of ``words`` as a whole: cookie-notice, not related-work."""
    for name in names.lower().split():
        parts = [part for part in re.split("[_-]+", name) if part]
        found = [words.fullmatch(part) is not None for part in parts]
        if any(found) and all(hit or part in BESIDE_MARKS for part, hit in zip(parts, found)):
            return True
    return False


class Line(NamedTuple):
    """A run of text between block borders."""

    text: str
    tags: int
    linked: int  # characters in links
    node: int  # innermost marked, article or main element, 0 for none
    block: int  # innermost block element, 0 for none


class Node(NamedTuple):
    """A marked element, or an article or main element (``main``), with the one around it."""

    main: bool
    parent: int


class Lines(HTMLParser):
    """Turns a page into lines, with the elements that say something about them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.nodes = [Node(False, 0)]
        self.blocks: list[tuple[int, bool]] = [(0, True)]  # the block around, whether it is the whole page
        self.open: dict[int, tuple[str, bool, int, int]] = {}  # by order of opening: tag, silent, node or 0, block or 0
        self.opened = 0
        self.by_tag: dict[str, list[int]] = {}  # open elements of each tag
        self.around: list[tuple[int, int]] = []  # open blocks: place in ``open``, number
        self.within: list[int] = []  # nodes, from the top only down to the innermost open one
        self.closed: set[int] = set()  # of these, nodes that are closed
        self.silent = self.anchors = self.mains = 0
        self.text: list[str] = []
        self.tags = self.linked = 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![...`` up to ``]]>`` where it opens character data, else up to ``>``: passed over, as browsers do."""
        data = "<![CDATA["
        end = "]]>" if self.rawdata.startswith(data, i) and self.rawdata.find("]]>", i) >= 0 else ">"
        at = self.rawdata.find(end, i)
        return at + len(end) if at >= 0 else -1

    def block(self) -> int:
        """The innermost open block."""
        return self.around[-1][1] if self.around else 0

    def node(self) -> int:
        """The innermost open node."""
        while self.within and self.within[-1] in self.closed:
            self.closed.discard(self.within.pop())
        return self.within[-1] if self.within else 0

    def cut(self) -> None:
        text = SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append(Line(text, self.tags, self.linked, self.node(), self.block()))
            self.tags = 0
        self.text = []
        self.linked = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.cut()
        self.tags += 1
        if tag == "p" or tag in CLOSES_P:
            self.end_paragraph()
        if tag == "a":
            self.anchors = int(any(k == "href" for k, _ in attrs))
        if tag in VOID:
            return
        facts = dict(attrs)
        in_main = self.mains > 0
        names = facts.get("class") or ""
        # In an article, the id of a heading or section is its subject.
        if not (in_main and (tag == "section" or tag in HEADINGS)):
            names += " " + (facts.get("id") or "")
        # A page header is no main text; a heading group inside an article is.
        aside = tag in ASIDE and not (tag == "header" and in_main)
        aside = aside or (facts.get("role") or "").lower() in ROLES
        aside = aside or tag not in ("html", "body") and marked(names, COMMENT if tag in MAIN else MARKS)
        node = block = 0
        if tag in BLOCKS:
            block = len(self.blocks)
            self.blocks.append((self.block(), tag in ("html", "body")))
        if aside or tag in MAIN:
            node = len(self.nodes)
            self.nodes.append(Node(not aside, self.node()))
            self.within.append(node)
            self.mains += not aside
        entry = (tag, tag in SILENT or "hidden" in facts, node, block)
        self.opened += 1
        self.open[self.opened] = entry
        self.by_tag.setdefault(tag, []).append(self.opened)
        if block:
            self.around.append((self.opened, block))
        self.silent += entry[1]

    def end_paragraph(self) -> None:
        """Close an open paragraph, unless a block stands between."""
        if self.around and self.open[self.around[-1][0]][0] == "p":
            self.shut(self.around[-1][0])

    def shut(self, at: int) -> None:
        """Close one element; it is the innermost of its tag, and the innermost block if it is one."""
        tag, silent, node, block = self.open.pop(at)
        self.by_tag[tag].pop()
        self.silent -= silent
        if block:
            self.around.pop()
        if node:
            self.closed.add(node)
            self.mains -= self.nodes[node].main

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.cut()
        self.tags += 1
        if tag == "a":
            self.anchors = 0
        if not self.by_tag.get(tag):
            return
        at = self.by_tag[tag][-1]
        if tag in BLOCKS or tag in SILENT:
            while next(reversed(self.open)) > at:
                self.shut(next(reversed(self.open)))
        # An inline end tag does not close the blocks around it.
        self.shut(at)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.text.append(data)
            if self.anchors:
                self.linked += len(data)


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """``values`` under a Gaussian window that is normalised at both ends."""
    reach = max(1, math.ceil(3 * sigma))
    window = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        low, high = max(0, i - reach), min(len(values), i + reach + 1)
        weights = window[low - i + reach : high - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[low:high])) / sum(weights))
    return out


def content(ratios: list[float], factors: list[float]) -> list[bool]:
    """Lines whose smoothed ratio reaches the threshold, the smoothed ratios' standard deviation.

    Each ratio counts ``factors`` times. A line of less than the greatest factor must reach the threshold
    without its neighbours, too.
    """
    ratios, top = [r * f for r, f in zip(ratios, factors)], max(factors)
    smooth = smoothed(ratios)
    mean = sum(smooth) / len(smooth)
    threshold = math.sqrt(sum((v - mean) ** 2 for v in smooth) / len(smooth))
    return [v >= threshold and (f == top or r >= threshold) for v, r, f in zip(smooth, ratios, factors)]


def priors(lines: list[Line], nodes: list[Node]) -> tuple[list[bool], list[int], list[float]]:
    """Per node: whether its lines are aside, its outermost article or main element (0: none), and the factor on their ratios.

    An element with more than half of the page's characters is its frame, however it is marked, unless an
    article or main element with text stands beside it. An article or main element inside a marked one is not
    aside, but not likelier than other text either.
    """
    held, of_main, in_main = [0] * len(nodes), [0] * len(nodes), [False]
    for node in nodes[1:]:
        in_main.append(node.main or in_main[node.parent])
    for line in lines:
        held[line.node] += len(line.text)
        of_main[line.node] += len(line.text) * in_main[line.node]
    for k in range(len(nodes) - 1, 0, -1):
        held[nodes[k].parent] += held[k]
        of_main[nodes[k].parent] += of_main[k]
    total, of_mains = held[0], of_main[0]
    aside, main, factor = [False], [0], [1.0]
    for k in range(1, len(nodes)):
        up = nodes[k].parent
        if nodes[k].main:
            aside.append(False)
            main.append(main[up] if main[up] and not aside[up] else k)
            factor.append(1.0 if aside[up] or main[up] and factor[up] == 1.0 else MAIN_PRIOR)
        else:
            frame = 2 * held[k] > total and (in_main[k] or of_main[k] == of_mains)
            aside.append(aside[up] or not frame)
            main.append(main[up])
            factor.append(ASIDE_PRIOR if aside[k] else factor[up])
    return aside, main, factor


def common_block(a: int, b: int, blocks: list[tuple[int, bool]]) -> int:
    """The innermost block around both; a block has a greater number than the one around it."""
    while a != b:
        if a > b:
            a = blocks[a][0]
        else:
            b = blocks[b][0]
    return a


def main_lines(lines: list[Line], nodes: list[Node], blocks: list[tuple[int, bool]]) -> list[str]:
    """The lines of the content regions, in page order.

    Lines are clustered by their ratios, which markup raises or lowers. A region is an article or main
    element with content lines in it; the content lines outside of these make one more, which is the
    innermost block around them. A region yields its content lines, all lines between them that are not
    aside, and before the first and after the last those that are neither aside nor mostly links; where the
    region is the whole page, only as far as the next line of another kind.
    """
    if not lines:
        return []
    asides, mains, factors = priors(lines, nodes)
    aside = [asides[line.node] for line in lines]
    good = content([len(line.text) / max(1, line.tags) for line in lines], [factors[line.node] for line in lines])
    if not any(good):
        return [line.text for line, a in zip(lines, aside) if not a]
    region = [mains[line.node] for line in lines]
    span: dict[int, list[int]] = {}  # first and last content line by region
    for i, chosen in enumerate(good):
        if chosen:
            span.setdefault(region[i], [i, i])[1] = i
    keep = good[:]
    for i, r in enumerate(region):
        if r in span and span[r][0] < i < span[r][1] and not aside[i]:
            keep[i] = True

    plain = [not a and 2 * line.linked <= len(line.text) for line, a in zip(lines, aside)]
    for i, r in enumerate(region):
        if r in span and r and not span[r][0] <= i <= span[r][1]:
            keep[i] = plain[i]
    if 0 in span:
        around = common_block(lines[span[0][0]].block, lines[span[0][1]].block, blocks)
        inside: list[bool] = []
        for k, (up, _) in enumerate(blocks):
            inside.append(k == around or k > around and inside[up])
        for way in (range(span[0][0] - 1, -1, -1), range(span[0][1] + 1, len(lines))):
            for i in way:
                if not region[i] and inside[lines[i].block] and plain[i]:
                    keep[i] = True
                elif blocks[around][1]:
                    break
    return [line.text for line, kept in zip(lines, keep) if kept]


def main_text(html: str | None) -> str:
    """Main text of one page: blocks in page order, white space inside each turned into one space, joined by one space."""
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    parser.cut()
    return " ".join(main_lines(parser.lines, parser.nodes, parser.blocks))


def _extract(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py()) for html in batch.column(column)]
            names = [c for c in batch.schema.names if c != column]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*names, "text", "n_chars"],
            )

    return run


def extract_text(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """Columns ``keep`` with ``text`` and ``n_chars`` (code points) of every page's main text.

    Whole pages are parsed, one at a time; a page of any size needs memory in proportion to itself. Null
    and empty pages, and pages without text, give an empty text. Broken markup is read as browsers do in
    the main: unclosed paragraphs end at the next block, unknown end tags and odd declarations are passed over. Time grows in
    proportion to the page, however deep it is nested. Columns of
    ``keep`` named like ``html``, text or n_chars are left out. Repeated rows stay repeated.
    """
    keep = [c for c in keep if c not in (html, "text", "n_chars")]
    rows = pages.select(*keep, html)
    kept = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != html)
    return rows.mapInArrow(_extract(html), f"{kept}, text string, n_chars long")
