"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element. Lines of menus, headers, footers, sidebars, notices, adverts, forms and
reader comments weigh nothing, as do lines that are mostly link text. A page's marked article is trusted if its highest window
sum is at least half of that of the lines outside; then lines outside weigh nothing either. The weights, lengths of text, are
summed over windows of WINDOW lines. Text is kept from each surge, where the sums rise from zero, to the next dive, where they
fall back to zero, if they peak between the two at THRESHOLD or more, or at half of the page's highest peak if that is less -
so a page of short lines keeps its largest part. Without a trusted article, headings and paragraphs that stand in one element
with a kept line are kept too, be they short, apart or mostly links.

Inside what is kept nothing is dropped or capped. Character references are decoded, white space inside a line becomes one
space, and lines are joined by a newline in page order. Defined results: null or empty html gives the empty text; cut-off
markup ends with the page; repeated rows give repeated rows; null keys are kept.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenuria.llm.frames import slices

WINDOW, THRESHOLD = 3, 86
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>|([^<]+|<)""", re.S | re.I)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: Elements that break lines, that are never main text, and the names sites give such parts.
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NEVER = frozenset("nav footer aside form head menu select button dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored banner menu nav navbar navigation sidebar cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended comment comments disqus breadcrumb breadcrumbs footer pagination pager promo promotion widget login toolbar masthead topbar".split())
MAIN = frozenset(("article", "main"))
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())


class Line(NamedTuple):
    text: str
    hidden: bool
    linked: bool  # mostly link text
    inside: bool  # of an article
    paragraph: bool
    container: int  # the element that holds the paragraph, or else the line


def hides(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element and all in it are no main text."""
    if tag in NEVER or tag == "header" and not inside:
        return True
    if not attributes or tag in MAIN or tag in ("body", "html"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id") and not NAMES.isdisjoint(re.split(r"[^a-z0-9]+", value)):
            return True
        if name == "role" and value in ROLES or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|$)", ATTRIBUTE.sub("", attributes), re.I))


def lines(page: str) -> tuple[list[Line], bool]:
    """All lines, empty ones where they are hidden; whether the page marks an article."""
    out: list[Line] = []
    stack: list[tuple[str, bool, int]] = []
    text: list[str] = []
    linked = hidden = inside = link = opened = 0
    marked = False

    def end() -> None:
        nonlocal linked
        line = " ".join(entities.unescape("".join(text)).split())
        if line or hidden:
            paragraph = bool(stack) and stack[-1][0] in PARAGRAPHS
            holder = stack[:-1] if paragraph else stack
            out.append(Line(line, hidden > 0, linked > len(line) / 2, inside > 0, paragraph, holder[-1][2] if holder else 0))
        text.clear()
        linked = 0

    def drop(at: int) -> None:
        nonlocal hidden, inside
        for tag, hides_, _ in stack[at:]:
            hidden -= hides_
            inside -= tag in MAIN
        del stack[at:]

    for m in TOKEN.finditer(page):
        words = m[5]
        if words is not None:
            text.append(words)
            linked += len(words.strip()) if link else 0
            continue
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag == "a":
            link = 0 if m[2] else 1
        elif tag == "br":
            text.append(" ")
        if tag in BLOCK:
            end()
            link = 0
        if tag in VOID:
            continue
        if m[2]:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if at >= 0:
                if tag not in BLOCK and stack[at][1]:
                    end()
                drop(at)
        else:
            if tag in BLOCK and stack and stack[-1][0] == "p":
                drop(len(stack) - 1)
            hide = hides(tag, m[4] or "", inside > 0)
            if tag in BLOCK or hide:
                if hide and tag not in BLOCK:
                    end()
                opened += 1
                stack.append((tag, hide, opened))
                hidden += hide
                inside += tag in MAIN
                marked |= tag in MAIN and not hidden
    end()
    return out, marked


def sums(weight: np.ndarray) -> np.ndarray:
    """Sums of weight over windows of WINDOW lines that begin before, in or at the end of the lines."""
    padded = np.append(np.zeros(WINDOW), np.append(weight, np.zeros(WINDOW)))
    return np.convolve(padded, np.ones(WINDOW), "full")[WINDOW - 1 :][: len(padded)]


def surges(weight: np.ndarray) -> list[int]:
    """Places of the lines with weight between the surges and dives that peak high enough."""
    # A gap narrower than a window, such as one advert between two paragraphs, does not part the text.
    total = sums(weight)
    edge = np.flatnonzero(np.diff((total > 0).astype(np.int8)))
    least = min(THRESHOLD, total.max() / 2)
    keep: set[int] = set()
    for surge, dive in zip(edge[::2] + 1, edge[1::2] + 1, strict=False):
        if total[surge:dive].max() >= least:
            keep.update(range(max(0, surge - WINDOW), min(dive, len(weight))))
    return [i for i in sorted(keep) if weight[i] > 0]


def main_text(page: str) -> str:
    found, marked = lines(page)
    if marked:
        # Lines outside stay as empty ones, which part articles; what is hidden in an article leaves the text around it together.
        rows = [x for x in found if not (x.inside and x.hidden)]
        inside = np.array([len(x.text) if x.inside else 0 for x in rows], float)
        outside = np.array([0 if x.inside or x.hidden or x.linked else len(x.text) for x in rows], float)
        if 2 * sums(inside).max() >= sums(outside).max():
            return "\n".join(rows[i].text for i in surges(inside))
    rows = [x for x in found if x.text and not x.hidden]
    kept = set(surges(np.array([0 if x.linked else len(x.text) for x in rows], float)))
    holders = {rows[i].container for i in kept}
    return "\n".join(x.text for i, x in enumerate(rows) if i in kept or x.paragraph and x.container in holders)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text: the main text of every page."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce("html", F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "html"):
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([main_text(h) for h in some.column(2).to_pylist()], pa.string())], ["page_id", "url", "text"])

    return own.mapInArrow(run, "page_id long, url string, text string")
