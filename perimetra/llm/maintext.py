"""Main text of web pages: parser events make blocks, smoothed text-to-tag ratios say where the content is, its region is taken whole."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perimetra.llm.base import rows_in

#: Blocks on each side that smoothing looks at, and the width of its bell curve in blocks.
RADIUS, SIGMA = 2, 1.0
#: A block is content if its smoothed ratio is at least this many standard deviations of all blocks' smoothed ratios.
DEVIATIONS = 1.0
#: Share of a block's text in links from which it is taken as navigation where a page does not mark its article.
LINKED = 0.6

#: Elements that start a block of their own, that hold no content, that never close, and that hold what is not main text.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNSEEN = frozenset("head script style noscript template iframe object svg math canvas audio video title".split())
_ASIDE = frozenset("nav footer aside form button select textarea option datalist menu dialog search fieldset".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ARTICLES = frozenset(["article", "main"])
#: Words in class, id and role that mark menus, notices, adverts, side matter, forms and reader comments.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner banners sponsor sponsored promo promotion promoted "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription paywall "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar topbar skip "
    "sidebar aside complementary related recommended recommendations widget widgets rail teaser "
    "footer footnav copyright legal contentinfo share sharing social "
    "comment comments commentlist disqus reply replies respond discussion "
    "search login signin signup register form".split()
)
#: Marks that count only outside an article, where a heading may stand in a header of its own.
_OUTER_MARKS = frozenset(["header", "masthead"])
#: Words by which a name tells what an element contains or lacks, not what it is.
_ABOUT = frozenset(["has", "with", "no", "without"])
#: Start tags that end an open paragraph or item without an end tag.
_ENDS_ITEM = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "option": ("option",)}
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


@dataclass
class Block:
    """One block of text: what is in it, how many tags it took, how much of it is link text, and where it stands."""

    text: str
    tags: int
    linked: int
    aside: bool
    home: int
    heading: bool

    @property
    def ratio(self) -> float:
        return 0.0 if self.aside else len(self.text) / max(1, self.tags)


class _Reader(HTMLParser):
    """Turns parser events into blocks. `home` of a block is the innermost open article or main element, 0 for none."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[tuple[str, bool, bool, int]] = []  # tag, unseen, aside, home
        self.parts: list[str] = []
        self.tags = self.linked = self.links = self.homes = 0
        self.heading = False

    def close_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, _, aside, home = self.open[-1] if self.open else ("", False, False, 0)
            self.blocks.append(Block(text, self.tags, self.linked, aside, home, self.heading))
            self.tags = 0
        self.parts, self.linked, self.heading = [], 0, False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in _VOID:
            if tag == "br":
                self.parts.append(" ")
            elif tag == "hr":
                self.close_block()
            return
        if tag in _BLOCKS or tag in _UNSEEN:
            self.close_block()
            if tag in _BLOCKS:
                self._end_open("p", _BLOCKS - {"p"})
                for other in _ENDS_ITEM.get(tag, ()):
                    self._end_open(other, {"ul", "ol", "dl", "table", "menu", "div", "article"})
        elif tag in ("td", "th"):
            self.parts.append(" ")
        elif tag == "a":
            self.links += 1
        _, unseen, aside, home = self.open[-1] if self.open else ("", False, False, 0)
        if tag in _ARTICLES:
            # an article is never part of an element around it that only looked like an advert for want of its end tag
            if aside and not any(t in _ASIDE for t, *_ in self.open) and not self._marked(attrs, True):
                aside = False
            self.homes += 1
            home = self.homes if not aside else home
        if tag == "body":
            unseen = aside = False
        unseen = unseen or tag in _UNSEEN
        if not aside and tag not in ("html", "body"):
            inside = home > 0
            aside = tag in _ASIDE or (tag == "header" and not inside) or self._marked(attrs, inside)
        self.open.append((tag, unseen, aside, home))
        if tag in _HEADINGS:
            self.heading = True

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag not in _BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in _VOID:
            return
        if tag == "a":
            self.links = max(0, self.links - 1)
        elif tag in ("td", "th"):
            self.parts.append(" ")
        if tag in _BLOCKS:
            self.close_block()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][1]:
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data)

    def _end_open(self, tag: str, border: Iterable[str]) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if self.open[i][0] in border:
                return

    @staticmethod
    def _marked(attrs: list[tuple[str, str | None]], inside: bool) -> bool:
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
            if name == "style" and value and "display:none" in value.replace(" ", "").lower():
                return True
            if name in ("class", "id", "role") and value:
                words = {w.lower() for w in _WORD.findall(value)}
                if not words & _ABOUT and (words & _MARKS or (not inside and words & _OUTER_MARKS)):
                    return True
        return False


def blocks_of(html: str) -> list[Block]:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader.close_block()
    return reader.blocks


def smoothed(values: list[float]) -> list[float]:
    """Gaussian means over the neighbourhood of each value, by the weights that lie inside."""
    bell = [math.exp(-d * d / (2 * SIGMA * SIGMA)) for d in range(RADIUS + 1)]
    out = []
    for i in range(len(values)):
        near = range(max(0, i - RADIUS), min(len(values), i + RADIUS + 1))
        out.append(sum(values[j] * bell[abs(i - j)] for j in near) / sum(bell[abs(i - j)] for j in near))
    return out


def content_of(blocks: list[Block]) -> list[Block]:
    """The blocks of the main text.

    Blocks whose smoothed ratio reaches the threshold are content. Where the page marks articles, the one with most content text is
    taken, without what inside it is marked as something else; else all between the first and the last content block but
    navigation, with a heading right before.
    """
    if not blocks:
        return []
    ratios = smoothed([b.ratio for b in blocks])
    mean = sum(ratios) / len(ratios)
    limit = DEVIATIONS * math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    content = [i for i, (b, r) in enumerate(zip(blocks, ratios)) if not b.aside and r > 0 and r >= min(limit, max(ratios))]
    if not content:
        return []
    mass: dict[int, int] = {}
    for i in content:
        mass[blocks[i].home] = mass.get(blocks[i].home, 0) + len(blocks[i].text)
    homes = {h: m for h, m in mass.items() if h}
    if homes:
        best = max(homes, key=lambda h: (homes[h], -h))
        return [b for b in blocks if b.home == best and not b.aside]
    plain = lambda b: not b.aside and b.linked <= LINKED * len(b.text)
    content = [i for i in content if plain(blocks[i])]
    if not content:
        return []
    first = content[0]
    while first > 0 and blocks[first - 1].heading and not blocks[first - 1].aside:
        first -= 1
    return [b for b in blocks[first : content[-1] + 1] if plain(b)]


def main_text(html: str | None) -> str:
    return "\n".join(b.text for b in content_of(blocks_of(html or "")))


def extracted(pages: DataFrame) -> DataFrame:
    """`(page_id, url, text)` for every row of `pages(page_id, url, html)`: the blocks of the main text in page order, joined by a line feed.

    Character references are decoded, white space inside a block becomes one space, blocks are trimmed and empty ones left out. Null and empty
    pages, and pages without content, have an empty text. Rows are neither merged nor dropped; an empty table gives none; other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_in(batches, "html"):
            texts = pa.array([main_text(h) for h in part.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), texts], ["page_id", "url", "text"])

    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return plain.mapInArrow(run, "page_id long, url string, text string")
