"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags; scripts, styles, forms and embedded objects hold no text. Pass one looks
at each block's length, link density and stop-word density: linked blocks are bad, long blocks with many stop words are
good, long blocks with few are bad, short blocks are ambiguous. Pass two gives an ambiguous block the label of the
nearest decided one, by distance in blocks, good of two as near.

Where a block stands is a feature: pass two looks for decided blocks of the same place (article or main element, side
part, rest of the page) before it looks at others, and inside an article a long block with few stop words is ambiguous,
not bad, as articles hold lists and tables too. A side part is an element that its tag, role, class or id names so
(sidebar, footer, notice, advert, comments): prose there is bad where the page has other text, as its density can't
tell it from the article's; short blocks there look at side parts only, and are bad where none is decided. Outside of
articles, before the first and after the last decided block, only headings, paragraphs and list items take the one
side's label.

A name doesn't count against the text it stands on: an element that is, or holds, the page's article and most of its
prose is no side part whatever it is called, and a form like that is no form.

Where no block is good, the ambiguous blocks of an article are its text; of a page without an article, its ambiguous
headings and paragraphs; of a page that is nothing but an article, all that isn't linked. A page without a single stop
word is no prose: its long blocks are bad. Stop words are those of Latin scripts: of a block in another script, length
and links alone count.

Defined results: a null or empty page has empty text; unclosed and unknown tags never fail; a page of any length is
read whole, in time proportional to it. Pages are independent, so repeated rows give repeated results; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxjoin.llm.common import STOP_WORDS, small_batches

# Tags that begin or end a block, tags of headings and paragraphs, tags without content, tags whose content is no text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
TEXT = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd blockquote pre".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
DROPPED = frozenset("button canvas datalist dialog head iframe map noembed noframes noscript object search select svg template textarea title audio video".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
# Tags and roles of side parts, words of their classes and ids (as a part, or only alone).
SIDE_TAGS = frozenset("aside footer menu".split())
SIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
SIDE_PARTS = frozenset("ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr masthead menu modal nav navbar navigation newsletter overlay pager pagination paywall popup promo promotion replies sharing sidebar sidenav signup sponsor sponsored subscribe subscription toolbar topbar widget".split())
SIDE_ALONE = frozenset("byline copyright feedback header login notice notices related respond share skip social teaser".split())

ATTRIBUTES = r"[^>=]*+(?:=[ \t\n\r\f]*+(?:\"[^\"]*\"|'[^']*')?[^>=]*+)*+"
TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)({ATTRIBUTES})(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Marks around a word.
EDGES = ".,;:!?\"'()[]{}*#%&$|<>-–—«»„“”‘’…¿¡"

#: Characters of a long block; share of a block's characters in links; share of stop words.
LONG, LINKED, DENSE = 70, 0.5, 0.12

REST, ARTICLE, SIDE = 0, 1, 2


class Block(NamedTuple):
    """Text, share of it in links, place, tag of its block element, and the side parts and forms around it by number."""

    text: str
    linked: float
    place: int
    tag: str
    within: tuple[int, ...] = ()


class Mark(NamedTuple):
    """A side part or a form: whether it stands inside an article."""

    form: bool
    inside: bool


def _side(name: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is a side part, and whether it is hidden."""
    side = name in SIDE_TAGS and not (inside and name == "menu") or name == "header" and not inside
    if not attributes.strip():
        return side, False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            for token in value.split():
                words = [w.lower() for w in CAMEL.findall(token)]
                # A paragraph of an article is told by its whole name only, as in "banner", not "banner-text".
                parts = [] if inside and name in TEXT and len(words) > 1 else words
                side = side or not SIDE_PARTS.isdisjoint(parts) or len(words) == 1 and words[0] in SIDE_ALONE and name not in TEXT
        elif key == "role":
            side = side or value.strip().lower() in SIDE_ROLES
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return side, True
    return side, False


class _Open(NamedTuple):
    """An open element: name, and what holds for all within."""

    name: str
    dropped: bool
    within: tuple[int, ...]
    link: bool
    article: bool


class _Page:
    """The open elements of a page, and its blocks so far. Each element is pushed and popped once."""

    def __init__(self):
        self.out: list[Block] = []
        self.text: list[str] = []
        self.linked: list[str] = []
        self.stack = [_Open("", False, (), False, False)]
        self.marks: list[Mark] = []
        self.holding: set[int] = set()  # marks that are or hold an article
        self.by_name: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of open block elements

    def end(self) -> None:
        if self.text:
            whole = " ".join("".join(self.text).split())
            if whole:
                share = len("".join("".join(self.linked).split())) / len(whole.replace(" ", ""))
                up = self.stack[-1]
                self.out.append(Block(whole, share, ARTICLE if up.article else REST, self.stack[self.blocks[-1]].name if self.blocks else "", up.within))
            self.text.clear()
            self.linked.clear()

    def last(self, name: str) -> int:
        """The place of the innermost open element of that name; 0 if there is none."""
        places = self.by_name.get(name)
        return places[-1] if places else 0

    def close(self, k: int) -> None:
        if self.blocks and self.blocks[-1] >= k:
            self.end()
        while len(self.stack) > k:
            self.by_name[self.stack.pop().name].pop()
        while self.blocks and self.blocks[-1] >= k:
            self.blocks.pop()

    def open(self, element: _Open) -> None:
        k = len(self.stack)
        self.stack.append(element)
        self.by_name.setdefault(element.name, []).append(k)
        if element.name in BLOCK:
            self.blocks.append(k)

    def add(self, piece: str) -> None:
        if piece and not self.stack[-1].dropped:
            piece = unescape(piece)
            self.text.append(piece)
            if self.stack[-1].link:
                self.linked.append(piece)

    def end_tag(self, name: str) -> None:
        k = self.last(name)
        # The end of an inline element doesn't reach over a block's start.
        if k and (name in BLOCK or not (self.blocks and self.blocks[-1] > k)):
            self.close(k)
        elif name in BLOCK:
            self.end()

    def start_tag(self, name: str, attributes: str) -> bool:
        """Whether the element's content is to be skipped."""
        if name == "br":
            self.add(" ")
            return False
        if name in BLOCK:
            self.end()
            if self.blocks and ((inner := self.stack[self.blocks[-1]].name) == "p" or name == inner in ("li", "dt", "dd", "tr", "td", "th", "option")):
                self.close(self.blocks[-1])
        if name in RAW:
            return True
        if name in VOID or attributes.rstrip().endswith("/") and name not in BLOCK:
            return False
        up = self.stack[-1]
        article = up.article or name in ("article", "main")
        side, hidden = _side(name, attributes, up.article) if name not in ("html", "body") else (False, False)
        within = up.within
        if side or name == "form":
            within = (*within, len(self.marks))
            self.marks.append(Mark(name == "form", up.article))
        if name in ("article", "main"):
            self.holding.update(within)
        self.open(_Open(name, up.dropped or hidden or name in DROPPED, within, up.link or name == "a", article))
        return False

    def placed(self) -> list[Block]:
        """The blocks with their places, less those of forms. Of marks that hold an article, those with most of the page's
        prose say nothing.
        """
        able = {k for k in self.holding if not self.marks[k].inside}
        void: set[int] = set()
        if able:
            prose = [len(b.text) if len(b.text) >= LONG and b.linked <= LINKED and density(b.text) >= DENSE else 0 for b in self.out]
            void = {k for k in able if 2 * sum(n for n, b in zip(prose, self.out, strict=True) if k in b.within) > sum(prose)}
        out = []
        for b in self.out:
            left = [k for k in b.within if k not in void]
            if not any(self.marks[k].form for k in left):
                out.append(b._replace(place=SIDE if left else b.place))
        return out


def blocks(page: str) -> list[Block]:
    """The blocks of a page, in order."""
    made, at = _Page(), 0
    while m := TOKEN.search(page, at):
        made.add(page[at : m.start()])
        at = m.end()
        if not (name := (m[2] or "").lower()):
            continue
        if m[1]:
            made.end_tag(name)
        elif made.start_tag(name, m[3]):
            e = RAW_END[name].search(page, at)
            at = e.end() if e else len(page)
    made.add(page[at:])
    made.end()
    return made.placed()


def density(text: str) -> float:
    """Share of stop words; 1 for a text that isn't in Latin script."""
    if not text.isascii():
        letters = [c for c in text if c.isalpha()]
        if 2 * sum(c > "\u024f" for c in letters) > len(letters):
            return 1.0
    words = text.lower().split()
    return sum(w.strip(EDGES) in STOP_WORDS for w in words) / len(words)


def decided(found: list[Block]) -> list[bool | None]:
    """Pass one: good, bad or ambiguous."""
    dense = [density(b.text) if len(b.text) >= LONG and b.linked <= LINKED else 0.0 for b in found]
    known = any(dense) or any(density(b.text) for b in found)
    other = any(b.place != SIDE and b.linked <= LINKED for b in found)
    out: list[bool | None] = []
    for b, d in zip(found, dense, strict=True):
        short = len(b.text) < LONG
        if b.linked > LINKED:
            out.append(None if b.place == ARTICLE and short and b.tag in TEXT and b.tag != "li" else False)
        elif short:
            out.append(None)
        elif b.place == SIDE and other:
            out.append(False)
        elif d >= DENSE:
            out.append(True)
        else:
            out.append(None if b.place == ARTICLE and known else False)
    return out


def _nearest(first: list[bool | None], where: list[bool]) -> list[bool | None]:
    """For each block, the label of the nearest decided one of those that ``where`` says; good of two as near."""
    n = len(first)
    far = 2 * n + 1
    best: list[tuple[int, bool | None]] = [(far, None)] * n
    for order in (range(n), range(n - 1, -1, -1)):
        gap, label = far, None
        for i in order:
            gap += 1
            if first[i] is not None and where[i]:
                gap, label = 0, first[i]
            if label is not None and (gap < best[i][0] or gap == best[i][0] and label):
                best[i] = (gap, label)
    return [label for _, label in best]


def labels(found: list[Block]) -> list[bool]:
    """Pass two: which blocks are main text."""
    first = decided(found)
    places = {b.place for b in found}
    if not any(first):
        if places == {ARTICLE}:
            return [b.linked <= LINKED for b in found]
        return [x is None and b.place != SIDE and (b.place == ARTICLE or ARTICLE not in places and b.tag in TEXT) for b, x in zip(found, first, strict=True)]
    own = {p: _nearest(first, [b.place == p for b in found]) for p in places}
    every = _nearest(first, [True] * len(found))
    sure = [i for i, x in enumerate(first) if x is not None]
    out = []
    for i, b in enumerate(found):
        label = first[i]
        if label is None:
            label = own[b.place][i]
        if label is None and b.place != SIDE:
            label = every[i]
        if first[i] is None and b.place == REST and b.tag not in TEXT and not sure[0] < i < sure[-1]:
            label = False
        out.append(bool(label))
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, good in zip(found, labels(found), strict=True) if good)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, the main text, and its length in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    small_batches(pages.sparkSession)
    picked = pages.select(*keep, F.col(html).alias("_html"))
    return picked.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name != "_html"), "text string", "n_chars long"]))
