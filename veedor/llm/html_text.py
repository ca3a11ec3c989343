"""Main text of HTML pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass judges a block by its length, its link
density and its share of stop words: good, bad, or open where it is short. In the second pass an
open block takes the label of its nearest decided neighbours; between neighbours that disagree it
takes that of the closer one, the good one when both are equally close. Markup decides first where
it is explicit: blocks inside navigation, headers and footers of the page, asides, forms, adverts,
notices or comment lists are bad whatever their words, and so is all outside ``article`` or
``main`` when the page has one. Inside it, few stop words leave a block open but never make it bad.

Stop words are not a list per language: they are the words of at most ``STOP_CHARS`` letters and the
fixed list below, so that any language with spaces has some.

NULL and empty pages give an empty text; broken markup is read as far as it goes (an unclosed tag or
comment ends with the page); equal rows give equal results; other columns play no part.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veedor.llm.arrays import tidy

# Element names by their role in a page.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th "
    "thead title tr ul".split()
)
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math object select button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDED_BY_NEXT = frozenset("p li td tr option dd dt".split())
APART = frozenset("nav aside footer form menu dialog head".split())
# Words of class, id and role that name what is not the article.
APART_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disclaimer disqus footer header masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination "
    "popup promo promotion recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe "
    "subscription teaser toolbar widget widgets alert search login contentinfo complementary".split()
)
# Common short words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that it for on was be with as by this from or are at "
    "de la le et les des en un une du dans que qui pour sur au par est "
    "der die und das den von zu mit sich auf ist im dem nicht ein eine "
    "el los y del se las por con no una su para es lo como".split()
)
STOP_CHARS = 2
SHORT_WORDS = 10
LONG_WORDS = 30
LOW_STOP = 0.08
HIGH_STOP = 0.15
LINK_SHARE = 0.4

_BEGIN = re.compile(r"<(?:!--|[!?]|/?(?=[a-zA-Z]))")
_NAME_END = re.compile(r"[\s/>]")
_STOP = re.compile(r"[>\"']")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORD = re.compile(r"[^\W_]+")
_NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")

GOOD, BAD, OPEN = "good", "bad", "open"


@dataclass
class TextBlock:
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    apart: bool = False
    inside: bool = False  # in article or main
    heading: bool = False

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _names(attributes: str) -> set[str]:
    found = " ".join(x.strip("\"'") for x in _NAMES.findall(attributes))
    return {x.lower() for x in _NAME_PART.findall(found)}


def _is_apart(tag: str, attributes: str, inside: bool) -> bool:
    if tag in APART or (tag == "header" and not inside):
        return True
    if not attributes or tag in ("html", "body") or (tag in ("article", "main") and not inside):
        return False
    names = APART_NAMES - {"header"} if inside else APART_NAMES
    return bool(_HIDDEN.search(attributes)) or bool(_names(attributes) & names)


class Tag(NamedTuple):
    """A tag or comment; ``name`` is empty for the latter."""

    start: int
    end: int
    closing: bool
    name: str
    attributes: str


class Tags:
    """Finds the tags of a page in one pass: a ``<`` whose tag is not closed before the page ends is text.

    ``>`` inside quotes does not close a tag. That a scan came to the end of the page is kept for every place it
    passed, outside quotes or inside either kind, so broken markup is not scanned again from each of its tags.
    """

    def __init__(self, page: str):
        self.page = page
        self.name_end = self.next_close = self.next_stop = -1
        self.dead: set[tuple[int, str]] = set()

    def after(self, at: int) -> Tag | None:
        page = self.page
        while found := _BEGIN.search(page, at):
            at, begin = found.end(), found[0]
            if begin == "<!--":
                end = page.find("-->", at)
                return Tag(found.start(), len(page) if end < 0 else end + 3, False, "", "")
            if begin in ("<!", "<?"):
                if self.next_close < at:
                    end = page.find(">", at)
                    self.next_close = len(page) if end < 0 else end
                if self.next_close < len(page):
                    return Tag(found.start(), self.next_close + 1, False, "", "")
                continue
            if self.name_end < at:
                end = _NAME_END.search(page, at)
                self.name_end = end.start() if end else len(page)
            end = self._closed(self.name_end)
            if end >= 0:
                return Tag(found.start(), end + 1, begin == "</", page[at : self.name_end], page[self.name_end : end])
        return None

    def _closed(self, at: int) -> int:
        """Where the tag is closed whose name ends at ``at``; -1 if nowhere."""
        if self.next_stop < at:  # it serves all tags that begin before it
            first = _STOP.search(self.page, at)
            self.next_stop = first.start() if first else len(self.page)
        passed, quote = [], ""
        for stop in _STOP.finditer(self.page, self.next_stop):
            place = (stop.start(), quote)
            if place in self.dead:
                break
            if not quote and stop[0] == ">":
                return stop.start()
            passed.append(place)
            if not quote:
                quote = stop[0]
            elif stop[0] == quote:
                quote = ""
        self.dead.update(passed)
        return -1


class _Open:
    """Open tags, with counts of what they mean for the text inside them."""

    def __init__(self):
        self.tags: list[tuple[str, int]] = []  # name, and since when it sets its content apart; -1: it does not
        self.since = 0
        self.places: dict[str, list[int]] = {}
        self.counts: dict[str, int] = {"apart": 0, "inside": 0, "heading": 0, "link": 0}

    def _count(self, name: str, apart: bool, step: int) -> None:
        self.counts["apart"] += step * apart
        self.counts["inside"] += step * (name in ("article", "main"))
        self.counts["heading"] += step * (name in HEADINGS)
        self.counts["link"] += step * (name == "a")

    def push(self, name: str, apart: bool) -> None:
        self.places.setdefault(name, []).append(len(self.tags))
        self.tags.append((name, self.since if apart else -1))
        self._count(name, apart, 1)

    def pop(self) -> None:
        name, since = self.tags.pop()
        self.places[name].pop()
        self._count(name, since == self.since, -1)

    def close(self, name: str) -> None:
        """Up to the innermost tag of that name; nothing if there is none."""
        if places := self.places.get(name):
            place = places[-1]
            while len(self.tags) > place:
                self.pop()

    def forget_apart(self) -> None:
        self.since += 1
        self.counts["apart"] = 0


def blocks(page: str) -> list[TextBlock]:
    """Blocks that hold text, in page order."""
    out: list[TextBlock] = []
    tags, now, at, size, articles = _Open(), TextBlock(), 0, len(page), 0
    scan = Tags(page)

    def close() -> None:
        nonlocal now
        if any(part and not part.isspace() for part in now.parts):
            out.append(now)
        count = tags.counts
        now = TextBlock(apart=count["apart"] > 0, inside=count["inside"] > 0, heading=count["heading"] > 0)

    def add(raw: str) -> None:
        if raw:
            text = html.unescape(raw)
            now.parts.append(text)
            if tags.counts["link"]:
                now.link_chars += len("".join(text.split()))

    while at < size:
        tag = scan.after(at)
        if tag is None:
            add(page[at:])
            break
        add(page[at : tag.start])
        at, name = tag.end, tag.name.lower()
        if not name:
            continue
        if name in BLOCKS:
            close()
        if tag.closing:
            tags.close(name)
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
        elif name not in VOID and not tag.attributes.endswith("/"):
            if name in ENDED_BY_NEXT and tags.tags and tags.tags[-1][0] == name:
                tags.pop()
            if name == "main" or (name == "article" and not articles):
                # what wraps the main text ("with-sidebar") says nothing about it
                tags.forget_apart()
            articles += name == "article"
            tags.push(name, _is_apart(name, tag.attributes, tags.counts["inside"] > 0))
        if name in BLOCKS:
            close()
    close()
    return out


def first_pass(block: TextBlock) -> str:
    """Label from the block alone."""
    text = block.text
    words = [w.lower() for w in _WORD.findall(text)]
    chars = len(text.replace(" ", ""))
    if block.apart or ("©" in text and not block.inside):
        return BAD
    if block.link_chars >= LINK_SHARE * chars:
        return BAD
    if block.heading or len(words) < SHORT_WORDS:
        return OPEN
    stops = sum(w in STOP_WORDS or len(w) <= STOP_CHARS for w in words) / len(words)
    if stops >= HIGH_STOP:
        return GOOD
    if len(words) < LONG_WORDS:
        return OPEN
    if stops >= LOW_STOP:
        return GOOD
    return OPEN if block.inside else BAD


def second_pass(labels: list[str]) -> list[bool]:
    """Whether each block stays; open ones follow their nearest decided neighbours."""
    n = len(labels)
    left, right, last = [n + 1] * n, [n + 1] * n, None
    before: list[str | None] = [None] * n
    after: list[str | None] = [None] * n
    for k in range(n):
        if labels[k] != OPEN:
            last = k
        if last is not None:
            left[k], before[k] = k - last, labels[last]
    last = None
    for k in reversed(range(n)):
        if labels[k] != OPEN:
            last = k
        if last is not None:
            right[k], after[k] = last - k, labels[last]
    out = []
    for k in range(n):
        if before[k] == after[k]:
            out.append(before[k] == GOOD)
        elif left[k] == right[k]:
            out.append(True)
        else:
            out.append((before[k] if left[k] < right[k] else after[k]) == GOOD)
    return out


def main_text(page: str | None) -> str:
    """Blocks of the article, joined by one line end."""
    found = blocks(page or "")
    if any(b.inside for b in found):
        found = [b for b in found if b.inside]
    labels = [first_pass(b) for b in found]
    if GOOD not in labels:  # a page of short blocks alone has no one to follow
        keep = [label != BAD for label in labels]
    else:
        keep = second_pass(labels)
    return "\n".join(b.text for b, stays in zip(found, keep) if stays)


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` without its html column and with ``out_col`` (replaced if there), row by row."""
    rest = [c for c in pages.columns if c not in (html_col, out_col)]
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row") if rest else F.lit(0).alias("row"), F.col(html_col).cast("string").alias("html"))

    def run(batches):
        for batch in batches:
            texts = pa.array([main_text(x) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["row", "text"])

    schema = rows.select("row", F.col("html").alias("text")).schema
    found = rows.mapInArrow(tidy(run), schema)
    return found.select(*(["row.*"] if rest else []), F.col("text").alias(out_col))
