"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's parser streams events; they are folded into blocks (the "lines" of a page), each with its
text, its count of tags and the element that holds it. Blocks in menus, page headers and footers,
sidebars, notices, adverts, forms, scripts and reader comments are marked by their elements. For all
other blocks the ratio of text outside links to tags is smoothed over the page with a Gaussian and split into two
clusters; the high cluster marks content regions. The main element is the article (or main) element with the most
clustered text, together with sibling articles of a third of that or more, or, on pages without one, the smallest element that
holds nearly all of it. The regions of that element are returned, whole: elements with a block in the high cluster and,
in articles, lists, tables, quotations and figures that are not mostly links.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from math import exp, log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txmon.llm.common import ROW, pack, slices, text_of, unpack

# HTML element names by role, and words in class, id and role that name page furniture.
_BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main nav noscript ol option p pre script section select style summary svg table tbody td template textarea tfoot th thead title tr ul".split())
_HOLDER = frozenset("article aside blockquote body button details dialog div dl fieldset figure footer form head header iframe main nav noscript ol section select style script svg table template textarea title ul".split())
_DROP = frozenset("aside button dialog fieldset footer form head header iframe nav noscript script select style svg template textarea title".split())
_FURNITURE = frozenset("ad ads adbox adslot advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline comment comments commentlist consent contentinfo complementary cookie cookies dialog disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain pagination paywall popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola teaser toolbar widget widgets".split())
# HTML's implied end tags: what a start tag closes, and the elements beyond which it closes nothing.
_LISTED = _HOLDER - {"div"}
_IMPLIED = {"li": (frozenset(["li"]), _LISTED), "dt": (frozenset(["dt", "dd"]), _LISTED), "dd": (frozenset(["dt", "dd"]), _LISTED),
            "td": (frozenset(["td", "th"]), frozenset(["table"])), "th": (frozenset(["td", "th"]), frozenset(["table"])), "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"]))}
_ENDS_P = frozenset("address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
_P = frozenset(["p"])
_PART = frozenset("blockquote dl figure ol table ul".split())  # parts of a text that may have few words a tag
_SOFT = frozenset(["with", "has", "no", "without", "hide", "show"])
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")

SIGMA = 1.0
_KERNEL = [exp(-k * k / (2 * SIGMA * SIGMA)) for k in range(-3, 4)]


def is_furniture(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether an element holds page furniture, by its name, role, class, id or visibility."""
    if tag in _DROP:
        return True
    if tag in ("html", "body"):
        return False
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if not value:
            continue
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
        if name in ("class", "id", "role"):
            for one in value.split():
                if one.lower() in _FURNITURE:
                    return True
                words = set(_WORDS.findall(_CAMEL.sub(" ", one).lower()))
                if tag not in ("article", "main") and words & _FURNITURE and not words & _SOFT:
                    return True
    return False


class Blocks(HTMLParser):
    """Folds parser events into blocks: [text, tags, characters in links, holder, furniture]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, int, int, bool]] = []
        self.holders: list[tuple[str, int]] = [("", -1)]  # element name and parent, by number
        self.open: list[tuple[str, int, bool]] = [("", 0, False)]  # name, number, furniture
        self.names: Counter[str] = Counter()  # of the open ones: a name that is not open is not searched for
        self.parts: list[str] = []
        self.tags = self.linked = self.in_link = 0

    def cut(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            _, holder, furniture = self.open[-1]
            self.blocks.append((text, self.tags, self.linked, holder, furniture))
            self.tags = 0
        self.parts, self.linked = [], 0

    def push(self, tag: str, number: int, furniture: bool) -> None:
        self.open.append((tag, number, furniture))
        self.names[tag] += 1

    def close_from(self, at: int) -> None:
        for tag, _, _ in self.open[at:]:
            self.names[tag] -= 1
        del self.open[at:]

    def imply_end(self, names: frozenset[str], beyond: frozenset[str]) -> None:
        """Close the innermost open element of ``names``, unless it lies beyond an element of those."""
        if not any(self.names[n] for n in names):
            return
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] in names:
                self.close_from(at)
                return
            if self.open[at][0] in beyond:
                return

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:
            self.cut()
        if tag in _ENDS_P:
            self.imply_end(_P, _HOLDER)
        if tag in _IMPLIED:
            self.imply_end(*_IMPLIED[tag])
        self.tags += 1
        if tag == "a":
            self.in_link = 1
        furniture = self.open[-1][2]
        if tag in _HOLDER or (tag not in _VOID and not furniture and attrs and is_furniture(tag, attrs)):
            if tag not in _BLOCK:
                self.cut()
            self.holders.append((tag, self.open[-1][1]))
            self.push(tag, len(self.holders) - 1, furniture or is_furniture(tag, attrs))
        elif furniture and tag not in _VOID and self.names[tag]:
            self.push(tag, self.open[-1][1], True)  # so that its end tag does not close the outer one

    def handle_startendtag(self, tag, attrs):
        if tag in _BLOCK:
            self.cut()
        self.tags += 1

    def handle_endtag(self, tag):
        if self.names[tag]:
            self.cut()
            self.close_from(next(at for at in range(len(self.open) - 1, 0, -1) if self.open[at][0] == tag))
        elif tag in _BLOCK:
            self.cut()
        self.tags += 1
        if tag == "a":
            self.in_link = 0

    def handle_data(self, data):
        self.parts.append(data)
        if self.in_link:
            self.linked += len(data.strip())

    def unknown_decl(self, data):
        pass


def smooth(values: list[float]) -> list[float]:
    reach, n = len(_KERNEL) // 2, len(values)
    out = []
    for i in range(n):
        lo, hi = max(0, i - reach), min(n, i + reach + 1)
        weights = _KERNEL[lo - i + reach:hi - i + reach]
        out.append(sum(map(float.__mul__, weights, values[lo:hi])) / sum(weights))
    return out


def split_at(values: list[float]) -> float:
    """Threshold between two clusters on a line (2-means from the extremes); the least value if they hardly differ."""
    low, high = min(values), max(values)
    if high - low < 0.7:
        return low
    for _ in range(20):
        cut = (low + high) / 2
        under, over = [v for v in values if v < cut], [v for v in values if v >= cut]
        new = (sum(under) / len(under), sum(over) / len(over))
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def add_up(sums: list[int], holders: list[tuple[str, int]]) -> None:
    """Add every element's sum to those of all elements around it; inner ones have the higher numbers."""
    for k in range(len(holders) - 1, 0, -1):
        sums[holders[k][1]] += sums[k]


def main_text(html: str) -> tuple[str, int]:
    """(text, blocks in it) of one page."""
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.cut()
    blocks, holders = parser.blocks, parser.holders
    plain = [i for i, b in enumerate(blocks) if not b[4]]
    if not plain:
        return "", 0
    ratios = [0.0 if b[4] else max(0.0, len(b[0]) - b[2]) / (b[1] + 1) for b in blocks]
    smoothed = [log1p(v) for v in smooth(ratios)]
    cut = split_at([smoothed[i] for i in plain])
    dense = [i for i in plain if smoothed[i] >= cut and 2 * blocks[i][2] <= len(blocks[i][0])] or plain
    held = [0] * len(holders)  # clustered characters in each element, its inner elements included
    for i in dense:
        held[blocks[i][3]] += len(blocks[i][0])
    add_up(held, holders)
    named = [k for k, (tag, _) in enumerate(holders) if tag in ("article", "main") and held[k]]
    whole = held[0]
    if named and (best := max(named, key=lambda k: (held[k], k))) and held[best] * 3 >= whole:
        mains, marked = {best}, True
        if holders[best][0] == "article":
            mains.update(k for k in named if holders[k] == holders[best] and held[k] * 3 >= held[best])
    else:
        mains, marked = {max(k for k in range(len(holders)) if held[k] * 20 >= whole * 17)}, False
    rich = {blocks[i][3] for i in dense} | (mains if marked else set())
    sizes, links = [0] * len(holders), [0] * len(holders)  # own and inner unmarked characters of each element, and those in links
    for i in plain:
        sizes[blocks[i][3]] += len(blocks[i][0])
        links[blocks[i][3]] += blocks[i][2]
    add_up(sizes, holders)
    add_up(links, holders)
    inside, in_part = [False] * len(holders), [False] * len(holders)  # of a main element; of a rich part below it
    for k, (tag, up) in enumerate(holders):  # parents come first
        inside[k] = k in mains or (up >= 0 and inside[up])
        in_part[k] = k not in mains and ((up >= 0 and in_part[up]) or (marked and tag in _PART and k in rich))
    kept = []
    for i in plain:
        own = blocks[i][3]
        part = in_part[own] or (marked and holders[own][0] in _PART and 2 * links[own] <= sizes[own])
        # a block that is mostly links stays inside an article's running text, where its neighbours are dense
        linked = 2 * blocks[i][2] > len(blocks[i][0])
        if inside[own] and (own in rich or part) and (not linked or (marked and own in rich and smoothed[i] >= cut)):
            kept.append(blocks[i][0])
    return " ".join(kept), len(kept)


def extract_text(pages: DataFrame, html_col: str = "html", carry: list[str] | None = None) -> DataFrame:
    """Rows of ``pages`` (``carry`` columns, default all) plus text, n_chars (code points), n_blocks.

    Null and empty pages give the empty text, pages without markup their whole text. Pages are
    independent: repeated rows, pages of any length and empty tables need nothing special. Input
    columns named like the added ones are replaced.
    """
    carry = pages.columns if carry is None else carry
    shape = pages.select(*[f"`{c}`" for c in carry]).schema
    base = pack(pages, carry, _text=text_of(html_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            found = [main_text(x) for x in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(ROW), pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()),
                 pa.array([n for _, n in found], pa.int64())], [ROW, "_main", "_chars", "_blocks"])

    schema = base.select(ROW).schema.add("_main", "string").add("_chars", "long").add("_blocks", "long")
    return unpack(base.mapInArrow(run, schema), shape, {"text": F.col("_main"), "n_chars": F.col("_chars"), "n_blocks": F.col("_blocks")})
