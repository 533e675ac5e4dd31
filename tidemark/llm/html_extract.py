"""HTML extraction by the maximum-scoring subsequence of a page's blocks.

A page is cut into blocks at block-level tags. The words of a block score by its kind (the element that holds it) and by the
marks of the elements around it (their names, and their classes, ids and roles); linked words and tags count against it. The
weights are learned from the pages that label themselves by article or main elements: kinds, marks, links and tags are weighed by
how many words they have inside of such elements and outside. One linear scan finds the contiguous run of blocks with the
greatest sum; of it, the blocks that score above zero become the text. On a page with labels, being outside of them counts
against a block as any mark does, and runs of further labelled elements are kept too.

What the task calls boilerplate (menus, headers, footers, sidebars, notices, adverts, forms, reader comments) has prior weights,
as pages seldom label it inside of an article. Boilerplate in a run counts little, so that an advert doesn't split an article.
An element that holds nearly all words of a page is a wrapper, and its marks say nothing.

Defined results: a null or empty page, and one without any text, gives an empty text; white space is what str.split() takes as
such; a tag that the end of the page cuts off is dropped; pages of any length are read whole; of runs with the same sum the
first, and of those the longest, is taken; repeated rows each get a result; without labelled pages, prior weights hold.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, spread, table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|annotation|object|title)\b[^>]*>.*?(?:</(?P=raw)\b[^>]*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Elements of HTML by what they do to the flow of text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr "
    "math menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
CLOSED_BY_ITSELF = {"p": ("p",), "li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
ARTICLE = frozenset("article main".split())
# Elements that are boilerplate by their meaning in HTML.
BOILERPLATE = frozenset("nav header footer aside form button select menu dialog head canvas audio video datalist fieldset".split())
# What the task calls boilerplate, in the words that classes, ids and roles have for it.
BOILERPLATE_WORDS = frozenset("menu nav navbar navigation header footer sidebar notice cookie ad ads advert advertisement banner promo related form comment comments reply".split())
#: Text-level elements, whose classes name a style and not a part of the page.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote dt".split())
_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

#: Kinds of blocks that get a weight of their own: by the element that holds the text.
KINDS = ("p", "h1", "h2", "h3", "li", "td", "div", "pre", "blockquote", "body", "other")
#: Weights of a mark that makes a block boilerplate: as a whole, as a part of a compound, and of a compound with "header", which
#: titles have too; and the weight from which on a mark decides.
WHOLE, PART, PART_HEADER, DECIDES = -2.5, -1.6, -0.8, -1.0
#: Words inside and outside of the labelled elements of a page that has some; boilerplate words in a run, at most.
INSIDE, OUTSIDE, DAMPED = 1.0, -1.5, -0.2
#: Share of a page's words from which on an element is a wrapper.
WRAPPER = 0.8
#: Words that a learned mark must have, and marks that a model has, at most (those with the most words).
SUPPORT, MARKS = 50, 5000


@dataclass(frozen=True)
class Weights:
    """Weights of a word by kind and by mark, of a linked word and of a tag; here, the prior ones."""

    kinds: dict[str, float] = field(
        default_factory=lambda: {"p": 1.0, "h1": 0.6, "h2": 0.6, "h3": 0.6, "li": -0.2, "td": -0.2, "div": 0.3, "pre": 0.8, "blockquote": 0.8, "body": 0.1, "other": -0.2}
    )
    marks: dict[str, float] = field(default_factory=dict)
    link: float = -0.7
    tag: float = -0.05


PRIOR = Weights()


def _prior(mark: str) -> float:
    """Weight of a mark by itself: "<name" an element's, ".word" a whole class, id or role, "~word" a part of one."""
    word = mark[1:]
    if mark[0] == "~":
        return (PART_HEADER if word == "header" else PART) if word in BOILERPLATE_WORDS else 0.0
    return WHOLE if word in (BOILERPLATE if mark[0] == "<" else BOILERPLATE_WORDS) or mark == "<hidden" else 0.0


def _marks(name: str, attrs: str) -> list[str]:
    """Marks of an element: its name if that is boilerplate, whether it is hidden, and, of containers, class, id and role."""
    found = ["<" + name] if name in BOILERPLATE else []
    for m in _ATTR.finditer(attrs) if attrs else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            found.append("<hidden")
        elif key in ("class", "id", "role") and name not in TEXT:
            for whole in value.split():
                # Numbers in ids count up from page to page.
                plain = re.sub(r"\d+", "", whole.lower())
                parts = [x.lower() for x in _PARTS.findall(whole)]
                found.append("." + plain)
                found += ["~" + x for x in parts if x != plain and x in BOILERPLATE_WORDS]
    return found


class Block:
    __slots__ = ("inside", "kind", "links", "marked", "tags", "text", "words")

    def __init__(self, text: str, kind: str, inside: bool, marked: tuple[int, ...], tags: int, links: int):
        self.text, self.kind, self.inside, self.marked, self.tags = text, kind, inside, marked, tags
        self.words = text.count(" ") + 1
        self.links = min(links, self.words)


@dataclass
class Page:
    """blocks in order; marks of the elements that have some, by number (Block.marked); those that are wrappers have none."""

    blocks: list[Block]
    marks: list[list[str]]

    def labelled(self) -> bool:
        return any(b.inside for b in self.blocks)

    def all_marks(self, b: Block) -> list[str]:
        return [m for e in b.marked for m in self.marks[e]]


def parsed(page: str) -> Page:
    found: list[Block] = []
    marks: list[list[str]] = []
    stack: list[tuple[str, bool, tuple[int, ...]]] = []  # name, inside, marked elements
    held: list[str] = []
    linked = tags = 0
    anchor = False

    def flush() -> None:
        nonlocal linked, tags
        if held:
            text = " ".join(html_lib.unescape("".join(held)).split())
            held.clear()
            if text:
                kind = next((n for n, *_ in reversed(stack) if n not in INLINE), "body")
                inside, marked = stack[-1][1:] if stack else (False, ())
                found.append(Block(text, kind if kind in KINDS else "other", inside, marked, tags, linked))
                linked = tags = 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            part = page[at : m.start()]
            held.append(part)
            if anchor:
                linked += len(part.split())
        at = m.end()
        name = m["name"]
        if name is None:
            if m["raw"]:
                if m["raw"].lower() != "annotation":  # a formula's source, in the middle of its text
                    flush()
                tags += 1
            continue
        name = name.lower()
        tags += 1
        if name == "br":
            held.append(" ")
        elif name not in INLINE:
            flush()
        if name == "a":
            anchor = not m["end"]
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if stack[i][0] in ("table", "article", "main", "body") and name in INLINE | {"p"}:
                    break
            continue
        if name in VOID:
            continue
        if name in CLOSED_BY_ITSELF:  # an open paragraph, item or cell ends here, with what it holds
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSED_BY_ITSELF[name]:
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE:
                    break
        elif name not in INLINE and stack:
            top = len(stack)
            while top and stack[top - 1][0] in INLINE:
                top -= 1
            if top and stack[top - 1][0] == "p":
                del stack[top - 1 :]
        inside, marked = stack[-1][1:] if stack else (False, ())
        own = _marks(name, m["attrs"])
        if own:
            marks.append(own)
            marked = (*marked, len(marks) - 1)
        stack.append((name, inside or name in ARTICLE or name in ("div", "section") and ".main" in own, marked))
    if page[at:]:
        held.append(page[at:])
    flush()
    total = sum(b.words for b in found)
    held_by: Counter = Counter()
    for b in found:
        for e in b.marked:
            held_by[e] += b.words
    return Page(found, [[] if held_by[e] >= WRAPPER * total and "<hidden" not in own else own for e, own in enumerate(marks)])


def word_score(page: Page, b: Block, weights: Weights, labelled: bool) -> float:
    """A word's score in a block, between -1 and 1. The strongest mark that decides counts alone."""
    known = [weights.marks.get(m) or _prior(m) for m in page.all_marks(b)]
    low = min(known, default=0.0)
    marks = low if low <= DECIDES else max(-1.0, min(1.0, sum(known)))
    place = (INSIDE if b.inside else OUTSIDE) if labelled else 0.0
    return max(-1.0, min(1.0, weights.kinds[b.kind] + marks + place))


def best_run(scores: list[float], start: int, end: int) -> tuple[float, int, int]:
    """(sum, first, end) of the contiguous run with the greatest sum; 0 if none is positive."""
    best, run, since = (0.0, start, start), 0.0, start
    for i in range(start, end):
        if run <= 0:
            run, since = 0.0, i
        run += scores[i]
        if run > best[0] or run == best[0] and run > 0 and since == best[1]:
            best = run, since, i + 1
    return best


def extract(html: str | None, weights: Weights = PRIOR) -> str:
    """The text of the best run of blocks, boilerplate left out, blocks joined by an empty line."""
    if not html:
        return ""
    page = parsed(html)
    blocks, labelled = page.blocks, page.labelled()
    gains = []
    for b in blocks:
        gains.append(b.words * word_score(page, b, weights, labelled) + b.links * weights.link)
    scores = [(g if g > 0 else max(g, DAMPED * b.words)) + b.tags * weights.tag for g, b in zip(gains, blocks)]
    chosen, open_ = [], [(0, len(blocks))]
    while open_:
        start, end = open_.pop()
        total, first, last = best_run(scores, start, end)
        # After the best run, only those of other labelled elements.
        if total > 0 and (not chosen or any(b.inside for b in blocks[first:last])):
            chosen += range(first, last)
            if labelled:
                open_ += [(start, first), (last, end)]
    return "\n\n".join(blocks[i].text for i in sorted(chosen) if gains[i] > 0)


def _odds(inside: float, outside: float) -> float:
    return 0.5 * math.log((inside + 1) / (outside + 1))


def counted(html: str | None) -> Iterator[tuple[str, str, bool, int]]:
    """(what, name, inside, words) of a labelled page: of its kinds, marks, links and tags. Blocks that a prior mark decides
    tell nothing about the others."""
    page = parsed(html or "")
    if page.labelled():
        for b in page.blocks:
            marks = page.all_marks(b)
            if min(map(_prior, marks), default=0.0) > DECIDES:
                yield "kind", b.kind, b.inside, b.words
                yield "link", "", b.inside, b.links
                for m in {m for m in marks if m[0] == "."}:
                    yield "mark", m, b.inside, b.words
            yield "word", "", b.inside, b.words
            yield "tag", "", b.inside, b.tags


def learned(counts: dict[tuple[str, str, bool], int]) -> Weights:
    """Half the log odds that words are inside, within bounds; prior weights of what no labelled page has."""
    if not any(what == "word" and inside for what, _, inside in counts):
        return PRIOR
    of = lambda what, name: (counts.get((what, name, True), 0), counts.get((what, name, False), 0))
    kinds = {k: max(-1.0, min(1.0, _odds(*of("kind", k)))) if any(of("kind", k)) else w for k, w in PRIOR.kinds.items()}
    marks = {n: max(WHOLE, min(1.0, _odds(*of("mark", n)))) for n in {n for what, n, _ in counts if what == "mark"} if sum(of("mark", n)) >= SUPPORT and not _prior(n)}
    link = PRIOR.link
    if any(of("link", "")):
        rate = lambda k: (of("link", "")[k] + 1) / (of("word", "")[k] + 2)
        link = max(-1.0, min(PRIOR.link / 2, 0.5 * math.log(rate(0) / rate(1))))
    dense = lambda k: (of("tag", "")[k] + 1) / (of("word", "")[k] + 1)
    return Weights(kinds, marks, link, -0.02 * max(0.5, min(5.0, math.log(max(dense(1) / dense(0), 1.0)))))


def fit_weights(pages: DataFrame, html_col: str = "html") -> Weights:
    """Weights from all pages that have an article or main element."""

    def count(rows: Iterator[tuple]) -> Iterator[tuple]:
        totals: Counter = Counter()
        for (page,) in rows:
            for what, name, inside, n in counted(page):
                totals[what, name, inside] += n
        for key, n in totals.items():
            yield (*key, n)

    rows = map_rows(pages.select(html_col), "what string, name string, inside boolean, n long", count).groupBy("what", "name", "inside").agg(F.sum("n").alias("n"))
    # All but marks are a few dozen rows; of marks, the most frequent ones.
    rows = rows.orderBy(F.col("what") == "mark", F.desc("n"), "name", "inside").limit(2 * MARKS)
    return learned({(r.what, r.name, r.inside): r.n for r in rows.collect()})


def extract_pages(pages: DataFrame, weights: Weights, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text and n_chars of each page; a kept column of one of these names gives way to it."""
    keep = tuple(k for k in keep if k not in ("text", "n_chars"))
    types = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for *kept, page in rows:
            text = extract(page, weights)
            yield (*kept, text, len(text))

    return map_rows(pages.select(*keep, html_col), "".join(f"`{k}` {types[k]}, " for k in keep) + "text string, n_chars long", run)


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return extract_pages(pages, fit_weights(pages))
