"""Operator 4: main text from HTML by flat text blocks and a decision tree.

The markup is cut into flat text blocks at block-level tags. A block's features are its word
count and link density, those of the block before and after, and the kinds of element and
container it stands in. A decision tree (grown here, by Gini impurity, from the labelled table below)
keeps or drops it; the container is one feature among these. Kept blocks are joined in page order.

Cases: null or empty html, and pages without kept blocks, give the empty text; unclosed, stray and
mixed-up tags are tolerated; a page cut off inside an element is read to its end; ties between
splits take the first feature and the lowest threshold; equal rows are read each; other columns of
the input are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import product
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.packing import spark_schema
from threadloom.llm.work import column, slices, table, texts

# Element names of HTML by their part in a page.
BLOCK = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text: up to their end tags by the markup's reading, or by nesting.
RAW, SKIP = "script|style|title|iframe|textarea", "noscript|template|svg|math|object|canvas|audio|video|select|datalist"
OUTSIDE = set("nav footer aside button form menu dialog".split())
INSIDE = set("article main".split())
#: Words in class, id or role that tell what a container is for.
OUTSIDE_WORDS = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus disclaimer footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice overlay pagination popup promo promoted promotion related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget".split())
#: Of these, what is never a part of the article, however long its paragraphs; and others that say so.
NEVER_WORDS = set("ad ads advert adverts advertisement advertisements advertising advertorial sponsor sponsored sponsors sponsorship promo promoted promotion colophon comment comments commentlist reply replies respond disqus consent cookie cookies gdpr contentinfo copyright disclaimer footer impressum imprint legal newsletter nav navbar navigation menu menubar breadcrumb breadcrumbs".split())
#: Words that tell nothing beside another: "sponsor-box" is a sponsor's.
FILLER_WORDS = set("area bar block bottom box card container frame global group holder inner left list item items module outer page panel region right section site slot space stack top unit widget wrap wrapper zone".split())
INSIDE_WORDS = set("article body content entry main post story text".split())
#: A name that begins so tells of the layout and not of the container.
LAYOUT_WORDS = set("has no with without".split())

#: A quote opens a value only right after its equals sign; elsewhere it is a letter like others.
_ATTRIBUTES = r"(?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?+)*+"
_HIDDEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:({RAW})|(/?)({SKIP}))(?=[\s/>])({_ATTRIBUTES})>|<[!?][^>]*(?:>|\Z)", re.I | re.S)
_SELF_CLOSED = re.compile(r"(?:\A|[\s\"']|(?:\A|\s)[^\s=\"']+)/\Z")  # else the slash ends a value without quotes
_RAW_END = {x: re.compile(rf"</{x}\s*>", re.I) for x in RAW.split("|")}
_BODY = re.compile(r"<body\b", re.I)
_TAG = re.compile(rf"<(/?)([a-zA-Z][\w:-]*)({_ATTRIBUTES})(?:>|\Z)")
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
NEVER, OUT, DOUBT, NEUTRAL, IN = 0, 1, 2, 3, 4
PARA, HEADING, ITEM, OTHER = 0, 1, 2, 3


class Block(NamedTuple):
    text: str
    words: int
    links: float  # share of the words inside links
    container: int
    kind: int


FEATURES = ("container", "words", "links", "kind", "words_before", "links_before", "words_after", "links_after")

# What stands before or after a block: its words and link density.
TEXT, BIT, LINKS, EDGE = [(20, 0.0), (60, 0.0)], [(6, 0.0)], [(6, 1.0)], [(0, 0.0)]
ANY = TEXT + BIT + LINKS + EDGE
KINDS, SHORT, LONG, FEW, MANY = [PARA, HEADING, ITEM, OTHER], [2, 14], [26, 80], [0.0, 0.3], [0.6, 1.0]

# The labelled table, a line for each family of blocks: container, words, links, kinds, before, after, keep.
LABELLED = [
    # Articles: all is text, but not the lists of links that a wide wrapper holds as well.
    (IN, SHORT + LONG, FEW, KINDS, ANY, ANY, 1),
    (IN, SHORT, MANY, [PARA, HEADING], ANY, ANY, 1),
    (IN, SHORT, MANY, [ITEM, OTHER], LINKS, ANY, 0),
    (IN, SHORT, MANY, [ITEM, OTHER], TEXT + BIT + EDGE, LINKS, 0),
    (IN, SHORT, MANY, [ITEM, OTHER], TEXT + BIT + EDGE, TEXT + BIT + EDGE, 1),
    # Comments, footers, adverts and the like: nothing is text.
    (NEVER, SHORT + LONG, FEW + MANY, KINDS, ANY, ANY, 0),
    # Parts named as outside in other ways: long paragraphs among long ones are text all the same.
    (OUT, SHORT + LONG, MANY, KINDS, ANY, ANY, 0),
    (OUT, SHORT + LONG, FEW, [HEADING, ITEM, OTHER], ANY, ANY, 0),
    (OUT, [2, 14, 26, 45], FEW, [PARA], ANY, ANY, 0),
    (OUT, [80], FEW, [PARA], TEXT[1:], TEXT[1:], 1),
    (OUT, [80], FEW, [PARA], TEXT[:1] + BIT + LINKS + EDGE, ANY, 0),
    (OUT, [80], FEW, [PARA], TEXT[1:], TEXT[:1] + BIT + LINKS + EDGE, 0),
    # A listed word within a longer name: paragraphs and their headings stay, small parts go.
    (DOUBT, SHORT + LONG, MANY, KINDS, ANY, ANY, 0),
    (DOUBT, LONG, FEW, [PARA, ITEM], ANY, ANY, 1),
    (DOUBT, SHORT, FEW, [PARA], TEXT, TEXT, 1),
    (DOUBT, SHORT, FEW, [PARA], BIT + LINKS + EDGE, ANY, 0),
    (DOUBT, SHORT, FEW, [PARA], TEXT, BIT + LINKS + EDGE, 0),
    (DOUBT, SHORT, FEW, [HEADING], ANY, TEXT, 1),
    (DOUBT, SHORT, FEW, [HEADING], ANY, BIT + LINKS + EDGE, 0),
    (DOUBT, [*SHORT, 26], FEW, [OTHER], ANY, ANY, 0),
    (DOUBT, [80], FEW, [OTHER], ANY, ANY, 1),
    (DOUBT, SHORT, FEW, [ITEM], ANY, ANY, 0),
    # No container says anything: length and what stands beside it decide.
    (NEUTRAL, SHORT + LONG, MANY, KINDS, ANY, ANY, 0),
    (NEUTRAL, LONG, FEW, KINDS, ANY, ANY, 1),
    (NEUTRAL, SHORT, FEW, [HEADING, PARA], ANY, TEXT + BIT, 1),
    (NEUTRAL, SHORT, FEW, [HEADING], ANY, LINKS, 0),
    (NEUTRAL, SHORT, FEW, [HEADING], TEXT + BIT + LINKS, EDGE, 0),
    (NEUTRAL, SHORT, FEW, [PARA], TEXT + BIT + EDGE, LINKS + EDGE, 1),
    (NEUTRAL, SHORT, FEW, [PARA], LINKS, LINKS + EDGE, 0),
    (NEUTRAL, SHORT, FEW, [HEADING, OTHER], EDGE, EDGE, 1),
    (NEUTRAL, SHORT, FEW, [OTHER], ANY, TEXT, 1),
    (NEUTRAL, SHORT, FEW, [OTHER], TEXT + BIT + EDGE, BIT, 1),
    (NEUTRAL, SHORT, FEW, [OTHER], LINKS, BIT, 0),
    (NEUTRAL, SHORT, FEW, [OTHER], ANY, LINKS, 0),
    (NEUTRAL, SHORT, FEW, [OTHER], TEXT + BIT + LINKS, EDGE, 0),
    (NEUTRAL, SHORT, FEW, [ITEM], TEXT + BIT + EDGE, TEXT + BIT + EDGE, 1),
    (NEUTRAL, SHORT, FEW, [ITEM], LINKS, ANY, 0),
    (NEUTRAL, SHORT, FEW, [ITEM], TEXT + BIT + EDGE, LINKS, 0),
]


def labelled() -> list[tuple]:
    """The table's blocks: features in FEATURES' order and the label."""
    return [(container, words, links, kind, *before, *after, keep) for container, *lists, keep in LABELLED for words, links, kind, before, after in product(*lists)]


class Node(NamedTuple):
    feature: int
    at_most: float
    left: Node | bool
    right: Node | bool


def grow(rows: list[tuple], depth: int = 6) -> Node | bool:
    """A tree over rows of features and a last 0/1 label."""
    labels = [r[-1] for r in rows]
    keep = 2 * sum(labels) >= len(labels)
    if depth == 0 or len(set(labels)) == 1:
        return keep
    gini = lambda part: 2 * sum(part) * (len(part) - sum(part)) / len(part)
    best = (gini(labels) - 1e-9, -1, 0.0)
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            cost = gini([r[-1] for r in rows if r[f] <= a]) + gini([r[-1] for r in rows if r[f] > a])
            if cost < best[0] - 1e-9:
                best = (cost, f, (a + b) / 2)
    if best[1] < 0:
        return keep
    _, f, at = best
    return Node(f, at, grow([r for r in rows if r[f] <= at], depth - 1), grow([r for r in rows if r[f] > at], depth - 1))


@lru_cache(maxsize=1)
def tree() -> Node | bool:
    return grow(labelled(), 16)


def decide(node: Node | bool, row: tuple) -> bool:
    while isinstance(node, Node):
        node = node.left if row[node.feature] <= node.at_most else node.right
    return node


def _container(name: str, attributes: str, within: int) -> int:
    """NEVER holds for all inside, and OUT but for NEVER; DOUBT, a listed word in a longer name, until an article; a header inside an article is part of it."""
    if within == NEVER or name in OUTSIDE:
        return NEVER
    names = [_WORD.findall(x) for m in _NAMED.finditer(attributes) for x in (m[1] or m[2] or m[3] or "").lower().split()] if attributes else []
    names = [x for x in names if x and x[0] not in LAYOUT_WORDS]
    plain = names and name not in ("html", "head", "body", "article", "main")
    if plain and any(NEVER_WORDS.issuperset(y) for x in names if (y := [w for w in x if w not in FILLER_WORDS])):
        return NEVER
    if within == OUT or name == "header" and within != IN:
        return OUT
    if plain:
        listed = OUTSIDE_WORDS - {"header", "tags", "text"} if within == IN else OUTSIDE_WORDS
        if any(listed.issuperset(x) for x in names):
            return OUT
        if any(not (listed | NEVER_WORDS).isdisjoint(x) for x in names):
            return DOUBT
    if name in INSIDE:
        return IN
    return IN if within != DOUBT and any(not INSIDE_WORDS.isdisjoint(x) for x in names) else within


def visible(page: str) -> str:
    """The page without comments, declarations and elements whose content is no text.

    Of a self-closed element, or one without an end tag, the tag alone goes; but an open script or
    style reaches to the body or the end of the page, an open title to the next tag.
    """
    gone: list[tuple[int, int]] = []
    open_: dict[str, list[tuple[int, int]]] = {}
    endless: set[str] = set()
    at = 0
    while m := _HIDDEN.search(page, at):
        at = m.end()
        gone.append(m.span())
        raw, name = (m[1] or "").lower(), (m[3] or "").lower()
        if not (raw or name) or _SELF_CLOSED.search(m[4]):
            continue
        if name and not m[2]:
            open_.setdefault(name, []).append(m.span())
        elif name and open_.get(name):
            gone.append((open_[name].pop()[0], at))
        elif raw:
            end = None if raw in endless else _RAW_END[raw].search(page, at)
            if end:
                at = end.end()
            else:
                endless.add(raw)
                if raw in ("script", "style"):
                    at = body.start() if (body := _BODY.search(page, at)) else len(page)
                elif raw == "title":
                    at = k if (k := page.find("<", at)) >= 0 else len(page)
            gone.append((m.start(), at))
    out, done = [], 0
    for a, b in sorted(gone):
        if b > done:
            out.append(page[done:a])  # empty if a lies before
            done = b
    out.append(page[done:])
    return "".join(out)


def blocks(page: str) -> list[Block]:
    """Flat text blocks in page order; blocks without words are left out."""
    page = visible(page)
    out: list[Block] = []
    stack: list[tuple[str, int]] = []
    parts: list[str] = []
    linked, in_link, container, kind = 0, False, NEUTRAL, OTHER

    def flush() -> None:
        nonlocal linked
        words = "".join(parts).split()
        if words:
            out.append(Block(" ".join(words), len(words), min(1.0, linked / len(words)), container, kind))
        parts.clear()
        linked = 0

    def said(raw: str) -> None:
        nonlocal linked
        if raw:
            parts.append(html.unescape(raw))
            if in_link:
                linked += len(parts[-1].split())

    at = 0
    for m in _TAG.finditer(page):
        said(page[at : m.start()])
        at = m.end()
        name, closes = m[2].lower(), bool(m[1])
        if name == "a":
            in_link = not closes
        if name not in BLOCK and name not in VOID:
            if closes:
                k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
                if k >= 0 and stack[k][1] != (stack[k - 1][1] if k else NEUTRAL):
                    flush()
                if k >= 0 and not any(x in BLOCK for x, _ in stack[k + 1 :]):
                    del stack[k:]
            elif m[3] or name in OUTSIDE:
                inner = _container(name, m[3], container)
                inner = container if inner == DOUBT else inner
                if inner <= OUT and inner != container:
                    flush()
                if not m[3].endswith("/"):
                    stack.append((name, inner))
        elif name in BLOCK:
            flush()
            if closes:
                k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
                if k >= 0:
                    del stack[k:]
            elif name not in VOID:
                if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and any(x == name for x, _ in stack[-2:]):
                    del stack[max(i for i, (x, _) in enumerate(stack) if x == name) :]  # its end tag was left out
                stack.append((name, _container(name, m[3], stack[-1][1] if stack else NEUTRAL)))
        container = stack[-1][1] if stack else NEUTRAL
        last = next((x for x, _ in reversed(stack) if x in BLOCK), "")
        kind = PARA if last in ("p", "blockquote", "pre") else HEADING if re.fullmatch("h[1-6]", last) else ITEM if last in ("li", "dt", "dd", "td", "th") else OTHER
    said(page[at:])
    flush()
    return out


def rows(found: list[Block]) -> list[tuple]:
    """The features of each block, in FEATURES' order."""
    none = Block("", 0, 0.0, NEUTRAL, OTHER)
    return [(b.container, b.words, b.links, b.kind, p.words, p.links, n.words, n.links) for p, b, n in zip([none, *found], found, [*found[1:], none], strict=False)]


def main_text(page: str | None, keep: Node | bool | None = None) -> str:
    found, keep = blocks(page or ""), tree() if keep is None else keep
    return " ".join(b.text for b, r in zip(found, rows(found), strict=True) if decide(keep, r))


RESULT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame) -> DataFrame:
    keep = tree()  # grown once, at the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            got = [main_text(x, keep) for x in texts(batch, "html")]
            yield pa.RecordBatch.from_arrays([column(batch, "page_id"), column(batch, "url"), pa.array(got, pa.string()), pa.array(map(len, got), pa.int64())], schema=RESULT)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, spark_schema(RESULT))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
