"""Main text of web pages, by templates deduced from the pages of a host.

A page is a set of tokens: the path of every block element that holds text, and every
block of text with its path. A token's occurrence vector says how often each page of the
host has it; equal pages of a host count once. Tokens with the same vector form an
equivalence class: those of a site, of one of its layouts, of a part that some pages
have. A class is valid if it holds elements and texts and stands on ``LEAST_PAGES`` pages
or more.

Classes are nested into a template by the tree of the page. An element all of whose text
is of its own class, at any depth, has no slot: it is template with all it holds. Paragraphs,
headings, lists, tables and the like are no such elements unless they have a name of
their own, as copies of an article share them. What is left are slots. The element whose
slots carry the most text that no other page of the host has is the main one; of a page
the best of those it holds counts. The slots of it, or of the article or main element around
it, are the main text. Without an article the slots beside it count too, up to the body,
of which texts of any valid class are left out; and so does a title of the page's own.
That an element stands in an article breaks ties, and chooses alone on hosts of fewer
pages. Where all of a main element is template, the innermost class, on the fewest
pages, is kept.

Navigation, headers, footers, sidebars, adverts, notices, forms, scripts, styles and
reader comments are no slots of a main text. Elements tell that, and names (class, id,
role) made of words for such parts alone, as one such word may be part of a slug. If
names rule out all text of a page, they count for nothing on it.

A vector is never built: pages are summed into a fingerprint per host and token (sums
of a hash of page and count), with partial sums before the shuffle, so a host may have
any number of pages. Classes are joined to the tokens of each page, so a page gets no
more of them than it holds. Html is parsed twice, for the tokens and for the text. Work
and memory are linear in a page, however deep its elements are nested.

Null or empty html has no text. A null url belongs to the host "". Repeated rows are
extracted like any other. Long pages are read whole, a batch of some megabytes at a
time. Of elements that carry equally much the one in an article counts, then the one
with more text, then the larger hash of the path. An empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import staged
from patronage.llm.urls import host_of

#: A class needs this many pages.
LEAST_PAGES = 3
ELEMENT, TEXT = 0, 1

# fixed values: elements of HTML by their role
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol
optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul""".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
NOT_MAIN = frozenset("""aside button canvas dialog footer form head iframe math menu nav noscript object select svg
template textarea title""".split())
#: Parts of a text, which hold blocks but are no frame of a main text, nor template without a name of their own.
INNER = frozenset("""blockquote caption center dd details dl dt figcaption figure hgroup li menu ol p section summary
table tbody td tfoot th thead tr ul""".split()) | HEADING
NOT_MAIN_NAMES = frozenset("""ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs
comment comments consent cookie cookies copyright disqus footer gdpr legal login masthead menu modal nav navbar
navigation newsletter notice notices overlay pager pagination popup promo promotion recommended related replies reply
search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget""".split())
#: Words that may stand beside such a one in a class without changing what it says.
PART_NAMES = frozenset("""area bar block bottom box button buttons container global icons inner left links list outer page
primary reader readers right secondary section site slot top unit user users visitor widget widgets wrapper""".split())
#: Parts of a text are ruled out by these alone, as a whole name.
STRONG_NAMES = frozenset("""ad ads advert advertisement advertising adverts comment comments cookie cookies gdpr notice
notices promo promotion replies reply sponsor sponsored""".split())
#: Inside a text these rule out by a name what they hold; the others only by a strong one.
CONTAINERS = frozenset("dl figure ol section table ul".split())
#: What an opening tag closes if it is still open, and where to stop looking.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
          "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|xmp|noembed|noframes)\b[^>]*(?:>.*?(?:</\1\b[^>]*(?:>|\Z)|\Z)|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^'">]|"[^"]*"|'[^']*')*)(?:>|\Z)"""
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[/!?][^>]*(?:>|\Z)|<(?:[a-zA-Z/!?]?)\Z", re.S | re.I)
_NAMES = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Block(NamedTuple):
    """A run of text between block elements."""

    element: int  # the element it stands in
    text: str
    slot: bool  # not in a part that never is main text
    tagged: bool  # the same, by elements alone


class Page(NamedTuple):
    """The block elements of a page in order of their opening, and its blocks."""

    blocks: list[Block]
    parents: list[int]
    paths: list[int]  # hash of the names of an element and all around it
    kinds: list[str]
    named: list[bool]  # has a class, id or role
    roots: list[int]  # the article or else main element around, or -1

    def slots(self) -> list[Block]:
        found = [block for block in self.blocks if block.slot]
        return found or [block for block in self.blocks if block.tagged]

    def token(self, block: Block) -> int:
        return xxhash.xxh64_intdigest(block.text.encode("utf-8", "surrogatepass"), self.paths[block.element])

    def holder(self, block: Block) -> int:
        """The element that a block stands in, not counting lists, tables, quotes and the like."""
        at = block.element
        while at and self.kinds[at] in INNER:
            at = self.parents[at]
        return at


class _Open(NamedTuple):
    name: str
    element: int  # this block element, or the one around
    block: bool
    outer: int  # place in the stack of the block element around
    slot: bool
    tagged: bool
    article: int
    header: bool


class _Names(NamedTuple):
    first: str = ""  # first class or id
    named: bool = False
    role: bool = False  # whether a name consists of words for parts that are no main text
    strong: bool = False  # whether one is a whole name of an advert, notice or comment
    hidden: bool = False


def _is_role(attribute: str, value: str) -> bool:
    if attribute != "class":  # an id may be a slug of a heading
        return value.lower() in NOT_MAIN_NAMES
    words = {word.lower() for word in _WORDS.findall(value)}
    return bool(words & NOT_MAIN_NAMES) and words <= NOT_MAIN_NAMES | PART_NAMES


def _named(attributes: str) -> _Names:
    first, role, strong, hidden = "", False, False, False
    for match in _NAMES.finditer(attributes):
        name = match[1].lower()
        value = match[2] or match[3] or match[4] or ""
        if name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        elif name in ("hidden", "aria-hidden"):
            hidden |= value.lower() != "false"
        else:
            first = first or (value.split() or [""])[0]
            role |= any(_is_role(name, each) for each in value.split())
            strong |= any(each.lower() in STRONG_NAMES for each in value.split())
    return _Names(first, bool(first), role, strong, hidden)


def parsed(html: str | None) -> Page:
    """The elements and blocks of a page, in one pass over its markup."""
    page = Page([], [-1], [0], [""], [False], [-1])
    stack = [_Open("", 0, True, 0, True, True, -1, False)]
    opened: Counter = Counter()
    parts: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text:
            top = stack[-1]
            heading = page.kinds[top.element] in HEADING
            seen = heading or not top.header
            page.blocks.append(Block(top.element, text, top.slot and seen, top.tagged and seen))

    def close(at: int) -> None:
        if any(each.block or not each.slot for each in stack[at:]):
            flush()
        opened.subtract(each.name for each in stack[at:])
        del stack[at:]

    at = 0
    for match in _MARKUP.finditer(html or ""):
        if match.start() > at:
            parts.append(html[at:match.start()])
        at = match.end()
        name = (match[3] or match[6] or "").lower()
        if not name:
            continue
        if name == "br" or name in VOID:
            if name in BLOCK:
                flush()
            else:
                parts.append(" " if name == "br" else "")
            continue
        block = name in BLOCK
        if match[2] or match[5]:
            i = len(stack) - 1 if opened[name] > 0 else 0
            if block and not stack[i].block:
                i = stack[i].outer  # a block element is looked for from block to block
            while i > 0 and stack[i].name != name:
                i = stack[i].outer if block else 0 if stack[i].block else i - 1
            if i > 0:
                close(i)
            continue
        if block:
            flush()
            closes, stops = CLOSES.get(name, ({"p", *HEADING}, BLOCK - HEADING - {"p"}))
            i = len(stack) - 1
            i = i if stack[i].block else stack[i].outer
            while i > 0:
                if stack[i].name in closes:
                    close(i)
                    break
                if stack[i].name in stops:
                    break
                i = stack[i].outer
        top = stack[-1]
        attributes = match[4] or match[7] or ""
        names = _named(attributes) if attributes.strip(" /") else _Names()
        ruled_out = names.strong if name in INNER and name not in CONTAINERS else names.role
        if name in ("html", "body") or name == "main" and not names.strong:
            ruled_out = False
        header = top.header or name == "header" or names.first.lower() in ("header", "page-header", "site-header")
        shut = name in NOT_MAIN or names.hidden or header and top.article < 0
        tagged = top.tagged and not shut
        slot = top.slot and not shut and not ruled_out
        if not slot and top.slot:
            flush()
        element, article = top.element, top.article
        if block:
            element = len(page.paths)
            label = f"{name}.{names.first}"
            page.parents.append(top.element)
            page.paths.append(xxhash.xxh64_intdigest(label.encode("utf-8", "surrogatepass"), page.paths[top.element]))
            page.kinds.append(name)
            page.named.append(names.named)
            # the outermost article counts, else the main element
            around = page.roots[top.element]
            article = element if name == "article" and (article < 0 or page.kinds[article] == "main") else (
                element if name == "main" and article < 0 else article)
            page.roots.append(article if article >= 0 else around)
        if not (attributes.endswith("/") and not block):
            outer = len(stack) - 1 if top.block else top.outer
            opened[name] += 1
            stack.append(_Open(name, element, block, outer, slot, tagged, article, header))
    if html and at < len(html):
        parts.append(html[at:])
    flush()
    return page


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


class _Rows:
    """Token rows of the pages of a batch."""

    def __init__(self) -> None:
        self.page, self.kind, self.token, self.holder, self.count, self.chars, self.article = ([] for _ in range(7))

    def add(self, number: int, page: Page) -> None:
        slots = page.slots()
        around: set[int] = set()
        texts: Counter = Counter()
        chars: Counter = Counter()
        holders: dict[int, tuple[int, bool]] = {}
        for block in slots:
            at = block.element
            while at >= 0 and at not in around:
                around.add(at)
                at = page.parents[at]
            token, holder = page.token(block), page.holder(block)
            texts[token] += 1
            chars[token] += len(block.text)
            holders[token] = page.paths[holder], page.roots[holder] >= 0
        paths = {page.paths[at] for at in around}
        counts = Counter(path for path in page.paths if path in paths)
        self.page += [number] * (len(counts) + len(texts))
        self.kind += [ELEMENT] * len(counts) + [TEXT] * len(texts)
        self.token += [*counts, *texts]
        self.holder += [*[0] * len(counts), *[holders[token][0] for token in texts]]
        self.count += [*counts.values(), *texts.values()]
        self.chars += [*[0] * len(counts), *[chars[token] for token in texts]]
        self.article += [*[False] * len(counts), *[holders[token][1] for token in texts]]


_TOKENS = "host string, page long, weight double, kind int, token long, holder long, count int, chars long, article boolean"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, weight, html) to a row per page and token.

    ELEMENT: the path of an element that holds text in slots, and how often the page has
    it. TEXT: such a text with its path, how often, its characters, the element that
    holds it, and whether that stands in an article or main element.
    """
    for batch in batches:
        for begin in range(0, batch.num_rows, 64):
            part = batch.slice(begin, 64)
            rows = _Rows()
            for i, html in enumerate(part.column(3).to_pylist()):
                rows.add(i, parsed(html))
            at = pa.array(rows.page, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*[part.column(i).take(at) for i in range(3)], pa.array(rows.kind, pa.int32()), _signed(rows.token),
                 _signed(rows.holder), pa.array(rows.count, pa.int32()), pa.array(rows.chars, pa.int64()),
                 pa.array(rows.article, pa.bool_())], [field.split()[0] for field in _TOKENS.split(", ")])


def templates(hosts_pages: DataFrame) -> DataFrame:
    """host, page, ``classes`` (the page's tokens of valid classes, each with class and pages) and ``main``.

    ``main`` is the element of the page whose slots carry the most text of single pages
    on the host. For hosts of ``LEAST_PAGES`` different pages or more; takes host, page (a
    hash of the html) and html, returns a row per host and page.
    """
    distinct = staged(hosts_pages.groupBy("host", "page").agg(F.count("*").alias("copies")), "distinct")
    enough = staged(distinct.groupBy("host").agg(F.count("*").alias("_n")).filter(F.col("_n") >= LEAST_PAGES)
                    .select("host"), "hosts")
    # few pages have copies; a copy weighs its share of the page
    copies = staged(distinct.filter(F.col("copies") > 1), "copies")
    weight = (1 / F.coalesce("copies", F.lit(1))).alias("weight")
    tokens = staged(hosts_pages.join(enough, "host", "left_semi").join(copies, ["host", "page"], "left")
                    .select("host", "page", weight, "html").mapInArrow(_tokens, _TOKENS), "tokens")
    hashed = F.xxhash64("page", "count")
    pages, low, high = F.col("pages"), F.col("low"), F.col("high")
    # two sums of 32 bits, as a sum of 64 would overflow
    vectors = staged(tokens.groupBy("host", "kind", "token", "holder", "article").agg(
        F.round(F.sum("weight")).cast("long").alias("pages"), F.sum(hashed.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"),
        F.sum(F.shiftrightunsigned(hashed, 32)).alias("high"),
        F.round(F.sum(F.col("chars") * F.col("weight"))).cast("long").alias("chars"))
        .withColumn("class", F.xxhash64(pages, low, high)), "vectors")
    shared = vectors.filter(pages >= LEAST_PAGES)
    valid = staged(shared.groupBy("host", "class").agg(F.count_distinct("kind").alias("_kinds")).filter("_kinds = 2")
                   .select("host", "class"), "valid")
    told = staged(shared.join(valid, ["host", "class"]).select("host", "token", "class", "pages").distinct(), "told")
    classes = staged(tokens.select("host", "page", "token").join(told, ["host", "token"]).groupBy("host", "page").agg(
        F.collect_set(F.struct("token", "class", "pages")).alias("classes")), "classes")

    texts = vectors.filter(F.col("kind") == TEXT)
    held = staged(texts.groupBy("host", "holder").agg(
        F.sum(F.when(pages < LEAST_PAGES, F.col("chars")).otherwise(0)).alias("own"),
        F.max("article").alias("article"), F.sum("chars").alias("chars")), "held")
    best = F.max(F.struct("own", "article", "chars", "holder")).alias("_best")
    main = staged(tokens.filter(F.col("kind") == TEXT).select("host", "page", "holder").join(
        held, ["host", "holder"]).groupBy("host", "page").agg(best).select("host", "page", F.col("_best.holder").alias("main")),
        "main")
    return (distinct.select("host", "page").join(main, ["host", "page"], "left").join(classes, ["host", "page"], "left")
            .select("host", "page", "classes", "main"))


class Shared(NamedTuple):
    """A token of a valid class."""

    token: int
    class_: int
    pages: int


def _roots(page: Page, slots: list[Block], main: int | None) -> list[int]:
    """The elements whose slots are the main text."""
    if main is None:
        found = {page.roots[block.element] for block in slots} - {-1}
        return sorted([at for at in found if page.kinds[at] == "article"] or found) or [0]
    places = [at for at, path in enumerate(page.paths) if path == main]
    return sorted({page.roots[at] if page.roots[at] >= 0 else at for at in places}) or [0]


def _frame(page: Page, at: int) -> int:
    """The outermost element below the body around an element that stands in no article."""
    while page.roots[at] < 0 and page.parents[at] > 0 and page.kinds[page.parents[at]] not in ("html", "body"):
        at = page.parents[at]
    return at


def _below(page: Page, roots: Iterable[int]) -> list[bool]:
    """For every element whether it is one of the roots or inside one."""
    inside = [False] * len(page.paths)
    for at in roots:
        inside[at] = True
    for at, parent in enumerate(page.parents):
        inside[at] = inside[at] or parent >= 0 and inside[parent]
    return inside


def main_blocks(page: Page, template: Iterable[Shared], main: int | None) -> list[Block]:
    """The blocks of the main text; ``template`` has the page's tokens of valid classes."""
    slots = page.slots()
    known = {shared.token: shared for shared in template}
    tokens = [page.token(block) for block in slots]
    roots = _roots(page, slots, main)
    core, around = _below(page, roots), _below(page, [_frame(page, at) for at in roots])

    # the class of all text of an element, at any depth: None without text, mixed if there are several or none
    mixed = object()
    texts_of: list = [None] * len(page.paths)

    def gather(at: int, class_) -> None:
        texts_of[at] = class_ if texts_of[at] in (None, class_) else mixed

    for block, token in zip(slots, tokens, strict=True):
        gather(block.element, known[token].class_ if token in known else mixed)
    for at in range(len(page.paths) - 1, 0, -1):
        if texts_of[at] is not None:
            gather(page.parents[at], texts_of[at])
    gone = [False] * len(page.paths)
    for at, parent in enumerate(page.parents):
        if core[at] and at not in roots:
            shared = known.get(page.paths[at])
            frame = page.named[at] or page.kinds[at] not in INNER
            gone[at] = gone[parent] or frame and shared is not None and texts_of[at] == shared.class_

    if all(gone[block.element] for block in slots if core[block.element]):
        pages = [known[token].pages if token in known else 0 for token in tokens]
        least = min((n for block, n in zip(slots, pages, strict=True) if core[block.element]), default=0)
        kept = [core[block.element] and n == least for block, n in zip(slots, pages, strict=True)]
    else:
        kept = [core[block.element] and not gone[block.element] for block in slots]
    return [block for block, token, keep in zip(slots, tokens, kept, strict=True)
            if keep or not core[block.element] and token not in known
            and (around[block.element] or page.kinds[block.element] == "h1")]


def main_text(page: Page, template: Iterable[Shared] = (), main: int | None = None) -> str:
    """The blocks of the main text, joined by empty lines."""
    return "\n\n".join(block.text for block in main_blocks(page, template, main))


def _unsigned(value: int) -> int:
    return value & 0xFFFFFFFFFFFFFFFF


def _extracted(keep: int):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, classes, main in zip(*[batch.column(keep + i) for i in range(3)], strict=True):
                shared = [Shared(_unsigned(each["token"]), each["class"], each["pages"]) for each in classes.as_py() or ()]
                number = main.as_py()
                texts.append(main_text(parsed(html.as_py()), shared, None if number is None else _unsigned(number)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(texts, pa.string())],
                                             [*batch.schema.names[:keep], "text"])
    return extract


def extracted(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """page_id, url and ``text`` of every page."""
    named = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"),
                         F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    named = named.withColumn("page", F.xxhash64("html"))
    # stored, so that Spark splits the join where one page has very many copies
    deduced = staged(templates(named.select("host", "page", "html")), "deduced")
    joined = named.join(deduced, ["host", "page"], "left").select("page_id", "url", "html", "classes", "main")
    return joined.mapInArrow(_extracted(2), "page_id long, url string, text string")
