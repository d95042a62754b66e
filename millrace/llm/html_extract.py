"""Main text of web pages, with removal of site templates.

Pages are parsed to a light tree. Every element subtree has a digest of its tags and text, and a shape: its place below the
body, tags, class words, and the shapes of its children, runs of like ones as one, without any text. Spark counts both for each host
over distinct pages (pages of equal tags and text are one page, however many rows have it). A block belongs to the site's template if

- its digest is on LEAST_PAGES pages and a SHARE of the host's pages, or, of containers outside the article, on MANY_PAGES pages; or
- its shape is on LEAST_PAGES pages and a SHARE of them, outside the article, is a small part of a page's text, and is mostly links, or has
  few different texts for its pages.

Running text inside an article (paragraphs, headings, quotes, ...) is never template, however often a site repeats it: it is content
that was copied. What says by its tag or role that it is no main text (nav, footer, form, ...) goes at once. Words in class and id
are a help only: all parts of a class must be known, and what holds the article, or most of the text of a page without one, stays, unless it is comments. If
articles hold at least half of what is left, only they are read.

Templates are broadcast if all hosts together have at most BROADCAST of them; beyond that subtrees and templates are joined on host
and digest, so that neither a host's templates nor its pages meet in one task.

Defined results: null or empty html gives an empty text; a null or odd url
is a host of its own ("") without templates; repeated rows repeat; an empty table gives an empty result; broken or
cut-off markup is read as far as it goes.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, slices, table, written

LEAST_PAGES = 5
MANY_PAGES = 8
SHARE = 0.3
#: Of a shape: the part of a page's text that it takes at most, the part that is links at least, and different texts for each page at most.
PART, LINKS, VARIETY = 0.3, 0.6, 0.25
BROADCAST = 50_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Elements that end a block before and after themselves.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td template tfoot th thead title tr ul".split()
)
GONE = frozenset(
    "nav footer aside form script style head title template iframe noscript noframes noembed object embed svg canvas button select textarea dialog menu search "
    "input label audio video map datalist xmp".split()
)
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr figcaption caption".split())
CONTENT = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Class and id words of blocks that are no main text, of reader comments, and words that say nothing beside them.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner cookie cookies consent gdpr notice notices alert sidebar sidebars menu menus nav navbar navigation breadcrumb "
    "breadcrumbs footer masthead promo promotion sponsor sponsored sponsors share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay "
    "widget widgets toolbar pager pagination skip".split()
)
COMMENTS = frozenset("comment comments commentlist commentarea respond disqus reply replies".split())
NEUTRAL = frozenset(
    "area bar block body bottom box buttons by center col column container content end foot form global group head header holder icons inner item items left link links list main outer page "
    "panel post posts primary region right row secondary section site small text thread top unit view wrap wrapper".split()
)
#: A start tag of the key closes an open element of the values, up to the nearest of the scope.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table select article section div main body html td th blockquote".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)

_TAG = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<([!?])[^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
#: One attribute, name and value, so that what stands inside a value is never taken for a name.
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))?+")
_WORDS = re.compile(r"[a-z]+")
_SCOPE_OF = {tag: SCOPE - set(closed) for tag, closed in CLOSES.items()}


class Node:
    """chars, links: characters of text, and of text in links, without what is gone below; content: an article is below."""

    __slots__ = ("tag", "gone", "named", "names", "children", "digest", "shape", "chars", "links", "content")

    def __init__(self, tag: str, gone: bool = False, named: bool = False, names: str = ""):
        self.tag, self.gone, self.named, self.names, self.children = tag, gone, named, names, []
        self.digest = self.shape = self.chars = self.links = 0
        self.content = False


def _says(value: str, words: frozenset) -> bool:
    """Whether one of the names in a class or id consists of these words, beside neutral ones, only."""
    for name in value.split():
        parts = _WORDS.findall(name)
        if not words.isdisjoint(parts) and all(p in words or p in NEUTRAL for p in parts):
            return True
    return False


def _node(tag: str, attributes: str, in_content: bool) -> Node:
    """An element and what its tag and attributes say of it."""
    gone, named, names = tag in GONE or tag == "header" and not in_content, False, []
    for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            if name == "class":
                names += _WORDS.findall(value)
            if tag not in ("html", "body", "main"):
                gone |= _says(value, COMMENTS)
                named |= tag != "article" and _says(value, NAMES)
        elif tag not in ("html", "body", "article", "main"):
            gone |= name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES
        if name == "itemprop" and value == "comment":
            gone = True
    return Node(tag, gone, named, " ".join(names))


def parse(html: str) -> Node:
    """The tree of a page; every node has the digest and the shape of its subtree. Time is linear in the page."""
    from xxhash import xxh64_intdigest as digest

    top = Node("")
    stack = [top]
    places: dict[str, list[int]] = {}  # of open elements by tag, in the stack
    content = 0
    at, n = 0, len(html)

    def open_(node: Node) -> None:
        nonlocal content
        content += node.tag in CONTENT
        places.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def close(to: int) -> None:
        nonlocal content
        while len(stack) > to:
            node = stack.pop()
            if stack:
                places[node.tag].pop()
            content -= node.tag in CONTENT
            node.content = node.tag in CONTENT and not node.gone
            whole, shape, last = [_bytes(node.tag)], [_bytes(node.tag), node.names.encode("utf-8", "replace")], 0
            for c in node.children:
                if isinstance(c, Node):
                    whole.append(c.digest.to_bytes(8, "little"))
                    if c.shape != last:
                        last = c.shape
                        shape.append(last.to_bytes(8, "little"))
                    if not c.gone:
                        node.chars += c.chars
                        node.links += c.links
                        node.content |= c.content
                else:
                    words = " ".join(c.split())
                    whole.append(words.encode("utf-8", "replace"))
                    node.chars += len(words)
            if node.tag in RAW:
                node.chars = 0
            if node.tag == "a":
                node.links = node.chars
            node.digest, node.shape = digest(b"<".join(whole)), digest(b">".join(shape))

    def last_of(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            stack[-1].children.append(html[at:])
            break
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        at = m.end()
        end, tag, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not tag:
            continue
        tag = tag.lower()
        if end:
            if tag == "br":
                stack[-1].children.append(" ")
            elif places.get(tag):
                close(places[tag][-1])
            continue
        if tag in CLOSES_P and places.get("p") and places["p"][-1] > last_of(SCOPE):
            close(places["p"][-1])
        if tag in CLOSES:
            border = last_of(_SCOPE_OF[tag])
            inside = [places[t][i] for t in CLOSES[tag] if places.get(t) and (i := bisect_right(places[t], border)) < len(places[t])]
            if inside:
                close(min(inside))
        node = _node(tag, attributes, content > 0)
        stack[-1].children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>", re.I).search(html, at)
            node.children.append(html[at : stop.start() if stop else n])
            at = stop.end() if stop else n
            open_(node)
            close(len(stack) - 1)
        elif tag not in VOID:
            open_(node)
    close(0)
    return top


@lru_cache(10_000)
def _bytes(tag: str) -> bytes:
    return tag.encode("utf-8", "replace")


def _may_repeat(node: Node, in_content: bool) -> bool:
    """Whether a subtree can be template: a block, but not the page's frame, its article, or running text in an article."""
    return node.tag in BLOCKS and node.tag not in ("html", "head", "body", "article", "main") and not (in_content and node.tag in TEXT)


def _placed(path: int, node: Node) -> int:
    """A shape at its place: `path` stands for the tags and class words above it."""
    return hash((path, node.shape, 1)) & (1 << 64) - 1


def _below(path: int, node: Node) -> int:
    return hash((path, _number(node.tag), _number(node.names))) & (1 << 64) - 1


@lru_cache(10_000)
def _number(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))


def subtrees(top: Node) -> list[tuple[int, int | None, bool, float, float]]:
    """Of the subtrees that can be template: digest, shape at its place (None inside an article), whether it is a container outside the
    article, its part of the page's text, and the part of it that is links."""
    out = []
    total = max(top.chars, 1)
    todo = [(top, False, 0)]
    while todo:
        node, inside, path = todo.pop()
        inside |= node.tag in CONTENT
        path = _below(path, node)
        for c in node.children:
            if isinstance(c, Node) and not c.tag == "head":
                if _may_repeat(c, inside) and c.children:
                    apart = not inside and c.tag not in TEXT and not c.content
                    out.append((c.digest, _placed(path, c) if apart else None, apart, min(c.chars / total, 1.0), c.links / c.chars if c.chars else 0.0))
                todo.append((c, inside, path))
    return out


def main_text(top: Node, templates: set[int], named: bool = True, articles: bool = True) -> str:
    """Blocks in page order, one a line. named: whether class and id words count; articles: whether articles with most of the text are read alone."""
    prose = top.chars - top.links

    def kept(node: Node, inside: bool, path: int) -> bool:
        if node.gone:
            return False
        if named and node.named and not node.content and (top.content or 2 * (node.chars - node.links) <= prose):
            return False
        if templates and _may_repeat(node, inside):
            return node.digest not in templates and (inside or node.tag in TEXT or node.content or _placed(path, node) not in templates)
        return True

    blocks: list[tuple[bool, str]] = []
    run: list[str] = []
    now = False  # whether the run is inside an article

    def flush() -> None:
        text = " ".join(unescape("".join(run)).split())
        run.clear()
        if text:
            blocks.append((now, text))

    todo: list = [(top, False, 0)]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            run.append(x)
        elif isinstance(x, bool):
            flush()
            now = x
        else:
            node, inside, path = x
            if node is not top and not kept(node, inside, path):
                continue
            if node.tag in BLOCKS:
                flush()
                todo.append(now)  # what follows the element is where it was before
                now = now or node.tag in CONTENT
            elif node.tag == "br":
                run.append(" ")
            inside, path = inside or node.tag in CONTENT, _below(path, node)
            todo += [(c, inside, path) if isinstance(c, Node) else c for c in reversed(node.children)]
    flush()
    size = [sum(len(t) for inside, t in blocks if inside is x) for x in (False, True)]
    return "\n".join(t for inside, t in blocks if inside or not articles or size[1] < size[0] or not size[1])


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE, many_pages: int = MANY_PAGES) -> DataFrame:
    """(host, digest): the subtrees and shapes that are template of a host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("digest", pa.int64()), ("shape", pa.int64()), ("apart", pa.bool_()), ("part", pa.float64()), ("links", pa.float64())])
        for batch in batches:
            for part in slices(batch, 1):
                whole, found = [], []
                for html in part.column(1).to_pylist():
                    top = parse(html or "")
                    whole.append(_signed(top.digest))
                    once = {}
                    for digest, shape, apart, size, links in subtrees(top):
                        once[digest, shape] = (_signed(digest), None if shape is None else _signed(shape), apart, size, links)
                    found.append([dict(zip(("digest", "shape", "apart", "part", "links"), x)) for x in once.values()])
                yield pa.record_batch([part.column(0), pa.array(whole, pa.int64()), pa.array(found, pa.list_(item))], names=["host", "page", "found"])

    read = pages.select(host(F.col("url")).alias("host"), F.col("html").cast("string")).filter("host <> ''")
    schema = "host string, page long, found array<struct<digest: long, shape: long, apart: boolean, part: double, links: double>>"
    distinct = map_arrow(read, run, schema).groupBy("host", "page").agg(F.first("found").alias("found"))
    # One row for each subtree of a page, and one without a subtree for the page itself.
    each = distinct.select("host", F.explode(F.concat(F.array(F.lit(None).cast("struct<digest: long, shape: long, apart: boolean, part: double, links: double>")), "found")).alias("s"))
    found = each.groupBy("host", F.col("s.digest").alias("digest"), F.col("s.shape").alias("shape")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("s.part").alias("part"), F.sum("s.links").alias("links"), F.max("s.apart").alias("apart")
    )
    counts = written(found, "subtree_counts")
    sizes = counts.filter("digest IS NULL").select("host", F.col("n").alias("pages"))
    exact = counts.filter("digest IS NOT NULL").groupBy("host", "digest").agg(F.sum("n").alias("n"), F.max("apart").alias("apart")).filter(f"n >= {least_pages}")
    exact = exact.join(sizes, "host").filter((F.col("n") >= F.col("pages") * share) | F.col("apart") & (F.col("n") >= many_pages)).select("host", "digest")
    shapes = counts.filter("shape IS NOT NULL").groupBy("host", "shape").agg(
        F.sum("n").alias("n"), F.sum("part").alias("part"), F.sum("links").alias("links"), F.count(F.lit(1)).alias("texts")
    ).filter(f"n >= {least_pages}")
    dull = (F.col("links") >= F.col("n") * LINKS) | (F.col("texts") <= F.col("n") * VARIETY)
    shapes = shapes.join(sizes, "host").filter((F.col("n") >= F.col("pages") * share) & (F.col("part") <= F.col("pages") * PART) & dull)
    return exact.unionByName(shapes.select("host", F.col("shape").alias("digest")))


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE, many_pages: int = MANY_PAGES, named: bool = True) -> DataFrame:
    """(page_id, url, text) for every row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                texts = []
                for html, known in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    texts.append(main_text(parse(html or ""), {d & (1 << 64) - 1 for d in known or ()}, named))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                found = [list({_signed(x) for s in subtrees(parse(html or "")) for x in s[:2] if x is not None}) for html in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(found, pa.list_(pa.int64()))], names=["row", "host", "digests"])

    found = written(templates(pages, least_pages, share, many_pages), "templates")
    read = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).withColumn("host", host(F.col("url")))
    if found.count() <= BROADCAST:
        joined = read.join(F.broadcast(found.groupBy("host").agg(F.collect_set("digest").alias("known"))), "host", "left")
    else:
        rows = written(read.withColumn("row", F.monotonically_increasing_id()), "pages", "zstd")
        mine = map_arrow(rows.filter("host <> ''").select("row", "host", "html"), own, "row long, host string, digests array<long>")
        mine = written(mine.select("row", "host", F.explode("digests").alias("digest")), "page_subtrees")
        known = mine.join(found, ["host", "digest"]).groupBy("row").agg(F.collect_set("digest").alias("known"))
        joined = rows.join(known, "row", "left")
    return map_arrow(joined.select("page_id", "url", "html", "known"), run, "page_id long, url string, text string")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
