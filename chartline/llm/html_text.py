"""Main text of web pages by removing what is common to a site.

A page is read as a stream of tags with a stack of open elements. Every element of the whole page, whatever its
kind, is hashed as a subtree (its name, class, id, role and all text in it), but for the plain paragraphs, headings,
list items and cells of an <article> or <main>. Spark counts on how many pages of its host each subtree stands,
and those on at least `ratio` of the pages (smoothed by SMOOTH pages), and at least `min_pages`, are the
template of the site and are deleted first. The share is low, since a site shows one of several menus, footers or
adverts on a page. Of what is left, elements that are never main text go by their kind (navigation, headers,
footers, asides, forms, hidden parts) or by a word in their class, id or role (advert, cookie, comments ...). A page
with an <article> (else <main>) then gives the text inside it, others their whole body.

Pages of a host whose blocks of text, but for those that go by kind or word, are equal count once, both for a subtree
and in the pages of the host: many copies of one page make no template, whatever menus stand around them. Text in a
paragraph, heading, list item or cell of an article is never template either, whatever stands around it: a site may hold
an article on many unlike pages.

At scale: rows of (host, subtree) are counted after a partial count on each task, so a large host is split
by subtree. The templates of a host are at most (subtrees of a page / ratio) hashes, since each is on that
share of its pages. They are written, and their size is known: up to SENT_TREES hashes they are sent to all tasks, so
that no page is shuffled. Beyond that they meet the pages by a join on the host, in which the few hosts that hold more
than one part in (shuffle partitions) of all pages are dealt out row by row, whatever their urls.

Null or empty html gives the empty text. A null url, or one without a host, counts as the host ''. Repeated rows and
equal pages are treated alike; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartline.llm.flat import mapped, saved, written
from chartline.llm.line_dedup import _dealt, _sent
from chartline.sizing import task_count

MIN_PAGES = 8
RATIO = 0.025
SMOOTH = 10
SENT_TREES = 500_000

# HTML's element kinds.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp"
    " small span strike strong sub sup time tt u var wbr img".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "head title nav footer aside form button select textarea option dialog menu object applet audio video canvas map".split()
)
PARAGRAPH_ENDS = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2"
    " h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table tr td th ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th".split())
# Words in class, id or role that name something other than main text.
NOT_MAIN = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu menubar"
    " breadcrumb breadcrumbs sidebar sidenav footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert"
    " banner newsletter subscribe subscription signup login popup modal overlay comment comments commentlist respond replies"
    " disqus share sharing social related recommended recommendations widget widgets pagination pager search skip hidden"
    " complementary contentinfo paywall".split()
)
_CLOSED_BY = {
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}),
    "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}),
}
_WHOLE = frozenset("body article main".split())
_FENCE = frozenset("ul ol dl table article main section div body".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|math|xmp|noembed|noframes)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s\"'>]++)))?")
_HIDING = re.compile(r"\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!\s*important\s*)?", re.I)
_WORDS = re.compile(r"[a-z0-9]+")


class Element:
    __slots__ = ("tag", "dropped", "article", "main", "prose", "shape")

    def __init__(self, tag: str, parent: Element | None, attributes: str):
        self.tag = tag
        self.article = tag == "article" or (parent is not None and parent.article)
        found = [(name.lower(), a or b or c) for name, a, b, c in _ATTRIBUTE.findall(attributes)] if attributes else []
        named = " ".join(value for name, value in found if value and name in ("class", "id", "role"))
        self.main = tag == "main" or (parent is not None and parent.main) or any(name == "role" and "main" in value.split() for name, value in found)
        self.dropped = (parent is not None and parent.dropped) or self._off(parent, named.lower(), found)
        self.prose = (tag in PROSE and (self.article or self.main)) or (parent is not None and parent.prose)
        self.shape = f"{tag} {named}"

    def _off(self, parent: Element | None, named: str, found: list[tuple[str, str]]) -> bool:
        inside = parent is not None and (parent.article or parent.main)
        if self.tag in DROPPED or (self.tag == "header" and not inside):
            return True
        if self.tag in ("html", "body", "main") or (self.tag == "article" and not inside):
            return False
        if named and (not NOT_MAIN.isdisjoint(_WORDS.findall(named)) or (not inside and "header" in _WORDS.findall(named))):
            return True
        return any(
            name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true")
            or (name == "style" and any(map(_HIDING.fullmatch, value.split(";"))))
            for name, value in found
        )


def parse(page: str) -> tuple[list[tuple[str, bool, bool, bool, tuple[int, ...]]], list[int]]:
    """(blocks, hashes of the subtrees that may be template).

    A block is (text, in an article, in main, dropped by kind or word, indexes of the subtrees that it goes with). Inline elements leave no
    trace, so that a forgotten end tag of theirs does no harm.
    """
    stack = [Element("html", None, "")]
    off: list[str] = []  # open tags inside a dropped inline element, which is the first
    buffer: list[str] = []
    blocks: list[tuple[str, Element, tuple[int, ...]]] = []
    subtrees: list[list[str]] = []
    trees: list[int] = [-1]  # for each open element, its subtree or -1

    def flush() -> None:
        if buffer:
            text = "".join(buffer)
            buffer.clear()
            if "&" in text:
                text = entities.unescape(text)
            text = " ".join(text.split())
            if text:
                around = tuple(k for k in trees if k >= 0)
                for k in around:
                    subtrees[k].append(text)
                blocks.append((text, stack[-1], () if stack[-1].prose and not stack[-1].dropped else around))

    def pop(to: int) -> None:
        flush()
        del stack[to:], trees[to:]

    def close_before(tag: str) -> None:
        """End what the start of this tag ends: an open paragraph, list item or cell."""
        if tag in PARAGRAPH_ENDS and stack[-1].tag == "p":
            pop(len(stack) - 1)
        ends = _CLOSED_BY.get(tag)
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    pop(k)
                    break
                if stack[k].tag in _FENCE:
                    break

    at = 0
    for match in _TOKEN.finditer(page):
        start = match.start()
        if start > at and not off:
            buffer.append(page[at:start])
        at = match.end()
        tag = match[3] or match[6]
        if tag is None:
            continue
        tag = tag.lower()
        if match[2] or match[5]:
            if off:
                if tag in off:
                    del off[len(off) - 1 - off[::-1].index(tag) :]
                    continue
                if tag in INLINE or all(e.tag != tag for e in stack):
                    continue
                off.clear()
            if tag in INLINE:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    pop(k)
                    break
                if tag in PROSE and stack[k].tag in _FENCE:
                    break
            continue
        if off:
            ended = off[0] in PROSE and all(t in INLINE for t in off[1:]) and (
                (off[0] == "p" and tag in PARAGRAPH_ENDS) or off[0] in _CLOSED_BY.get(tag, ())
            )
            if not ended:
                if tag not in VOID:
                    off.append(tag)
                continue
            off.clear()
        if tag == "br":
            buffer.append("\n")
            continue
        attributes = match[4] or match[7] or ""
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in INLINE:
            if attributes and attributes[-1] != "/" and Element(tag, stack[-1], attributes).dropped:
                off.append(tag)
            continue
        if tag == "body":  # whatever the head left open ends here
            pop(1)
        close_before(tag)
        flush()
        if tag == "html":
            continue
        element = Element(tag, stack[-1], attributes)
        stack.append(element)
        if (tag in _WHOLE or (tag in PROSE and (element.article or element.main))) and not element.dropped:
            trees.append(-1)
        else:
            trees.append(len(subtrees))
            subtrees.append([element.shape])
    if at < len(page) and not off:
        buffer.append(page[at:])
    flush()
    hashes = [xxhash.xxh64_intdigest("\x00".join(parts)) - (1 << 63) for parts in subtrees]
    return [(text, e.article, e.main, e.dropped, around) for text, e, around in blocks], hashes


def main_text(page: str | None, template: set[int]) -> str:
    """The blocks outside template subtrees that are not dropped, of the article (else of main, else of the body), one a line."""
    if not page:
        return ""
    blocks, hashes = parse(page)
    gone = {k for k, h in enumerate(hashes) if h in template}
    kept = [b for b in blocks if not b[3]]
    chosen = [b for b in kept if b[1]] or [b for b in kept if b[2]] or kept
    return "\n".join(block[0] for block in chosen if gone.isdisjoint(block[4]))


def host_of(url: str) -> Column:
    """What stands between the first :// and the next /, ? or #, in lower case; '' if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^(?s).*?://([^/?#]*)", 1), F.lit("")))


def templates(pages: DataFrame, *, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, ratio: float = RATIO) -> DataFrame:
    """host, template: the hashes of the subtrees that recur on each host."""
    rows = pages.select(host_of(url).alias("host"), F.col(html).alias("html"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, found = [], []
            for page in batch.column(1):
                blocks, trees = parse(page.as_py()) if page.is_valid else ([], [])
                names.append(xxhash.xxh64_intdigest("\x00".join(block[0] for block in blocks if not block[3])) - (1 << 63))
                found.append(sorted(set(trees)))
            columns = [batch.column(0), pa.array(names, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "page", "trees"])

    trees = mapped(rows, hashes, "host string, page bigint, trees array<bigint>")
    # The null tree stands on every page, so its count is the pages of the host.
    every = F.concat(F.array(F.lit(None).cast("bigint")), F.col("trees"))
    seen = trees.select("host", "page", F.explode(every).alias("tree")).distinct()
    counts = saved(seen.groupBy("host", "tree").agg(F.count("*").alias("n")).where(F.col("tree").isNull() | (F.col("n") >= min_pages)))
    totals = counts.where(F.col("tree").isNull()).select("host", F.col("n").alias("pages"))
    recurring = counts.where(F.col("tree").isNotNull()).join(totals, "host").where(F.col("n") >= ratio * (F.col("pages") + SMOOTH))
    return recurring.groupBy("host").agg(F.collect_list("tree").alias("template"))


def extract(pages: DataFrame, *, url: str = "url", html: str = "html", out: str = "main_text", min_pages: int = MIN_PAGES, ratio: float = RATIO, sent_trees: int = SENT_TREES) -> DataFrame:
    """All rows and the columns of pages without html, and the main text. A column named like `out` is replaced."""
    pages = pages.drop(out)
    found = written(templates(pages, url=url, html=html, min_pages=min_pages, ratio=ratio).withColumnRenamed("template", "lines"))
    size = found.agg(F.coalesce(F.sum(F.size("lines") + 1), F.lit(0)).alias("n")).first().n
    rows = pages.select(F.struct("*").alias("row"), host_of(url).alias("host"))
    joined = _sent(rows, found) if size <= sent_trees else _dealt(rows, found, task_count(pages))
    joined = joined.select(*(F.col(f"row.`{c}`").alias(f"c{k}") for k, c in enumerate(pages.columns)), F.col("gone").alias("template"))
    at = pages.columns.index(html)
    kept = [k for k in range(len(pages.columns)) if k != at]
    schema = T.StructType([*(joined.schema[k] for k in kept), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict = {}
            texts = []
            for page, hashes in zip(batch.column(at), batch.column(len(kept) + 1), strict=True):
                key = tuple(hashes.as_py() or ())
                texts.append(main_text(page.as_py(), sets.setdefault(key, set(key))))
            columns = [batch.column(k) for k in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[*(f"c{k}" for k in kept), "text"])

    done = mapped(joined, run, schema)
    return done.select(*(F.col(f"c{k}").alias(pages.columns[k]) for k in kept), F.col("text").alias(out))
