"""Main text of web pages, with site templates found by counting subtrees.

Every page is parsed leniently into a tree.  Each element's subtree is hashed over tag
names and texts; the hashes are counted per host in Spark, once for each different
surrounding, and a subtree that recurs in many of them is template and is deleted: on a
large share of its host's pages, or often enough whatever the host's size.  Inside the
page's article only subtrees go that are on more than half of the host's pages, and
text blocks of fewer than ``CHANCE_WORDS`` words, which recur by chance, never.  Elements
that declare themselves as menus, headers, footers, sidebars, notices, adverts, forms or
comments, by tag, role or a class that says nothing else, go everywhere.

The text is that of the articles (``article``, ``main``, role=main), or of the body of a
page without any: one block per block-level element, white space runs as one space,
blocks in page order joined by a blank line.

Surroundings are told apart by the three longest texts outside the subtree, without words
that hold digits, and the middle one of the three counts is taken.  So near copies of a
page count once if they differ in markup, in numbers or in one of these texts, and one
long text that all pages share doesn't make their pages the same.

Known templates are broadcast as 64-bit keys if there are at most ``BROADCAST_KEYS``;
beyond, each page fetches its own by a join.

Defined results: a null or empty html has an empty text; markup that isn't closed ends
where HTML's implied end tags or the enclosing element end it; rows that repeat a page
or nearly so count as one page of their host; a url without host has the empty host;
pages are read whole, whatever their length; an empty table gives no rows; columns of
``pages`` stay, but for one named ``main_text``, which gives way to the result.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, fresh, table, without
from .url_filter import host_of

#: A subtree is template if it is on so many pages of its host, and on so large a share of them.
MIN_PAGES = 4
MIN_SHARE = 0.1
ARTICLE_SHARE = 0.5
#: Outside an article, so many pages are enough on a host of any size; text blocks of fewer words recur by chance.
MANY_PAGES = 100
CHANCE_WORDS = 4
_PAGE, _OUTSIDE, _SHORT, _INSIDE = -1, 0, 1, 2
_RANKS = 3
BROADCAST_KEYS = 500_000

# a quote counts only behind "=", and only if it is closed
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(?:!|\?)[^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?)*+)>?", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe noembed noframes xmp title textarea svg math".split())
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
_TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt figcaption caption td th".split())
_DROPPED = frozenset("nav footer aside form script style noscript template iframe button select input textarea menu dialog svg math object embed canvas audio video head title".split())
#: A class or id declares an element if all its words are among these, one of the first row's at least.
_DROPPED_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsored promo promotion banner cookie cookies consent notice menu nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead comment comments replies sharing social related newsletter subscribe popup modal toolbar pagination".split())
_PLACE_WORDS = frozenset("site page main top bottom left right side box bar block slot container wrapper area section list widget links reader readers user users".split())
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
_SPACE = " \t\n\r\f"
_DIGIT = re.compile(r"\d")


class _Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []  # children: elements and strings


def parse(page: str) -> _Element:
    """A tree of the page; strings in it are decoded."""
    root = _Element("html", {})
    stack = [root]
    at, size = 0, len(page)

    def text(raw: str) -> None:
        if raw:
            stack[-1].children.append(entities.unescape(raw))

    def close(tags: tuple[str, ...], stop: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in stop:
                return

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            stop = frozenset() if tag in ("body", "html", "article", "main") else frozenset(("article", "main", "table", "td", "th")) - {tag}
            if tag == "p" and not any(e.tag == "p" for e in stack):
                continue
            close((tag,), stop)
        elif m[2]:
            tag = m[2].lower()
            attrs = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTRIBUTE.finditer(m[3] or "")}
            if tag in ("html", "body") and any(e.tag == tag for e in stack):
                continue
            if tag in _CLOSES_P:
                close(("p",), frozenset(("table", "td", "th", "button", "object")))
            if tag == "li":
                close(("li",), frozenset(("ul", "ol", "menu")))
            elif tag in ("dd", "dt"):
                close(("dd", "dt"), frozenset(("dl",)))
            elif tag in ("td", "th"):
                close(("td", "th"), frozenset(("table", "tr")))
            elif tag == "tr":
                close(("tr",), frozenset(("table",)))
            elif tag == "option":
                close(("option",), frozenset(("select",)))
            elif tag == "body":
                close(("head",), frozenset())
            element = _Element(tag, attrs)
            stack[-1].children.append(element)
            if tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = end.end() if end else size
            elif tag not in _VOID and not (m[3] or "").rstrip().endswith("/") or tag in ("p", "div") and not (m[3] or ""):
                stack.append(element)
    return root


def _key(host: str, digest: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(digest + host.encode(), digest_size=8).digest(), "little", signed=True)


def _is_article(e: _Element) -> bool:
    return e.tag in ("article", "main") or e.attrs.get("role") == "main"


def _declared(e: _Element, inside: bool) -> bool:
    """Whether the element says itself that it isn't main text."""
    if e.tag in _DROPPED or e.tag == "header" and not inside or "hidden" in e.attrs or e.attrs.get("aria-hidden") == "true" or e.attrs.get("role") in _DROPPED_ROLES:
        return True
    names = [re.split("[-_]+", n) for n in f"{e.attrs.get('class', '')} {e.attrs.get('id', '')}".lower().split()]
    says = any(not _DROPPED_WORDS.isdisjoint(n) and _DROPPED_WORDS.union(_PLACE_WORDS).issuperset(n) for n in names)
    return e.tag not in ("body", "html", "article", "main") and says or "display:none" in e.attrs.get("style", "").replace(" ", "").lower()


def digests(root: _Element) -> dict[int, bytes]:
    """A hash of each element's subtree, by the element's identity; without recursion."""
    out: dict[int, bytes] = {}
    todo = [(root, False)]
    while todo:
        e, ready = todo.pop()
        if not ready:
            todo.append((e, True))
            todo += [(c, False) for c in e.children if isinstance(c, _Element)]
            continue
        h = hashlib.blake2b(e.tag.encode(), digest_size=12)
        for c in e.children:
            if isinstance(c, _Element):
                h.update(b"\0" + out[id(c)])
            elif words := c.split():
                h.update(b"\1" + " ".join(words).encode("utf-8", "replace"))
        out[id(e)] = h.digest()
    return out


def _walk(root: _Element) -> Iterator[tuple[_Element, bool, bool]]:
    """Elements with whether they lie inside an article and whether an article lies inside them."""
    holds: set[int] = set()
    todo: list[tuple[_Element, bool]] = [(root, False)]
    order = []
    while todo:
        e, inside = todo.pop()
        order.append((e, inside))
        todo += [(c, inside or _is_article(e)) for c in e.children if isinstance(c, _Element)]
    for e, _ in reversed(order):
        if _is_article(e) or any(isinstance(c, _Element) and id(c) in holds for c in e.children):
            holds.add(id(e))
    for e, inside in order:
        yield e, inside, id(e) in holds


def _has_words(e: _Element, least: int) -> bool:
    todo: list[object] = [e]
    while todo and least > 0:
        node = todo.pop()
        if isinstance(node, str):
            least -= len(node.split())
        else:
            todo += node.children
    return least <= 0


def candidates(root: _Element, host: str) -> list[tuple[int, bool, _Element]]:
    """(key, inside an article, element) of the subtrees that may be template."""
    has_article = any(_is_article(e) for e, _, _ in _walk(root))
    by = digests(root)
    out = {}
    for e, inside, holds in _walk(root):
        if holds or e.tag in ("html", "head", "body") or not e.children:
            continue
        if not inside and not has_article and e.tag in ("b", "i", "a", "em", "strong", "span") or inside and e.tag not in _BLOCKS:
            continue
        if inside and e.tag in _TEXT_BLOCKS and not _has_words(e, CHANCE_WORDS):
            continue
        out[_key(host, by[id(e)])] = inside, e
    return [(k, *v) for k, v in out.items()]


class Surroundings:
    """The page's texts in order, and of each element which of them it holds."""

    def __init__(self, root: _Element):
        self.root = root
        self.held: dict[int, tuple[int, int]] = {}
        self.words = [0]
        texts: list[tuple[int, int]] = []  # (-length, hash), so that the least is the longest
        todo: list[tuple[object, int]] = [(root, -1)]
        while todo:
            node, first = todo.pop()
            if isinstance(node, str):
                if words := node.split():
                    kept = " ".join(w for w in words if not _DIGIT.search(w)).encode("utf-8", "replace")
                    texts.append((-len(kept), int.from_bytes(hashlib.blake2b(kept, digest_size=8).digest(), "little", signed=True)))
                    self.words.append(self.words[-1] + len(words))
            elif first >= 0:
                self.held[id(node)] = first, len(texts)
            else:
                todo.append((node, len(texts)))
                todo += [(c, -1) for c in reversed(node.children)]
        self.before, self.after = self._longest(texts), self._longest(texts[::-1])[::-1]

    @staticmethod
    def _longest(texts: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
        """The longest texts among the first 0, 1, 2 and so on."""
        out: list[list[tuple[int, int]]] = [[]]
        for t in texts:
            best = out[-1]
            out.append(best if not t[0] or len(best) == _RANKS and t >= best[-1] else sorted([*best, t])[:_RANKS])
        return out

    def n_words(self, e: _Element) -> int:
        a, b = self.held[id(e)]
        return self.words[b] - self.words[a]

    def outside(self, e: _Element | None) -> list[int]:
        """Hashes of the longest texts outside the element, or of the page; the longest stands for missing ones."""
        a, b = (0, 0) if e is None else self.held[id(e)]
        found = [h for _, h in sorted(self.before[a] + self.after[b])[:_RANKS]] or [0]
        return [found[0]] * (_RANKS - len(found)) + found


def main_text(root: _Element, host: str, templates: set[int] | frozenset[int]) -> str:
    """The blocks of the main text, joined by blank lines."""
    has_article = any(_is_article(e) for e, _, _ in _walk(root))
    spared = {k for k, *_ in candidates(root, host)} & set(templates)
    by = digests(root) if spared else {}
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        words = "".join(line).split()
        if words:
            blocks.append(" ".join(words))
        line.clear()

    todo: list[tuple[object, bool]] = [(root, False)]
    while todo:
        node, inside = todo.pop()
        if node is None:
            flush()
            continue
        if isinstance(node, str):
            if inside or not has_article:
                line.append(node)
            continue
        if _declared(node, inside) or spared and _key(host, by[id(node)]) in spared:
            continue
        if node.tag == "br":
            line.append(" ")
        within = inside or _is_article(node)
        if node.tag in _BLOCKS:
            flush()
            todo.append((None, within))
        todo += [(c, within) for c in reversed(node.children)]
    flush()
    return "\n\n".join(blocks)


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, keys, places, ranks, around = [], [], [], [], []
        for host, page in zip(_column(batch, "host"), _column(batch, "html")):
            root = parse(page)
            texts = Surroundings(root)
            own = _key(host, b"")  # counts the host's pages
            for key, inside, e in [(own, False, None), *candidates(root, host)]:
                place = _PAGE if e is None else _INSIDE if inside else _SHORT if e.tag in _TEXT_BLOCKS and texts.n_words(e) < CHANCE_WORDS else _OUTSIDE
                hosts += [own] * _RANKS
                keys += [key] * _RANKS
                places += [place] * _RANKS
                ranks += range(_RANKS)
                around += texts.outside(e)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(keys, pa.int64()), pa.array(places, pa.int8()), pa.array(ranks, pa.int8()), pa.array(around, pa.int64())], names=["host", "key", "place", "rank", "around"])


def find_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, article_share: float = ARTICLE_SHARE, many_pages: int = MANY_PAGES) -> DataFrame:
    """(key): host-bound hashes of the template subtrees, from all pages."""
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    seen = rows.mapInArrow(_hashes, "host bigint, key bigint, place tinyint, rank tinyint, around bigint")
    # different surroundings first, so that a page crawled many times counts once and no key gathers the rows of its copies; a key is of one host
    one = F.max("place").alias("place"), F.min("host").alias("host")
    counts = seen.groupBy("key", "rank", "around").agg(*one).groupBy("key", "rank").agg(F.count("*").alias("n"), *one)
    counts = counts.groupBy("key").agg(F.sort_array(F.collect_list("n"))[_RANKS // 2].alias("n"), *one)
    counts = checkpoint(counts.where((F.col("place") == _PAGE) | (F.col("n") >= min_pages)))
    size = counts.where(F.col("place") == _PAGE).select("host", F.col("n").alias("pages"))
    needed = F.col("pages") * F.when(F.col("place") == _INSIDE, article_share).otherwise(min_share)
    needed = F.when(F.col("place") == _OUTSIDE, F.least(needed, F.lit(float(many_pages)))).otherwise(needed)
    return counts.where(F.col("place") != _PAGE).join(size, "host").where(F.col("n") >= needed).select("key").distinct()


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", broadcast_keys: int = BROADCAST_KEYS, **options) -> DataFrame:
    """``pages`` with main_text, the page's text without templates."""
    pages = without(pages, ("main_text",), url_col, html_col)
    columns = pages.columns
    host, page, keys_of = (fresh(pages, x) for x in ("host", "html", "keys"))
    templates = find_templates(pages, url_col, html_col, **options)
    few = templates.limit(broadcast_keys + 1).collect()
    rows = pages.select(*(F.col(f"`{c}`") for c in columns), host_of(F.col(url_col)).alias(host), F.coalesce(F.col(html_col), F.lit("")).alias(page))
    if len(few) <= broadcast_keys:
        sent = pages.sparkSession.sparkContext.broadcast(frozenset(r["key"] for r in few))
        rows = rows.withColumn(keys_of, F.lit(None).cast("array<bigint>"))
    else:
        sent = None

        def own_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [[k for k, *_ in candidates(parse(p), h)] for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["digest", "keys"])

        digest = fresh(pages, "digest")
        rows = rows.withColumn(digest, F.sha2(F.concat_ws("\n", host, page), 256))
        keys = rows.select(digest, host, page).mapInArrow(own_keys, "digest string, keys array<bigint>").select("digest", F.explode("keys").alias("key")).distinct()
        mine = keys.join(templates, "key").groupBy(F.col("digest").alias(digest)).agg(F.collect_list("key").alias(keys_of))
        rows = rows.join(mine, digest, "left").drop(digest)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(columns)
        for batch in batches:
            texts = [main_text(parse(p), h, sent.value if sent is not None else set(k or ())) for h, p, k in zip(*(batch.column(n + i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string())], names=[*columns, "main_text"])

    return rows.select(*(F.col(f"`{c}`") for c in columns), host, page, keys_of).mapInArrow(emit, T.StructType([*pages.schema, T.StructField("main_text", T.StringType())]))


def query(spark, sf_dir: str) -> DataFrame:
    """The contract of op5: the main text of every page."""
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
