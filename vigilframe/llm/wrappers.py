"""HTML extraction by wrapper induction.

Pages of a host that have the same containers are one layout; layouts of few pages are taken together. Every page is aligned with the smallest page of
its layout by simple tree matching, and each block's text is counted at the node it is aligned with, over all different pages of the layout. A text that
nine of ten pages have at one node is template, all else is slot. The wrapper of a layout is small: hashes of its template blocks. It is joined to the
layout's pages (Spark broadcasts the wrappers only while their written size allows it), and every page is then read on its own: the article element if
the page has one, else the body, less menus, headers, footers, sidebars, notices, adverts, forms, comments and template blocks.

Nothing is sampled: the reference page only names the nodes. Counting is combined before the shuffle, so a host with a third of all pages costs no more.
Null and empty pages give an empty text. A page whose url has no host belongs to the host "".
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.common import cut, pieces
from vigilframe.llm.dom import BLOCKS, Node, parse, walk

LEAST_PAGES = 3  # fewer cannot tell a template
SHARE = 90  # of 100 pages of a layout that have a template's text at its node
SMALL_TABLE = 400  # cells of an alignment that are not worth an array
LARGE_TABLE = 1 << 22  # cells of an alignment beyond which it is halved
HELD = 20_000  # shapes and pairs of earlier pages that are kept for a reference

SKIPPED = frozenset("head script style noscript template iframe svg math object embed form nav footer aside button select textarea input label dialog menu canvas audio video xmp noembed title fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar hidden".split())
CLUTTER = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion promoted nav navbar navigation menu topbar breadcrumb breadcrumbs header masthead footer foot sidebar side aside rail widget cookie cookies consent gdpr notice alert "
    "banner popup modal overlay toast subscribe subscription newsletter signup login signin share sharing social comment comments disqus replies reply respond related recommended recommendations pagination pager search form toolbar legal copyright hidden".split()
)
_TITLES = frozenset(("header", "masthead", "banner"))  # inside an article these hold its title
_MARK = re.compile(r"[^a-z0-9]+")
_ARTICLE = frozenset(("article", "main"))
_SEEN = pa.list_(pa.struct([("node", pa.int32()), ("key", pa.int64())]))


def host_of(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def layout_of(html: str = "html"):
    """The containers of a page with their classes and ids, each once, numbers in them as 0; null for null and empty pages."""
    named = lambda tag, key: F.regexp_extract(tag, rf"""(?i)\b{key}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    tags = F.array_distinct(F.regexp_extract_all(html, F.lit(r"<(?:!--(?s:.*?)(?:-->|\z)|(?i:script)\b(?s:.*?)(?:</(?i:script)|\z)|(?i:style)\b(?s:.*?)(?:</(?i:style)|\z)|(?i:body|div|section|main|article)\b[^>]*)"), F.lit(0)))
    names = F.transform(F.filter(tags, lambda t: ~t.rlike("^<(!|(?i:s[ct]))")), lambda t: F.regexp_replace(F.lower(F.concat_ws(" ", F.regexp_extract(t, "[a-zA-Z]+", 0), named(t, "class"), named(t, "id"))), "[0-9]+", "0"))
    return F.when(F.length(html) > 0, F.hex(F.xxhash64(F.array_sort(F.array_distinct(names)))))


def clutter(node: Node, inside: bool) -> bool:
    """Whether an element and all below it is never part of an article. ``inside``: it stands in the article."""
    if node.tag in SKIPPED or (node.tag == "header" and not inside):
        return True
    if not node.marks or node.tag in ("html", "body", "article", "main"):
        return "hidden" in node.marks.split() if node.marks else False
    found = CLUTTER.intersection(_MARK.split(node.marks))
    return not ROLES.isdisjoint(node.marks.split()) or bool(found - _TITLES if inside else found)


def blocks(node: Node, inside: bool = False, path: str = "") -> Iterator[tuple[Node, str, str]]:
    """(block element, its path, text) in page order."""
    run: list[str] = []
    out: list[tuple[Node, str, str]] = []
    stack: list[tuple[Node, str, bool]] = [(node, path or node.name, inside)]

    def flush(element: Node, at: str) -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append((element, at, text))

    def visit(n: Node) -> None:
        for c in n.children:
            element, at, within = stack[-1]
            if isinstance(c, str):
                run.append(c)
            elif c.tag in ("br", "wbr"):
                run.append(" " if c.tag == "br" else "")
            elif clutter(c, within):
                if c.tag in BLOCKS:
                    flush(element, at)
            elif c.tag in BLOCKS:
                flush(element, at)
                stack.append((c, f"{at}/{c.name}", within or c.tag in _ARTICLE))
                visit(c)
                flush(*stack.pop()[:2])
            else:
                visit(c)

    visit(node)
    flush(*stack[-1][:2])
    yield from out


def _roots(page: Node) -> list[tuple[Node, str]]:
    """Outermost article or main elements outside clutter, with their paths."""
    found, todo = [], [(page, page.name)]
    while todo:
        n, path = todo.pop()
        if n.tag in _ARTICLE or "main" in n.marks.split():
            articles = [x for x in walk(n) if x.tag == "article"] if n.tag != "article" else []
            found.append((articles[0], f"{path}//article") if len(articles) == 1 and not clutter(articles[0], True) else (n, path))
            continue
        todo += [(c, f"{path}/{c.name}" if c.tag in BLOCKS else path) for c in reversed(n.nodes()) if not clutter(c, False)]
    return found


class Aligner:
    """Simple tree matching of pages with one reference: the largest order-keeping pairing of two trees whose roots agree."""

    def __init__(self, reference: Node):
        self.reference = reference
        self.numbers: dict[tuple, int] = {}  # (name, shapes of the children) of every different subtree
        self.shapes: list[tuple] = []
        self.sizes: list[int] = []
        self.known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
        self.held = 0  # shapes and pairs kept so far
        self.own = self.shaped(reference)
        self.places = {id(n): k for k, n in enumerate(walk(reference))}

    def shaped(self, tree: Node) -> dict[int, tuple[int, list[Node]]]:
        """Shape and child elements of every node."""
        every = [(tree, tree.nodes())]
        for _, children in every:
            every += [(c, c.nodes()) for c in children]
        out: dict[int, tuple[int, list[Node]]] = {}
        for n, children in reversed(every):
            key = (n.name, *[out[id(c)][0] for c in children])
            shape = self.numbers.setdefault(key, len(self.shapes))
            if shape == len(self.shapes):
                self.shapes.append(key)
                self.held += len(key)
                self.sizes.append(1 + sum([self.sizes[c] for c in key[1:]]))
            out[id(n)] = (shape, children)
        return out

    def weight(self, x: int, y: int) -> int:
        if x == y:
            return self.sizes[x]
        return self.inside(x, y)[0] if self.shapes[x][0] == self.shapes[y][0] else 0

    def inside(self, x: int, y: int) -> tuple[int, list[tuple[int, int]]]:
        """Most pairs of two shapes whose names agree, and the pairing of their children."""
        if (x, y) not in self.known:
            left, right = self.shapes[x][1:], self.shapes[y][1:]
            pairs = in_order(left, right, self.weight)
            total = 1
            for i, j in pairs:
                total += self.weight(left[i], right[j])
            self.known[x, y] = total, pairs
            self.held += 1 + len(pairs)
        return self.known[x, y]

    def pairs(self, page: Node) -> list[tuple[Node, Node]]:
        if page.name != self.reference.name:
            return []
        theirs = self.shaped(page)
        out = [(self.reference, page)]
        for a, b in out:
            (x, left), (y, right) = self.own[id(a)], theirs[id(b)]
            out += zip(left, right, strict=True) if x == y else [(left[i], right[j]) for i, j in self.inside(x, y)[1]]
        return out

    def blocks(self, page: Node) -> set[tuple[int, int]]:
        """(number of the reference's node it is aligned with, or -1, and key) of every text block of a page."""
        mates = {id(b): self.places[id(a)] for a, b in self.pairs(page)}
        return {(mates.get(id(n), -1), block_key(path, text)) for n, path, text in content(page)}


def matching(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Number of pairs, and the pairs, of two trees."""
    pairs = Aligner(a).pairs(b)
    return len(pairs), pairs


def in_order(left: tuple[int, ...], right: tuple[int, ...], weight: Callable[[int, int], int]) -> list[tuple[int, int]]:
    """Places of the order-keeping pairing of two lists of shapes with the largest sum of weights. Equal shapes at either end belong together."""
    start, m, n = 0, len(left), len(right)
    while start < min(m, n) and left[start] == right[start]:
        start += 1
    while start < min(m, n) and left[m - 1] == right[n - 1]:
        m, n = m - 1, n - 1
    out = [(i, i) for i in range(start)] + [(m + k, n + k) for k in range(len(left) - m)]
    if start in (m, n):
        return out
    few, many = ({x: k for k, x in enumerate(dict.fromkeys(shapes))} for shapes in (left[start:m], right[start:n]))
    table = [[weight(x, y) for y in many] for x in few]
    row, column = [few[x] for x in left[start:m]], [many[y] for y in right[start:n]]
    if len(row) * len(column) > SMALL_TABLE:
        table, row, column = np.array(table, np.int64), np.array(row), np.array(column)
    return out + [(start + i, start + j) for i, j in _paired(table, row, column)]


def _paired(table, row, column) -> list[tuple[int, int]]:
    m, n = len(row), len(column)
    if m > 1 and m * n > LARGE_TABLE:
        half = m // 2
        at = int(np.argmax(_sums(table, row[:half], column, True)[-1] + _sums(table, row[half:][::-1], column[::-1], True)[-1][::-1]))
        return _paired(table, row[:half], column[:at]) + [(half + i, at + j) for i, j in _paired(table, row[half:], column[at:])]
    best = _sums(table, row, column)
    pairs, i, j = [], m, n
    while i and j:
        gain = table[row[i - 1]][column[j - 1]]
        if gain and best[i][j] == best[i - 1][j - 1] + gain:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return pairs


def _sums(table, row, column, last: bool = False) -> list:
    """The largest sum for every two beginnings of the lists, a row for each beginning of the first, or only the last."""
    if isinstance(table, list):
        best = [[0] * (len(column) + 1)]
        for x in row:
            above, line, gains = best[-1], [0], table[x]
            for j, y in enumerate(column):
                line.append(max(above[j + 1], line[j], above[j] + gains[y]))
            best.append(line)
        return best
    best = [np.zeros(len(column) + 1, dtype=np.int64)]
    for x in row:
        above, line = best[-1], np.zeros(len(column) + 1, dtype=np.int64)
        line[1:] = np.maximum.accumulate(np.maximum(above[1:], above[:-1] + table[x][column]))
        if last:
            best.clear()
        best.append(line)
    return best


def content(page: Node) -> list[tuple[Node, str, str]]:
    """Blocks of the article elements of a page, or of the whole page where it has none."""
    roots = _roots(page)
    return [b for n, path in roots for b in blocks(n, True, path)] if roots else list(blocks(page))


def block_key(path: str, text: str) -> int:
    return int.from_bytes(blake2b(f"{path}\0{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def extract(source: str, template: frozenset[int] = frozenset()) -> str:
    """The article's text: one line per block."""
    found = content(parse(source))
    kept = [text for _, path, text in found if block_key(path, text) not in template] if template else []
    return "\n".join(kept or [text for _, _, text in found])


def kinds(pages: DataFrame) -> DataFrame:
    """(host, kind, pages, reference) of every layout with enough different pages; kind "" takes all other pages of a host."""
    different = pages.where("layout IS NOT NULL").groupBy("host", "layout", "h").agg(F.min(F.length("html")).alias("size"))
    layouts = cut(different.groupBy("host", "layout").agg(F.count("*").alias("pages"), F.min(F.struct("size", "h")).alias("first")))
    rest = layouts.where(F.col("pages") < LEAST_PAGES).groupBy("host").agg(F.sum("pages").alias("pages"), F.min("first").alias("first")).withColumn("layout", F.lit(""))
    chosen = layouts.unionByName(rest).where(F.col("pages") >= LEAST_PAGES).select("host", F.col("layout").alias("kind"), "pages", F.col("first.h").alias("h"))
    return cut(pages.select("host", "h", "html").join(chosen, ["host", "h"]).groupBy("host", "kind", "pages").agg(F.min("html").alias("reference")))


def wrappers(pages: DataFrame, known: DataFrame) -> DataFrame:
    """(host, kind, template) from all pages of each kind. Template blocks of a host's largest layout are so in its rare layouts too."""
    every = pages.where("layout IS NOT NULL").join(known, ["host", "kind"]).select("host", "kind", "pages", "h", "html", "reference")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligners: dict[str, Aligner] = {}
        for batch in batches:
            for part in pieces(batch, "html", 8 << 20):
                out = []
                for source, reference in zip(part.column(4).to_pylist(), part.column(5).to_pylist(), strict=True):
                    if reference not in aligners or aligners[reference].held > HELD:
                        if len(aligners) > 100:
                            aligners.clear()
                        aligners[reference] = Aligner(parse(reference))
                    out.append([{"node": node, "key": key} for node, key in aligners[reference].blocks(parse(source))])
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(out, _SEEN)], names=["host", "kind", "pages", "h", "seen"])

    seen = every.mapInArrow(align, "host string, kind string, pages long, h long, seen array<struct<node:int,key:long>>").dropDuplicates(["host", "kind", "h"])
    counted = seen.select("host", "kind", "pages", F.inline("seen")).groupBy("host", "kind", "pages", "node", "key").agg(F.count("*").alias("n"))
    learned = cut(counted.where(F.col("n") * 100 >= F.col("pages") * SHARE).groupBy("host", "kind", "pages").agg(F.collect_set("key").alias("template")))
    alone = learned.where("kind <> ''")
    largest = alone.groupBy("host").agg(F.max_by("template", F.struct("pages", "kind")).alias("template"))
    rest = learned.where("kind = ''").select("host", "template").unionByName(largest).groupBy("host").agg(F.array_distinct(F.flatten(F.collect_list("template"))).alias("template"))
    return alone.select("host", "kind", "template").unionByName(rest.select("host", F.lit("").alias("kind"), "template"))


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for every row of ``pages``."""
    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    chosen = chosen.withColumn("host", host_of()).withColumn("layout", layout_of()).withColumn("h", F.xxhash64("html"))
    known = kinds(chosen)
    own = known.where("kind <> ''").select("host", F.col("kind").alias("layout"), F.lit(True).alias("own"))
    chosen = chosen.join(own, ["host", "layout"], "left").withColumn("kind", F.when(F.col("own"), F.col("layout")).otherwise(""))
    learned = cut(wrappers(chosen, known))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "html", 8 << 20):
                texts = [extract(source or "", frozenset(template or ())) for source, template in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return chosen.join(learned, ["host", "kind"], "left").select("page_id", "url", "html", "template").mapInArrow(read, "page_id long, url string, text string")
