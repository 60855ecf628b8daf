"""Main text of web pages by wrapper induction.

A page is parsed into a tree of elements and text. Its *layout* is the path (tags and classes) of its
densest element, so pages of one host that are built differently go apart. For each host and layout

- the text of every node, with its path, is counted over all pages in Spark: what ``constant_share``
  of the distinct pages hold, and ``constant_pages`` of them at least, is template;
- ``pages_per_layout`` distinct pages (of the lowest hashes) are aligned with the first by simple tree
  matching: children are matched in order so that the number of matched nodes is largest. A node
  whose partner has the same text, or that is template, is constant; other text varies. The content
  slot is the deepest path of a container with ``share`` of the varying text that isn't in links,
  never a menu, header, footer, sidebar, notice, advert, form, script, style or comment section; if
  an article or main element lies on the way to it, the outermost such element.

The text of a page is that of all elements at the content slot of its layout, without template. Only
a page whose layout has one known page, or that has nothing in the slot, uses its outermost article
and main elements instead, or else its densest element. Within the content, blocks are cut at block
elements, white space becomes one space, and elements of the kinds above go. Nothing else is dropped.

Tree matching is exact and unbounded: equal shapes are weighed once, so its cost follows the number of
distinct shapes; a pair of very long child lists is matched in halves, in memory linear in their length.
The parser is linear: a tag that never ends is looked for once.

How it scales. One pass parses every page and writes its blocks with their paths; what follows reads
these. Counts combine before their exchange and are keyed by text, so a host with a third of all pages
spreads. Aligned pages are chosen by a bound on their hash that follows from the layout's count, before
any are ranked. Wrappers are small rows, joined by host and layout; Spark broadcasts them only if their
measured size is below its threshold.

Edge cases. Null or empty html has no text. Null or odd urls are hosts without a wrapper. Pages nested
thousands deep and pages of any length are parsed whole, without recursion; below 512 levels elements
become siblings, as browsers have it. Repeated rows each give
their row, but count once in wrappers. Ties between slots go to the path that sorts last, between pages
to the smaller hash. An empty table gives an empty one; further columns aren't read, so none can clash.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.llm import _shared as sh

PAGES_PER_LAYOUT, SHARE, CONSTANT_PAGES, CONSTANT_SHARE = 6, 0.75, 4, 0.9
#: Cells of a matching table; longer pairs of child lists are matched in halves.
TABLE = 1 << 22

#: Elements nested deeper become siblings at that depth, as in browsers.
DEPTH = 512

MARKUP = re.compile(r"<(?=[a-zA-Z/!?])")
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^'">]++)*+)>""", re.S)
#: A tag with a quote that never ends.
LOOSE_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)([^>]*+)>")
DIGITS = re.compile(r"\d+")
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp svg math object select canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSERS = {tag: re.compile(rf"</{tag}(?:[\s/][^>]*)?(?:>|\Z)", re.I) for tag in RAW}
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "dd", "dt", "li", "summary", "legend", "figcaption"} | {"li", "dd", "dt"}
#: A start tag closes an open element of these, up to the scope on the right.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}),
}
OUT_TAGS = frozenset("nav footer header aside form button label input dialog menu head".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
OUT_NAME = re.compile(
    r"(?:^|\s|(?<!with)(?<!has)(?<!no)[_-])(?:ads?|advert\w*|adsense|adslot|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side-bar|widgets?|footer|foot|masthead|topbar|toolbar|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|subscribe|newsletter|signup|login|comments?|commentlist|disqus|respond|replies|reply|share|sharing|social\w*|related|recommend\w*|pagination|pager|skip-link|search\w*|paywall)(?:$|[\s_-])",
    re.I,
)
SPACE = re.compile(r"\s+")
CONTAINERS = frozenset("article main section div td body center root".split())


class Node:
    """An element (children) or a stretch of text (tag '#'). out: left out of the content; soft: for its name only."""

    __slots__ = ("tag", "name", "out", "soft", "children", "text", "shape", "path")

    def __init__(self, tag: str, name: str = "", out: bool = False, text: str = "", soft: bool = False):
        self.tag, self.name, self.out, self.text, self.soft = tag, name, out, text, soft
        self.children: list[Node] = []
        self.shape, self.path = 0, ""


def _element(tag: str, attributes: str) -> Node:
    found = {}
    for m in ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
    names = " ".join(x for x in (found.get("class", ""), found.get("id", "")) if x)
    soft = bool(names) and tag not in ("body", "html", "article", "main") and OUT_NAME.search(names) is not None
    out = tag in OUT_TAGS or found.get("role", "").lower() in OUT_ROLES or "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower() or found.get("itemprop", "") == "comment"
    kind = DIGITS.sub("", (found.get("class", "").split() or [""])[0]).strip("-_")
    return Node(tag, f"{tag}.{kind}" if kind else tag, out or soft, soft=soft and not out)


def parse(page: str) -> Node:
    """The tree of a page; unclosed and stray tags are put right roughly as browsers do."""
    root = Node("root", "root")
    root.path = "/root"
    stack, at, end = [root], 0, len(page)
    opened: Counter[str] = Counter()
    paths: dict[tuple[str, str], str] = {}
    doubtful = loose = False

    def text(s: str) -> None:
        if s and not s.isspace():
            stack[-1].children.append(Node("#", "#", text=entities.unescape(s) if "&" in s else s))
        elif s:
            stack[-1].children.append(Node("#", "#", text=" "))

    def shut(i: int) -> None:
        for n in stack[i:]:
            opened[n.tag] -= 1
        del stack[i:]

    while at < end:
        found = MARKUP.search(page, at)
        if found is None:
            text(page[at:])
            break
        here = found.start()
        m = None if loose and page[here + 1] not in "!?" else TAG.match(page, here)
        if m is None:
            if page.startswith("</", here) and not page[here + 2 : here + 3].isalpha():
                # Not a tag: a browser's comment, up to the next bracket.
                text(page[at:here])
                at = page.find(">", here) + 1 or end
                continue
            loose = True
            m = LOOSE_TAG.match(page, here) if page.find(">", here) >= 0 else None
            if m is None:
                # No bracket follows: the tag never ends, and the page with it.
                text(page[at:here])
                break
        text(page[at:here])
        at = m.end()
        if m[1] is None:
            if page.startswith("<![CDATA[", here):
                text(page[here + 9 : at - 3])
            continue
        tag = m[1].lower()
        if page[here + 1] == "/":
            if opened[tag] > 0:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        shut(i)
                        break
                    if stack[i].tag in ("article", "main", "body", "table", "td") and tag not in BLOCK:
                        break
            continue
        if tag in RAW:
            if not m[2].rstrip().endswith("/") or tag not in ("svg", "math"):
                close = CLOSERS[tag].search(page, at)
                at = close.end() if close else end
            continue
        if tag in CLOSES_P and opened["p"] > 0:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    shut(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in IMPLIED:
            closed, scope = IMPLIED[tag]
            if any(opened[t] > 0 for t in closed):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in scope:
                        break
                    if stack[i].tag in closed:
                        shut(i)
                        if tag in ("tr", "tbody", "thead", "tfoot"):
                            continue
                        break
        node = _element(tag, m[2]) if m[2] else Node(tag, tag, tag in OUT_TAGS)
        doubtful = doubtful or node.soft
        if len(stack) >= DEPTH:
            shut(DEPTH - 1)
        step = (stack[-1].path, node.name)
        node.path = paths.get(step) or paths.setdefault(step, "/".join(step))
        stack[-1].children.append(node)
        if tag not in VOID and not (m[2].endswith("/") and tag in ("path", "g")):
            stack.append(node)
            opened[tag] += 1
    if doubtful:
        letters = _below(root, lambda n: len(n.text))
        for node in _nodes(root):
            # A name like "with-sidebar" on the element that holds most of the page says little.
            if node.soft and 5 * letters[id(node)] > 2 * letters[id(root)]:
                node.out = False
    return root


def _nodes(root: Node) -> list[Node]:
    """All nodes, parents before children."""
    order = [root]
    for n in order:
        order += n.children
    return order


def _below(root: Node, weight) -> dict[int, int]:
    """The sum of weight at and below every node, by id."""
    order = _nodes(root)
    total = {}
    for n in reversed(order):
        total[id(n)] = weight(n) + sum(total[id(c)] for c in n.children)
    return total


class Matching:
    """Simple tree matching of trees whose equal shapes (names without texts) share a number."""

    def __init__(self) -> None:
        self.shapes: dict[tuple, int] = {}
        self.lists: list[list[int]] = []
        self.names: list[str] = []
        self.known: dict[tuple[int, int], int] = {}

    def number(self, root: Node) -> None:
        for n in reversed(_nodes(root)):
            key = (n.name, *(c.shape for c in n.children))
            if key not in self.shapes:
                self.shapes[key] = len(self.lists)
                self.lists.append([c.shape for c in n.children])
                self.names.append(n.name)
            n.shape = self.shapes[key]

    def weight(self, x: int, y: int) -> int:
        """Nodes of the largest matching of two shapes, roots matched; 0 if their names differ."""
        todo = [(x, y)]
        while todo:
            a, b = todo[-1]
            if (a, b) in self.known:
                todo.pop()
            elif self.names[a] != self.names[b]:
                self.known[todo.pop()] = 0
            else:
                missing = [(c, d) for c in set(self.lists[a]) for d in set(self.lists[b]) if self.names[c] == self.names[d] and (c, d) not in self.known]
                if missing:
                    todo += missing
                else:
                    self.known[todo.pop()] = 1 + int(self.last_row(self.lists[a], self.lists[b])[-1])
        return self.known[(x, y)]

    def weights(self, xs: list[int], ys: list[int]) -> np.ndarray:
        """Weights of each distinct shape of xs, in order of number, against every one of ys."""
        ys_of, place = np.unique(np.array(ys, np.int64), return_inverse=True)
        own = sorted(set(xs))
        table = np.array([[self.known.get((x, y), 0) if self.names[x] == self.names[y] else 0 for y in ys_of.tolist()] for x in own], np.int64).reshape(len(own), len(ys_of))
        return table[:, place]

    def rows(self, xs: list[int], ys: list[int]) -> Iterator[np.ndarray]:
        """Rows of the table of best sums of matched children, in order, one for each of xs."""
        row = np.zeros(len(ys) + 1, np.int64)
        yield row
        if not xs or not ys:
            yield from (row for _ in xs)
            return
        table, own = self.weights(xs, ys), {x: i for i, x in enumerate(sorted(set(xs)))}
        for x in xs:
            nxt = row.copy()
            np.maximum(row[1:], row[:-1] + table[own[x]], out=nxt[1:])
            row = np.maximum.accumulate(nxt)
            yield row

    def last_row(self, xs: list[int], ys: list[int]) -> np.ndarray:
        row = np.zeros(len(ys) + 1, np.int64)
        for row in self.rows(xs, ys):
            pass
        return row

    def aligned(self, xs: list[int], ys: list[int]) -> list[tuple[int, int]]:
        """Places of the matched children."""
        out, todo = [], [(0, len(xs), 0, len(ys))]
        while todo:
            i0, i1, j0, j1 = todo.pop()
            n, m = i1 - i0, j1 - j0
            if not n or not m:
                continue
            if n > 1 and n * m > TABLE:
                half = (i0 + i1) // 2
                up = self.last_row(xs[i0:half], ys[j0:j1])
                down = self.last_row(xs[half:i1][::-1], ys[j0:j1][::-1])[::-1]
                cut = j0 + int(np.argmax(up + down))
                todo += [(i0, half, j0, cut), (half, i1, cut, j1)]
                continue
            table = np.stack(list(self.rows(xs[i0:i1], ys[j0:j1])))
            while n and m:
                if table[n, m] == table[n - 1, m]:
                    n -= 1
                elif table[n, m] == table[n, m - 1]:
                    m -= 1
                else:
                    n, m = n - 1, m - 1
                    out.append((i0 + n, j0 + m))
        return out

    def pairs(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """Matched nodes of two numbered trees."""
        out, todo = [], [(a, b)] if a.name == b.name else []
        if todo:
            self.weight(a.shape, b.shape)
        while todo:
            x, y = todo.pop()
            out.append((x, y))
            todo += [(x.children[i], y.children[j]) for i, j in self.aligned(self.lists[x.shape], self.lists[y.shape])]
        return out


def matched(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Pairs of a simple tree matching: equal names, children in order, most nodes."""
    matching = Matching()
    matching.number(a)
    matching.number(b)
    return matching.pairs(a, b)


def squeezed(text: str) -> str:
    return SPACE.sub(" ", text).strip()


def text_key(path: str, text: str) -> int:
    """Spark's xxhash64 of a block's path and text."""
    h = xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(path.encode(), 42))
    return h - (1 << 64) if h >> 63 else h


def induce(pages: list[str], constant: frozenset[int] = frozenset(), share: float = SHARE) -> str | None:
    """The content slot (a path) of distinct pages of one layout, whose template texts are known."""
    trees = [parse(p) for p in pages]
    if len(trees) < 2:
        return None
    matching = Matching()
    for tree in trees:
        matching.number(tree)
    varying: Counter[str] = Counter()
    parents: dict[str, str] = {}
    first = trees[0]
    for other in trees[1:]:
        partner = {id(x): y for x, y in matching.pairs(first, other)}
        todo = [first]
        while todo:
            node = todo.pop()
            here = node.path
            for c in node.children:
                if c.tag == "#":
                    y = partner.get(id(c))
                    same = y is not None and y.text == c.text or text_key(here, squeezed(c.text)) in constant
                    if not same and not c.text.isspace():
                        varying[here] += len(c.text)
                elif not c.out:
                    parents[c.path] = here
                    if c.tag != "a":
                        todo.append(c)
    total = sum(varying.values())
    if not total:
        return None
    # Text below each path, then the deepest container with the share.
    below: Counter[str] = Counter()
    for path, n in varying.items():
        while path:
            below[path] += n
            path = parents.get(path, "")
    fits = [p for p, n in below.items() if n >= share * total and _tag(p) in CONTAINERS]
    if not fits:
        return None
    slot = max(fits, key=lambda p: (p.count("/"), p))
    names = slot.split("/")
    for i, name in enumerate(names):
        if name.partition(".")[0] in ("article", "main"):
            return "/".join(names[: i + 1])
    return slot


def _tag(path: str) -> str:
    return path.rpartition("/")[2].partition(".")[0]


def blocks(root: Node, kept: frozenset[int] = frozenset()) -> list[tuple[str, str, bool]]:
    """(path of the element that it begins in, text, whether that is in a kept element) of the blocks that aren't out."""
    out: list[tuple[str, str, bool]] = []
    line: list[str] = []
    where, blank = ("", False), True

    def flush() -> None:
        s = squeezed("".join(line))
        line.clear()
        if s:
            out.append((where[0], s, where[1]))

    todo: list[tuple[Node | None, str, bool]] = [(root, root.path, False)]
    while todo:
        n, here, within = todo.pop()
        if n is None:
            flush()
            blank = True
        elif n.tag == "#":
            if blank:
                where, blank = (here, within), n.text.isspace()
            line.append(n.text)
        elif n.tag == "br":
            line.append(" ")
        elif not n.out or n is root:
            here, within = n.path, within or id(n) in kept
            if n.tag in BLOCK:
                flush()
                blank = True
                todo.append((None, here, within))
            todo += [(c, here, within) for c in reversed(n.children)]
    flush()
    return out


def _density(root: Node) -> tuple[Node | None, list[Node]]:
    """(densest container, outermost article and main elements): text in links counts against it."""
    marked: list[Node] = []
    order: list[tuple[Node, bool, bool]] = [(root, False, False)]
    for node, linked, inner in order:
        linked, main = linked or node.tag == "a", node.tag in ("article", "main")
        if main and not inner:
            marked.append(node)
        order += [(c, linked, inner or main) for c in node.children if c.tag != "#" and not c.out]
    score: dict[int, float] = {}
    best, most = None, 0.0
    for node, linked, _ in reversed(order):
        own = sum(len(c.text.strip()) for c in node.children if c.tag == "#")
        score[id(node)] = (-own if linked or node.tag == "a" else own) + 0.9 * sum(score.get(id(c), 0.0) for c in node.children)
        if node.tag in CONTAINERS and score[id(node)] >= most and score[id(node)] > 0:
            best, most = node, score[id(node)]
    return best, marked


def read(page: str | None) -> tuple[str, list[tuple[str, str, bool]]]:
    """(layout, blocks with their paths and whether a page without wrapper keeps them)."""
    if not page:
        return "", []
    root = parse(page)
    best, marked = _density(root)
    kept = frozenset(id(n) for n in marked)
    found = blocks(root, kept)
    if best is not None and not any(within for _, _, within in found):
        found = blocks(root, frozenset([id(best)]))
    return best.path if best is not None else "", found


def extract(page: str | None, slot: str | None = None, constant: frozenset[int] = frozenset()) -> str:
    """The main text of one page, as main_text has it: blocks joined by an empty line."""
    found = read(page)[1]
    inside = [] if slot is None else [t for p, t, _ in found if f"{p}/".startswith(f"{slot}/") and text_key(p, t) not in constant]
    return "\n\n".join(inside or [t for _, t, within in found if within])


def host() -> F.Column:
    """The host of url, in lower case; null if it has none."""
    h = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1))
    return F.when(h != "", h)


PAGE = "page_id long, url string, host string, rk long, page long, layout string, paths array<string>, texts array<string>, kept array<boolean>"


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (page_id, url, host, rk, page, html) to PAGE."""
    for batch in batches:
        layouts, lists = [], ([], [], [])
        for page in batch.column(5):
            layout, found = read(page.as_py())
            layouts.append(layout)
            for column, values in zip(lists, zip(*found, strict=True) if found else ((), (), ()), strict=True):
                column.append(values)
        types = (pa.string(), pa.string(), pa.bool_())
        arrays = [pa.array(column, pa.list_(t)) for column, t in zip(lists, types, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(layouts, pa.string()), *arrays], names=[f.split(" ")[0] for f in PAGE.split(", ")])


def wrappers(pages: DataFrame, read_pages: DataFrame, per_layout: int = PAGES_PER_LAYOUT, share: float = SHARE, constant_pages: int = CONSTANT_PAGES, constant_share: float = CONSTANT_SHARE) -> DataFrame:
    """host, layout, slot and constant (keys of template texts) of layouts with two distinct pages at least.

    pages has rk and html, read_pages the rows of PAGE.
    """
    key = ["host", "layout"]
    known = read_pages.where("host is not null and layout != ''")
    distinct = known.groupBy(*key, "page").agg(F.min("rk").alias("rk"))
    of_layout = distinct.groupBy(*key).agg(F.count(F.lit(1)).alias("pages")).where("pages > 1")
    of_layout = sh.written(of_layout, "layouts")
    texts = known.select(*key, "page", F.explode(F.array_distinct(F.zip_with("paths", "texts", lambda p, t: F.xxhash64(p, t)))).alias("text"))
    counted = texts.groupBy(*key, "text").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= constant_pages)
    constant = counted.join(of_layout, key).where(F.col("n") >= constant_share * F.col("pages")).groupBy(*key).agg(F.sort_array(F.collect_list("text")).alias("constant"))
    constant = sh.written(of_layout.join(constant, key, "left"), "template")
    # A bound on the hash leaves a few times as many pages as are ranked, however many the layout has.
    space = 1 << 40
    near = distinct.join(of_layout, key).where(F.pmod("page", F.lit(space)) < F.least(F.lit(1.0), 4.0 * per_layout / F.col("pages")) * space)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.pmod("page", F.lit(space)), "page"))
    chosen = sh.written(near.withColumn("rank", rank).where(F.col("rank") <= per_layout).select(*key, "rank", "rk"), "aligned-pages")
    sample = pages.select("rk", "html").join(chosen, "rk").dropDuplicates([*key, "rank"]).join(constant.select(*key, "constant"), key)

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rank")
        first = part.iloc[0]
        template = frozenset(() if first["constant"] is None else (int(x) for x in first["constant"]))
        return pd.DataFrame({"host": [first["host"]], "layout": [first["layout"]], "slot": [induce(part["html"].tolist(), template, share)]})

    slots = sample.groupBy(*key).applyInPandas(learn, "host string, layout string, slot string")
    return constant.join(slots.where("slot is not null"), key).select(*key, "slot", F.coalesce("constant", F.array().cast("array<long>")).alias("constant"))


def main_text(pages: DataFrame, per_layout: int = PAGES_PER_LAYOUT, share: float = SHARE) -> DataFrame:
    """page_id, url and text of every page."""
    sh.small_batches(pages.sparkSession)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    base = base.select("page_id", "url", host().alias("host"), F.xxhash64("page_id", "url", "html").alias("rk"), F.xxhash64("html").alias("page"), "html")
    read_pages = sh.written(base.mapInArrow(sh.frugal(_read_rows), PAGE), "read-pages")
    learned = sh.written(wrappers(base, read_pages, per_layout, share), "wrappers")
    rows = read_pages.join(learned, ["host", "layout"], "left")
    found = F.arrays_zip("paths", "texts", "kept")
    inside = F.filter(found, lambda x: F.concat(x["paths"], F.lit("/")).startswith(F.concat("slot", F.lit("/"))) & ~F.array_contains("constant", F.xxhash64(x["paths"], x["texts"])))
    plain = F.filter(found, lambda x: x["kept"])
    rows = rows.select("page_id", "url", F.when(F.col("slot").isNotNull(), inside).alias("inside"), plain.alias("plain"))
    chosen = F.when(F.size(F.coalesce("inside", F.array().cast(rows.schema["plain"].dataType))) > 0, F.col("inside")).otherwise(F.col("plain"))
    return rows.select("page_id", "url", F.array_join(F.transform(chosen, lambda x: x["texts"]), "\n\n").alias("text"))


def op9_html_extract(spark, sf_dir) -> DataFrame:
    """Contract query: the main text of every page."""
    return main_text(sh.documents(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
