"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton holds every normalised item; a document's words stream through it, and the length
of the longest item substring that ends at each word is tracked. Where it reaches ``window``
words (or all of an item of fewer), those words are hit. Hit words merge into spans; ``clean``
removes spans of at least ``min_span`` words, and drops nothing else, unless more than
``max_coverage`` of a document is hit: then all of it goes.

How it scales. Documents are not shuffled: each task streams its own. The item set is checked
against ``max_item_words``: up to that, one automaton is broadcast; beyond it, items are dealt
into blocks of that size and the documents are read once for each block. Words that no item
holds end every match, so only runs of item words as long as the shortest window are streamed;
finding these runs is vectorised.

Edge cases. Null texts have no words; items without words are left out; equal items are all
reported; null item ids are left out of the list but their words still hit. No items: no hits. A very
long text is one block, in memory alone. Repeated rows each keep their row, in any number of blocks.
An empty table gives an empty one. Further columns are carried along whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm import _shared as sh
from meridia.llm import _tokens as tk

WINDOW = 10
MAX_ITEM_WORDS = 400_000
MIN_SPAN, MAX_COVERAGE = 1, 0.5


class Automaton:
    """A generalised suffix automaton over word numbers, with the items of each window."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ids: list[object] = []
        self.shortest = window
        self.whole: dict[int, dict[int, list[int]]] = {}
        ends: dict[int, list[int]] = {}
        for name, item in items:
            if not item:
                continue
            k = len(self.ids)
            self.ids.append(name)
            last = 0
            for n, w in enumerate(item, 1):
                last = self._extend(last, self.vocab.setdefault(w, len(self.vocab)))
                if n >= window:
                    ends.setdefault(last, []).append(k)
            if len(item) < window:
                self.shortest = min(self.shortest, len(item))
                ends.setdefault(last, [])
                self.whole.setdefault(last, {}).setdefault(len(item), []).append(k)
        # A state's items are those whose prefixes end in it or below it in the link tree.
        self.items: dict[int, set[int]] = {s: set(k) for s, k in ends.items() if k}
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if s in self.items and self.link[s] > 0 and self.length[self.link[s]] >= window:
                self.items.setdefault(self.link[s], set()).update(self.items[s])
        self._fix_whole(items)
        self._above: dict[int, list[tuple[int, list[int]]]] = {}

    def _fix_whole(self, items: list[tuple[object, list[bytes]]]) -> None:
        """Later clones may move an item's end: walk each short item again."""
        self.whole, k = {}, 0
        for _, item in items:
            if not item:
                continue
            if len(item) < self.window:
                s = 0
                for w in item:
                    s = self.next[s][self.vocab[w]]
                self.whole.setdefault(s, {}).setdefault(len(item), []).append(k)
            k += 1

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q)
        cur = len(link)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(link)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def whole_above(self, state: int) -> list[tuple[int, list[int]]]:
        """(length, items) of whole short items that end where this state's strings end."""
        got = self._above.get(state)
        if got is None:
            got, s = [], state
            while s > 0:
                got += list(self.whole.get(s, {}).items())
                s = self.link[s]
            self._above[state] = got
        return got

    def stream(self, run: list[int]) -> Iterator[tuple[int, int, set[int] | list[int]]]:
        """(end, length, items) of every item window that ends in this run of word numbers."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = have = 0
        short = bool(self.whole)
        for at, c in enumerate(run, 1):
            while state and c not in nxt[state]:
                state = link[state]
                have = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                have += 1
            else:
                have = 0
                continue
            if short:
                for n, k in self.whole_above(state):
                    if n <= have:
                        yield at, n, k
            if have >= window:
                # Shrink to the state of the last ``window`` words; a longer match isn't needed for what follows.
                s = state
                while length[link[s]] >= window:
                    s = link[s]
                yield at, window, self.items.get(s, ())
        return


def item_words(texts: list[str | None]) -> list[list[bytes]]:
    """The normalised words of each text."""
    out: list[list[bytes]] = []
    for _, _, data, offs in tk.blocks(pa.array(texts, pa.string())):
        low = tk.LOWER[data]
        starts, ends, first = tk.words(low, offs, tk.ALNUM)
        flat = low.tobytes()
        got = [flat[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        out += [got[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    return out


def hit_rows(shared, cut: tuple[int, float] | None = None, again: bool = False):
    """Arrow batches of (doc_id, text, …) to the same with n_words, n_hit, spans and items; cut as in contamination().

    Batches that have these columns already keep their hits and gain this automaton's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto: Automaton = shared.value
        names = [None if k is None else str(k) for k in auto.ids]
        known = sorted(auto.vocab, key=auto.vocab.__getitem__)
        table = np.empty(0, tk.U64)
        if known:
            flat = b"".join(known)
            edges = np.cumsum([0, *map(len, known)])
            table = tk.span_hash(np.frombuffer(flat, np.uint8), edges[:-1], edges[1:])
        order = np.argsort(table)
        table = table[order]
        for batch in batches:
            before = None
            if again:
                before = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
                batch = batch.select(batch.schema.names[:-4])
            for i, j, raw, offs in tk.blocks(batch.column("text")):
                data = tk.LOWER[raw]
                starts, ends, first = tk.words(data, offs, tk.ALNUM)
                n, docs = len(starts), j - i
                hits: list[set[str]] = [set() for _ in range(docs)]
                mark = np.zeros(n + 1, np.int64)
                if before is not None:
                    for doc, (old, named) in enumerate(zip(before[0][i:j], before[1][i:j], strict=True)):
                        hits[doc].update(named)
                        for x, y, _, _ in old:
                            mark[first[doc] + x] += 1
                            mark[first[doc] + y] -= 1
                if n and len(table):
                    hashes = tk.span_hash(data, starts, ends)
                    where = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
                    inside = table[where] == hashes
                    edge = inside.copy()
                    edge[1:] &= ~inside[:-1]
                    new = first[(first > 0) & (first < n)]
                    edge[new] = inside[new]
                    begin = np.flatnonzero(edge)
                    stop = np.zeros(n, bool)
                    stop[:-1] = inside[:-1] & (~inside[1:] | edge[1:])
                    stop[-1] = inside[-1]
                    end = np.flatnonzero(stop) + 1
                    long = end - begin >= auto.shortest
                    owner = tk.owners(first)
                    numbers = order[where]
                    for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True):
                        doc = int(owner[a])
                        for at, length, items in auto.stream(numbers[a:b].tolist()):
                            mark[a + at - length] += 1
                            mark[a + at] -= 1
                            hits[doc].update(names[k] for k in items if names[k] is not None)
                hit = np.cumsum(mark[:n]) > 0
                count = np.zeros(n + 1, np.int64)
                np.cumsum(hit, out=count[1:])
                spans = [[] for _ in range(docs)]
                for d in np.flatnonzero(count[first[1:]] > count[first[:-1]]).tolist():
                    a, b = int(first[d]), int(first[d + 1])
                    change = np.flatnonzero(np.diff(np.r_[False, hit[a:b], False]))
                    for x, y in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):
                        spans[d].append([x, y, int(starts[a + x] - offs[d]), int(ends[a + y - 1] - offs[d])])
                rows = batch.slice(i, docs)
                out = pa.RecordBatch.from_arrays(
                    [
                        *rows.columns,
                        pa.array(np.diff(first)),
                        pa.array(count[first[1:]] - count[first[:-1]]),
                        pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                        pa.array([sorted(h) for h in hits], pa.list_(pa.string())),
                    ],
                    names=[*rows.schema.names, "n_words", "n_hit", "spans", "items"],
                )
                if cut is None:
                    yield out
                else:
                    yield from cut_rows(*cut)(iter([out]))

    return run


def _blocks_of(items: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items in blocks of at most limit words, each made when asked for."""
    block: list[tuple[object, list[bytes]]] = []
    have = 0
    rows = items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator()
    for row in rows:
        w = item_words([row.t])[0]
        if block and have + len(w) > limit:
            yield block
            block, have = [], 0
        block.append((row.i, w))
        have += len(w)
    yield block


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_item_words: int = MAX_ITEM_WORDS, keep: tuple[str, ...] = (), cut: tuple[int, float] | None = None) -> DataFrame:
    """doc_id, text, n_words, n_hit, spans [[word, end, byte, end]] and items of each document.

    keep names further columns of docs to carry along. With cut, (least span, most coverage), the
    text is what clean() leaves of it, null if nothing.
    """
    sh.small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    base = docs.select("doc_id", "text", *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", n_words long, n_hit long, spans array<array<long>>, items array<string>"
    blocks = _blocks_of(items, "item_id", "text", max_item_words)
    block, rows, old = next(blocks), base, None
    while block is not None:
        shared, block = sc.broadcast(Automaton(block, window)), next(blocks, None)
        # The last block, as a rule the only one, is cut in the pass that finds its hits.
        rows = rows.mapInArrow(sh.frugal(hit_rows(shared, cut if block is None else None, old is not None)), schema)
        if block is not None:
            rows = sh.written(rows, "item-block")
            shared.destroy()
            if old is not None:
                sh.drop_written(old)
            old = rows
    return rows


def cut_rows(min_span: int, max_coverage: float):
    """Batches with text and spans to the same with the text without them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts = batch.column("text").to_pylist()
            spans = batch.column("spans").to_pylist()
            n_words, n_hit = batch.column("n_words").to_pylist(), batch.column("n_hit").to_pylist()
            out = []
            for t, s, n, h in zip(texts, spans, n_words, n_hit, strict=True):
                if not h:
                    out.append(t)
                elif h > max_coverage * n:
                    out.append(None)
                else:
                    raw, at, parts = t.encode(), 0, []
                    for x, y, a, b in sorted(s):
                        if y - x >= min_span and b > at:
                            parts.append(raw[at : max(at, a)])
                            at = b
                    parts.append(raw[at:])
                    out.append(b"".join(parts).decode())
            cols = [pa.array(out, pa.string()) if k == "text" else batch.column(k) for k in names]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, min_span: int = MIN_SPAN, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """docs without contaminated spans; a document hit for more than max_coverage of its words goes."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    base = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    found = contamination(base, items, window, keep=tuple(names.values()), cut=(min_span, max_coverage))
    cut = found.where("not (n_hit > 0 and text is null)")
    return cut.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def op4_decontamination(spark, sf_dir) -> DataFrame:
    """Contract query: words of each whole document inside item windows."""
    found = contamination(sh.documents(spark, sf_dir), sh.documents(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS k
       FROM (SELECT item_id, w, least({WINDOW}, len(w)) AS n, unnest(range(1, CAST(len(w) - least({WINDOW}, len(w)) + 2 AS BIGINT))) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT doc_id, dw.n, p, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.n = iw.n),
words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM h) GROUP BY doc_id),
named AS (SELECT doc_id, string_agg(s, ',' ORDER BY s) AS ids, count(*) AS n FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""
