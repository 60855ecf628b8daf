"""Near-duplicate detection by Order MinHash, verified by banded alignment.

Words are runs of ASCII letters (in lower case), digits and characters beyond ASCII. A document is
its sequence of ``k``-word shingles, each labelled by its occurrence number, so that a labelled
shingle appears once. An Order MinHash sketch takes the ``pick`` labelled shingles of smallest hash
and keeps their order in the text; it is sensitive to edits and moves. ``rows`` sketches make a
band key, and texts that share one of ``bands`` keys are candidates.

A candidate pair is verified by aligning the two shingle sequences: matching labelled shingles at
most a band apart form the longest common subsequence L, and the similarity L / (n + m - L), the
Jaccard similarity of what is in order, must be ``similarity`` or more. No pair of that similarity
leaves the band. Texts of fewer than k words have one shingle, all their words; equal word
sequences are copies whatever their length.

Classes are the connected components of verified links. Copies are collapsed before anything else.
In a bucket of candidates pairs are tested star by star: leaders, those with most neighbours in
buckets first, against all members of other components; a leader then retires, so each pair of a
bucket is tested or already in one component. The number of leaders grows each round, and buckets
of at most ``ALL_PAIRS`` texts are tested at once. Two exact bounds spare the scattered members of a
large group. A text carries a parity sketch, ``PARITY`` bits that each labelled shingle flips one of:
bits that differ are at most the shingles that only one text has, so a pair is dropped in the join
when too many differ. And from the second round on, a text's shingles that a text of another
component has are counted; one with too few of them takes part no more. Nothing is capped: rounds go
on until no pair is left. Links, components and buckets stay in DataFrames. What a round leaves to the
next, buckets and components, and the candidates' texts are written tables, removed when no later round
needs them; sketches and what is read again within a round stay on executors' disks, where lost parts
are made anew.

Edge cases. Null text and text without words are in classes of their own rows (equal rows without
words still share one). Null ids take part; a class has its smallest id that isn't null. Very long
texts are whole sequences, one at a time in memory. Of rows with equal id and text the one whose
other columns hash lowest stays. Ties in rank go to the smaller id, then the smaller hash. An empty
table gives an empty one; further columns, whatever their names, are carried along.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.llm import _shared as sh
from meridia.llm import _tokens as tk

K, SIMILARITY = 5, 0.8
BANDS, ROWS, PICK = 16, 2, 2
ALL_PAIRS, LEADERS = 8, 1
PARITY = 512
HELD, ROWS_OUT = 1 << 19, 1 << 14
WORDS = [f"p{i}" for i in range(PARITY // 64)]


def shingles(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(labelled shingle hashes, text of each, word hashes, first word of each text)."""
    low = tk.LOWER[data]
    starts, ends, first = tk.words(low, offs, tk.ALNUM)
    hashes = tk.span_hash(low, starts, ends)
    counts = np.diff(first)
    own = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), own)
    begin = np.arange(len(owner)) - np.repeat(np.cumsum(own) - own, own) + first[:-1][owner]
    end = np.minimum(begin + k, first[1:][owner])
    g = tk.range_hash(hashes, begin, end)
    # Occurrence numbers within a text, in text order.
    order = np.lexsort((np.arange(len(g)), g, owner))
    new = np.ones(len(g), bool)
    new[1:] = (g[order][1:] != g[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    at = np.arange(len(g))
    label = np.empty(len(g), np.int64)
    label[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return tk.mix(g + label.astype(tk.U64) * tk.U64(0xA24BAED4963EE407)), owner, hashes, first


def band_keys(labelled: np.ndarray, owner: np.ndarray, docs: int, bands: int, rows: int, pick: int) -> np.ndarray:
    """docs x bands keys of Order MinHash sketches; texts without shingles have zeros."""
    out = np.zeros((docs, bands), tk.U64)
    have = np.unique(owner)
    if not len(have):
        return out
    cut = np.searchsorted(owner, have)
    slot = np.repeat(np.arange(len(have)), np.diff(np.r_[cut, len(owner)]))
    top = tk.U64(tk.MASK)
    for b in range(bands):
        key = np.full(len(have), b + 1, tk.U64)
        for r in range(rows):
            h = tk.mix(labelled ^ tk.U64(((b * rows + r + 1) * 0x9FB21C651E98DF25) & tk.MASK))
            at = np.full((pick, len(have)), len(labelled))
            for p in range(pick):
                least = np.minimum.reduceat(h, cut)
                where = np.flatnonzero((h == least[slot]) & (h != top))
                at[p, slot[where][::-1]] = where[::-1]
                h[where] = top
            at.sort(axis=0)
            for p in range(pick):
                value = np.where(at[p] < len(labelled), labelled[np.minimum(at[p], len(labelled) - 1)], tk.U64(7))
                key = tk.mix(key * tk.U64(0x9E3779B97F4A7C15) + value)
        out[have, b] = key
    return out


def parity(labelled: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """docs x PARITY / 64 words: each labelled shingle flips one bit."""
    bit = (tk.mix(labelled ^ tk.U64(0x5851F42D4C957F2D)) % tk.U64(PARITY)).astype(np.int64)
    odd = np.bincount(owner * PARITY + bit, minlength=docs * PARITY) & 1
    return np.packbits(odd.astype(np.uint8).reshape(docs, PARITY), axis=1, bitorder="little").view("<i8")


def sketch_rows(k: int, bands: int, rows: int, pick: int):
    """Arrow batches (doc_id, rk, text) to (doc_id, rk, sig, n, keys, parity words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in tk.blocks(batch.column("text")):
                labelled, owner, hashes, first = shingles(data, offs, k)
                docs = j - i
                low = tk.LOWER[data]
                starts, ends, _ = tk.words(low, offs, tk.ALNUM)
                second = tk.span_hash(low, starts, ends, tk.BYTE_BASE_2)
                sig = np.stack([tk.range_hash(hashes, first[:-1], first[1:]), tk.range_hash(second, first[:-1], first[1:], tk.WORD_BASE_2)], axis=1)
                keys = tk.signed(band_keys(labelled, owner, docs, bands, rows, pick).ravel())
                n = np.bincount(owner, minlength=docs)
                full = np.where(n > 0, bands, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(full)].astype(np.int32)), pa.array(keys.reshape(docs, bands)[n > 0].ravel()))
                raw = sig.astype(">u8").tobytes()
                bits = parity(labelled, owner, docs)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(i, docs) for c in ("doc_id", "rk")),
                        pa.array([raw[x : x + 16] for x in range(0, 16 * docs, 16)], pa.binary()),
                        pa.array(n.astype(np.int64)),
                        lists,
                        *(pa.array(np.ascontiguousarray(bits[:, w])) for w in range(len(WORDS))),
                    ],
                    names=["doc_id", "rk", "sig", "n", "keys", *WORDS],
                )

    return run


def aligned(a: np.ndarray, b: np.ndarray) -> float:
    """Length of the banded common subsequence of two labelled sequences, as a similarity."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    order = np.argsort(b)
    at = np.minimum(np.searchsorted(b[order], a), m - 1)
    hit = np.flatnonzero(b[order][at] == a)
    j = order[at[hit]]
    # L >= s (n + m) / (1 + s) leaves at most (1 - s) (n + m) / (1 + s) unmatched, which bounds the drift.
    band = int(np.ceil((1 - SIMILARITY) / (1 + SIMILARITY) * (n + m))) + 1
    j = j[np.abs(hit - j) <= band]
    if not len(j):
        return 0.0
    if (j[1:] > j[:-1]).all():
        length = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            p = bisect_left(tails, x)
            if p == len(tails):
                tails.append(x)
            else:
                tails[p] = x
        length = len(tails)
    return length / (n + m - length)


def verify_rows(k: int, similarity: float):
    """Arrow batches (a, b, text_a, text_b) to the (a, b) that are similar enough."""

    def sequences(column: pa.Array) -> list[np.ndarray]:
        out = []
        for i, j, data, offs in tk.blocks(column):
            labelled, owner, _, _ = shingles(data, offs, k)
            out += np.split(labelled, np.searchsorted(owner, np.arange(1, j - i)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                one, two = part.column("text_a"), part.column("text_b")
                keep = [aligned(x, y) >= similarity for x, y in zip(sequences(one), sequences(two), strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def components(edges: DataFrame) -> DataFrame:
    """node and its component's smallest node, of (a, b) edges, by alternating stars in written tables."""
    edges = edges.where("a != b")
    edges = sh.held(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    rows = edges.count()
    edges, first = sh.written(edges, "edges", rows), edges
    first.unpersist()
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        # A step never makes more links than there were.
        nxt = sh.written(small.where("a != b").distinct(), "edges", rows)
        # Stars: every node has one link, to a node that has none upwards.
        lows = nxt.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        done = not lows.where("n > 1").take(1) and not nxt.select("a").distinct().join(nxt.select(F.col("b").alias("a")).distinct(), "a", "left_semi").take(1)
        sh.drop_written(edges)
        edges = nxt
        if done:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _ranked(buckets: DataFrame, label: DataFrame | None, leaders: int, all_pairs: int) -> DataFrame:
    """Buckets of more than one component, with component c and whether a node leads."""
    if label is None:
        rows = buckets.withColumn("c", F.col("node"))
    else:
        rows = buckets.join(label.select("node", "component"), "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    bucket = Window.partitionBy("key")
    rows = rows.withColumn("of_c", F.count(F.lit(1)).over(Window.partitionBy("key", "c"))).withColumn("m", F.count(F.lit(1)).over(bucket)).where("of_c < m")
    rank = F.row_number().over(bucket.orderBy("of_c", F.desc("hub"), "doc", "node"))
    return rows.withColumn("rank", rank).withColumn("leads", (F.col("m") <= all_pairs) | (F.col("rank") <= leaders))


def _combined(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """(shingle, node, component) triples by shingle: distinct shingles, where each begins, triples in order, and whether it has one component."""
    h, node, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((c, h))
    h, node, c = h[order], node[order], c[order]
    begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    end = np.r_[begin[1:], len(h)] - 1
    return h[begin], begin, node, c, c[begin] == c[end]


def shingle_rows(k: int, size: int = HELD):
    """Arrow batches (node, c, text) to a (h, c, nodes) for each labelled shingle of some texts.

    c and nodes are those that have it; both are null if several components do, as no text then owns it.
    """

    def rows(keys: list[pa.Array], parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        names = pa.concat_arrays(keys)
        h, begin, node, c, one = _combined(parts)
        counts = np.diff(np.r_[begin, len(node)])
        own = np.repeat(one, counts)
        # A text has a labelled shingle once, so nodes are distinct.
        for i in range(0, len(h), ROWS_OUT):
            at = slice(i, i + ROWS_OUT)
            inner = slice(begin[i], begin[i + ROWS_OUT] if i + ROWS_OUT < len(h) else len(node))
            offsets = np.r_[0, np.cumsum(np.where(one[at], counts[at], 0))].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), names.take(pa.array(node[inner][own[inner]])), mask=pa.array(~one[at]))
            yield pa.RecordBatch.from_arrays([pa.array(tk.signed(h[at])), names.take(pa.array(c[begin[at]], mask=~one[at])), lists], names=["h", "c", "nodes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[pa.Array] = []
        known: dict[bytes, int] = {}
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def places(column: pa.Array) -> np.ndarray:
            found = np.empty(len(column), np.int64)
            fresh = []
            for i, x in enumerate(column.to_pylist()):
                if x not in known:
                    known[x] = len(known)
                    fresh.append(x)
                found[i] = known[x]
            keys.append(pa.array(fresh, column.type))
            return found

        for batch in batches:
            node, c = places(batch.column("node")), places(batch.column("c"))
            for i, j, data, offs in tk.blocks(batch.column("text")):
                labelled, owner, _, _ = shingles(data, offs, k)
                parts.append((labelled, node[i:j][owner], c[i:j][owner]))
                held += len(labelled)
            if held >= size:
                yield from rows(keys, parts)
                keys, known, parts, held = [], {}, [], 0
        if held:
            yield from rows(keys, parts)

    return run


def _own_counts(nodes: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """node and own of nodes (node, c): how many of its shingles no node of another component has.

    The overlap of two texts of different components is at most what either has besides its own. Shingles
    are combined where they are made, so copies of a passage are one row of a task, and meet once.
    """
    rows = texts.join(nodes, "node").select("node", "c", "text").mapInArrow(sh.frugal(shingle_rows(k)), "h long, c binary, nodes array<binary>")
    met = rows.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count_if(F.col("c").isNull()).alias("shared"))
    own = met.where("shared = 0 and lo = hi").select("h")
    return rows.where("c is not null").join(own, "h", "left_semi").select(F.explode("nodes").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("own"))


def _latest(rows: DataFrame, label: DataFrame | None) -> DataFrame:
    """node and its component c by now."""
    nodes = rows.select("node").distinct()
    if label is None:
        return nodes.withColumn("c", F.col("node"))
    return nodes.join(label.select("node", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("c"))


def _pairs(ranked: DataFrame, similarity: float) -> DataFrame:
    """Distinct (a, b) of leaders and bucket members that the exact bounds allow."""
    cols = ["node", "c", "n", "s", *WORDS]
    a = ranked.where("leads").select("key", *[F.col(x).alias(f"a_{x}") for x in cols])
    b = ranked.select("key", *[F.col(x).alias(f"b_{x}") for x in cols])
    # An overlap of L needs L >= similarity (n + m) / (1 + similarity), and both sides to share as much;
    # what only one side has, n + m - 2 L, is at least the number of differing parity bits.
    both = F.col("a_n") + F.col("b_n")
    enough = F.least("a_s", "b_s") * (1 + similarity) >= similarity * both
    differ = sum((F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}"))) for w in WORDS[1:]), F.bit_count(F.col(f"a_{WORDS[0]}").bitwiseXOR(F.col(f"b_{WORDS[0]}"))))
    close = differ * (1 + similarity) <= (1 - similarity) * both
    pairs = a.join(b, "key").where((F.col("a_c") != F.col("b_c")) & enough & close)
    return pairs.select(F.greatest("a_node", "b_node").alias("a"), F.least("a_node", "b_node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = K, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, pick: int = PICK) -> DataFrame:
    """doc_id, rk, class_id, class_size and stays of every row.

    class_id is the smallest doc_id of the class; rows of equal id and text have equal rk, and stays
    marks those that a class keeps.
    """
    sh.small_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).withColumn("rk", sh.row_key())
    words = ", ".join(f"{w} long" for w in WORDS)
    sketches = base.select("doc_id", "rk", "text").mapInArrow(sh.frugal(sketch_rows(k, bands, rows, pick)), f"doc_id long, rk binary, sig binary, n long, keys array<long>, {words}")
    sketches = sh.held(sketches)
    doc = F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc")
    nodes = sketches.where("n > 0").groupBy("sig").agg(F.min(F.struct(doc, "rk", "n", "keys", *WORDS)).alias("s")).select(F.col("sig").alias("node"), "s.*")
    nodes = sh.held(nodes)
    exploded = nodes.select("node", F.explode("keys").alias("key")).distinct()
    shared_keys = exploded.groupBy("key").agg(F.count(F.lit(1)).alias("in_bucket")).where("in_bucket > 1")
    members = sh.held(exploded.join(shared_keys, "key"))
    hub = members.groupBy("node").agg(F.sum("in_bucket").alias("hub"))
    # Texts of candidates only, written once: what is held would keep its exchanges too.
    wanted = nodes.select("node", "rk").join(hub.select("node"), "node", "left_semi")
    texts = sh.written(base.select("rk", "text").join(wanted.hint("shuffle_hash"), "rk").dropDuplicates(["node"]).select("node", "text"), "texts")
    carried = nodes.join(hub, "node").select("node", "doc", "n", "hub", F.col("n").alias("s"), *WORDS)
    buckets = sh.written(members.select("key", "node").join(carried, "node").select("key", *carried.columns), "buckets", members.count())
    members.unpersist()
    nodes.unpersist()
    columns = buckets.columns
    label: DataFrame | None = None
    leaders = LEADERS
    while True:
        ranked = sh.held(_ranked(buckets, label, leaders, ALL_PAIRS))
        rows_left = ranked.count()
        if not rows_left:
            break
        pairs = _pairs(ranked, similarity)
        with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        with_b = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        new = sh.held(with_b.select("a", "b", "text_a", "text_b").mapInArrow(sh.frugal(verify_rows(k, similarity)), "a binary, b binary"))
        before = label
        if new.take(1):
            links = new if before is None else new.unionByName(before.select(F.col("node").alias("a"), F.col("component").alias("b")))
            label = components(links)
        rest = ranked.where(~F.col("leads"))
        if leaders == LEADERS and rest.take(1):
            counts = _own_counts(_latest(rest, label), texts, k)
            rest = rest.join(counts, "node", "left").withColumn("s", F.col("n") - F.coalesce("own", F.lit(0))).where(F.col("s") >= similarity * F.col("n"))
        old, buckets = buckets, sh.written(rest.select(*columns), "buckets", rows_left)
        # The plans of this round are done with these.
        ranked.unpersist()
        new.unpersist()
        sh.drop_written(old, *([before] if before is not None and before is not label else []))
        leaders *= 64
    ranked.unpersist()
    sh.drop_written(buckets, texts)
    found = sketches.select("doc_id", "rk", F.when(F.col("n") > 0, F.col("sig")).otherwise(F.concat(F.lit("row").cast("binary"), F.col("rk"))).alias("node"))
    if label is not None:
        found = found.join(label, "node", "left").select("doc_id", "rk", F.coalesce("component", "node").alias("component"))
    else:
        found = found.withColumnRenamed("node", "component")
    last = F.coalesce("doc_id", F.lit(2**63 - 1))
    least = found.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), F.min(F.struct(last, "rk")).alias("first"))
    return found.join(least, "component").select("doc_id", "rk", "class_id", "class_size", (F.col("first.rk") == F.col("rk")).alias("stays"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each class: the one of the smallest id, and one row of that id."""
    keep = near_duplicates(docs, **options).where("stays").select("rk").distinct()
    other = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    base = docs.select(sh.row_key().alias("rk"), F.xxhash64(*other, F.lit(0)).alias("tie"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = base.join(keep.hint("shuffle_hash"), "rk", "left_semi").groupBy("rk").agg(F.min_by("row", "tie").alias("row"))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op2_minhash_dedup(spark, sf_dir) -> DataFrame:
    """The class of every document and the number of documents in it."""
    return near_duplicates(sh.documents(spark, sf_dir)).select("doc_id", "class_id", "class_size")
