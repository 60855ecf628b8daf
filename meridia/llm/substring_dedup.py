"""Exact substring deduplication by Rabin-Karp hashes of every fixed-length word window.

A window of ``window`` words is repeated where its word sequence also starts earlier: in a
document of a smaller id, or earlier in the same one. Each word under a repeated window goes;
overlapping windows merge into maximal removal intervals.

How it scales. Every window is hashed, but only windows that can repeat are shuffled. Equal
windows hold equal inner ``inner``-word sequences, so the smallest inner hash of a window (its
anchor) repeats too. Stage 1 counts anchors, about one for seven words, in one exchange. Stage 2
hashes the windows over repeated anchors to 128 bits and finds the smallest document of each in
one exchange. Both pre-aggregate a batch first: of a hash that a batch holds more than once, one
row travels, so a passage in a third of all documents adds a row for each batch, not for each
document. Copies of a whole text are found first and take no part in either stage: all their
windows start earlier. Texts are exchanged once, by row key; every stage reuses that exchange.

Edge cases. Null text has no words. Null ids come after all others. Rows that share an id are
separate texts of equal rank: neither is earlier than the other. A very long text is one block, in
memory alone. Empty tables give no rows; columns other than doc_id and text aren't read, so none can
clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.llm import _shared as sh
from meridia.llm import _tokens as tk

WINDOW, INNER = 20, 8
LAST = 2**63 - 1


def _anchors(hashes: np.ndarray, first: np.ndarray, window: int, inner: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inner hashes, windows in one text, smallest inner hash of each window)."""
    valid = tk.inside(first, window, len(hashes))
    if not len(valid):
        return np.empty(0, tk.U64), valid, np.empty(0, tk.U64)
    g = tk.window_hash(hashes, inner)
    width, have, low = window - inner + 1, 1, g
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(g) - width + 1], low[width - have :])
    return g, valid, low[: len(valid)]


def anchor_rows(window: int, inner: int):
    """Arrow batches of (rk, text) to (part, known, rk, anchor): one row for each anchor and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("rk").to_numpy(zero_copy_only=False).astype(np.int64)
            docs, found = [], []
            for i, j, data, offs in tk.blocks(batch.column("text")):
                starts, ends, first = tk.words(data, offs, tk.SPACED)
                if len(starts) < window:
                    continue
                g, valid, low = _anchors(tk.span_hash(data, starts, ends), first, window, inner)
                chosen = np.zeros(len(g), bool)
                for s in range(window - inner + 1):
                    chosen[s : s + len(low)] |= (g[s : s + len(low)] == low) & valid
                at = np.flatnonzero(chosen)
                docs.append(keys[i:j][tk.owners(first)[at]])
                found.append(g[at])
            if not docs:
                continue
            rk, anchor = np.concatenate(docs), np.concatenate(found)
            order = np.lexsort((rk, anchor))
            rk, anchor = rk[order], anchor[order]
            same = anchor[1:] == anchor[:-1]
            many = np.zeros(len(anchor), bool)
            many[1:] |= same
            many[:-1] |= same
            lead = np.ones(len(anchor), bool)
            lead[1:] = ~same
            once = many.copy()
            once[1:] &= ~(same & (rk[1:] == rk[:-1]))
            out_rk = np.concatenate([rk[lead], rk[once]])
            out_anchor = tk.signed(np.concatenate([anchor[lead], anchor[once]]))
            known = np.concatenate([np.zeros(int(lead.sum()), bool), np.ones(int(once.sum()), bool)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(known, out_rk, out_anchor)), pa.array(known), pa.array(out_rk), pa.array(out_anchor)],
                names=["part", "known", "rk", "anchor"],
            )

    return run


def window_rows(window: int, inner: int):
    """Arrow batches of (rk, doc, text, anchors) to (part, known, rk, h1, h2, doc, pos, more).

    One row for each text and distinct window hash over a repeated anchor; ``more`` has the later
    positions of that hash in the text, which go whatever other texts hold. known: a smaller
    document in the batch holds it, so it goes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("rk").to_numpy(zero_copy_only=False).astype(np.int64)
            ids = batch.column("doc").to_numpy(zero_copy_only=False).astype(np.int64)
            lists = batch.column("anchors")
            parts: list[tuple[np.ndarray, ...]] = []
            for i, j, data, offs in tk.blocks(batch.column("text")):
                starts, ends, first = tk.words(data, offs, tk.SPACED)
                if len(starts) < window:
                    continue
                hashes = tk.span_hash(data, starts, ends)
                _, valid, low = _anchors(hashes, first, window, inner)
                at = np.flatnonzero(valid)
                want = lists.slice(i, j - i)
                who = np.repeat(np.arange(j - i), np.diff(want.offsets.to_numpy()))
                flat = want.flatten().to_numpy(zero_copy_only=False).view(tk.U64)
                owner = tk.owners(first)
                salt = tk.mix(np.arange(j - i).astype(tk.U64) + tk.U64(1))
                at = at[np.isin(low[at] ^ salt[owner[at]], flat ^ salt[who])]
                if not len(at):
                    continue
                h1 = tk.window_hash(hashes, window)[at]
                h2 = tk.window_hash(tk.span_hash(data, starts, ends, tk.BYTE_BASE_2), window, tk.WORD_BASE_2)[at]
                who = owner[at]
                parts.append((tk.signed(h1), tk.signed(h2), ids[i:j][who], keys[i:j][who], at - first[who], who + i))
            if not parts:
                continue
            h1, h2, doc, rk, pos, row = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((pos, row, doc, h2, h1))
            h1, h2, doc, rk, pos, row = (x[order] for x in (h1, h2, doc, rk, pos, row))
            same = np.zeros(len(h1), bool)
            same[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
            again = np.zeros(len(h1), bool)
            again[1:] = same[1:] & (row[1:] == row[:-1])
            smallest = doc[np.flatnonzero(~same)][np.cumsum(~same) - 1]
            known = again | (doc > smallest)
            query = np.flatnonzero(~known)
            # What a batch knows travels as one row for each text; the rest by its hash.
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1[query]), pa.array(h2[query]), pa.array(np.zeros(len(query), bool)), pa.array(rk[query]), pa.array(doc[query]), pa.array(pos[query].astype(np.int32)), pa.nulls(len(query), pa.list_(pa.int32()))],
                names=["h1", "h2", "known", "rk", "doc", "pos", "more"],
            )
            gone = np.flatnonzero(known)
            if len(gone):
                gone = gone[np.argsort(row[gone], kind="stable")]
                r = row[gone]
                cut = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                more = pa.ListArray.from_arrays(pa.array(np.r_[cut, len(gone)].astype(np.int32)), pa.array(pos[gone].astype(np.int32)))
                k = rk[gone][cut]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k), pa.array(k), pa.array(np.ones(len(cut), bool)), pa.array(k), pa.array(doc[gone][cut]), pa.array(np.zeros(len(cut), np.int32)), more],
                    names=["h1", "h2", "known", "rk", "doc", "pos", "more"],
                )

    return run


def removal_rows(window: int, keep_text: bool = True):
    """Arrow batches of (doc_id, text, copy, gone) to (doc_id, n_words, n_removed, spans, kept_sha256, kept if asked for)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("gone")
            for i, j, data, offs in tk.blocks(batch.column("text")):
                starts, ends, first = tk.words(data, offs, tk.SPACED)
                n = len(starts)
                mark = np.zeros(n + window + 1, np.int32)
                got = lists.slice(i, j - i)
                lens = np.diff(got.offsets.to_numpy())
                at = got.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(first[:-1], lens)
                np.add.at(mark, at, 1)
                np.add.at(mark, at + window, -1)
                gone = np.cumsum(mark[:n]) > 0
                whole = batch.column("copy").slice(i, j - i).to_numpy(zero_copy_only=False) & (np.diff(first) >= window)
                gone |= np.repeat(whole, np.diff(first))
                count = np.zeros(n + 1, np.int64)
                np.cumsum(gone, out=count[1:])
                removed = count[first[1:]] - count[first[:-1]]
                edge = gone.copy()
                edge[1:] &= ~gone[:-1] | np.isin(np.arange(1, n), first)
                begin = np.flatnonzero(edge)
                stop = gone.copy()
                stop[:-1] &= ~gone[1:] | np.isin(np.arange(1, n), first)
                end = np.flatnonzero(stop) + 1
                owner = tk.owners(first)
                spans = [[] for _ in range(j - i)]
                for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                    d = int(owner[a])
                    spans[d].append([a - int(first[d]), b - int(first[d])])
                kept = tk.joined(data, offs, starts, ends, first, ~gone)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        pa.array(np.diff(first)),
                        pa.array(removed.astype(np.int64)),
                        pa.array(spans, pa.list_(pa.list_(pa.int32()))),
                        pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
                        *([pa.array(kept, pa.binary()).cast(pa.string())] if keep_text else []),
                    ],
                    names=["doc_id", "n_words", "n_removed", "spans", "kept_sha256", *(["kept"] if keep_text else [])],
                )

    return run


def _copies(base: DataFrame) -> DataFrame:
    """rk and copy of the rows whose whole text has a smaller document."""
    rows = base.where("text is not null").select("rk", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("text"), "text").alias("t2"))
    first = rows.groupBy("t1", "t2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("most > least").select("t1", "t2", "least")
    return rows.join(first, ["t1", "t2"]).where("doc > least").select("rk").distinct().withColumn("copy", F.lit(True))


def removals(docs: DataFrame, window: int = WINDOW, inner: int = INNER, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, spans (word intervals, end exclusive), kept and its sha256.

    With keep_text false the kept text, which is as large as the input, is left out.
    """
    sh.small_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    base = base.withColumn("rk", sh.short_key())
    texts = base.join(_copies(base).hint("shuffle_hash"), "rk", "left").select("rk", "doc_id", "text", "copy")
    anchors = texts.where("copy is null").select("rk", "doc_id", "text").mapInArrow(anchor_rows(window, inner), "part long, known boolean, rk long, anchor long")
    by_anchor = Window.partitionBy("part", "known")
    repeated = (
        anchors.withColumn("n", F.count(F.lit(1)).over(by_anchor))
        .where("known or n > 1")
        .groupBy("rk")
        .agg(F.collect_set("anchor").alias("anchors"))
    )
    asked = texts.where("copy is null").join(repeated.hint("shuffle_hash"), "rk").select("rk", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "text", "anchors")
    rows = asked.mapInArrow(window_rows(window, inner), "h1 long, h2 long, known boolean, rk long, doc long, pos int, more array<int>")
    by_hash = Window.partitionBy("h1", "h2", "known")
    gone = (
        rows.withColumn("least", F.min("doc").over(by_hash))
        .where("known or doc > least")
        .select("rk", F.when(F.col("known"), F.col("more")).otherwise(F.array("pos")).alias("gone"))
        .groupBy("rk")
        .agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    )
    none = F.array().cast("array<int>")
    full = texts.join(gone.hint("shuffle_hash"), "rk", "left").select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), F.coalesce("gone", none).alias("gone"))
    return full.mapInArrow(sh.frugal(removal_rows(window, keep_text)), "doc_id long, n_words long, n_removed long, spans array<array<int>>, kept_sha256 string" + ", kept string" * keep_text)


def op3_substring_dedup(spark, sf_dir) -> DataFrame:
    """Contract query: words removed from each whole document."""
    return removals(sh.documents(spark, sf_dir), keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(list_slice(w, p, p + {WINDOW - 1}), ' ') AS k
        FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) - {WINDOW} + 2 AS BIGINT))) AS p FROM d WHERE len(w) >= {WINDOW})),
late AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS rn FROM win) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + {WINDOW})) AS x FROM late),
words AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS x FROM d),
kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY x) AS s FROM words ANTI JOIN gone USING (doc_id, x) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
