"""Quality classification by random-indexing word vectors and a two-layer network.

Each token gives two words: its lower-case letters and digits, and its shape (letter case, digits,
symbols, length, whether it repeats the token before). A word's index vector is a sparse ternary
one drawn from its hash; its word vector is the sum of the index vectors of its neighbours, itself
included, over the training sample. Word vectors live in a table of ``buckets`` hashed rows. A
document is the mean of its tokens' vectors, besides the shares of its shapes' index vectors. A
network of two layers in numpy scores it, and a temperature fitted on left-out sample rows makes
the score a probability.

How it scales. The classifier is fitted on a bounded sample: at most ``sample_rows`` labelled
documents, those whose id hashes lowest, and of them, in the same order, whole documents until the
next would exceed ``sample_bytes`` of text; rows after that are left out, whatever their length. The
first document is taken even if it alone is larger. Scoring is a map over whole texts with the model broadcast; its size depends on
the parameters alone.

Edge cases. Null and empty texts score as texts without tokens. Null labels and null ids aren't
learned from. Without labels of both kinds every score is the share of label 1, or one half. Very long
texts are whole, one at a time in memory. Repeated rows score each; equal rows of the sample are
ordered by their text's hash. An empty table gives an empty one. Further columns are carried along
under names of their own, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm import _shared as sh
from meridia.llm import _tokens as tk

SAMPLE_ROWS, SAMPLE_BYTES = 6_000, 40_000_000
BUCKETS, DIM, NONZERO, HIDDEN = 1 << 15, 32, 4, 24
SHAPES = 1 << 8
EPOCHS, RATE = 60, 0.01

CORE = tk.ALNUM.copy()
CORE[0x41:0x5B] = True
KIND = np.zeros(256, np.uint8)
KIND[0x41:0x5B], KIND[0x61:0x7B], KIND[0x30:0x3A], KIND[0x80:] = 1, 2, 4, 2
KIND[[ord(c) for c in ".,;:'\"?-()"]] = 8
KIND[(KIND == 0)] = 16


def index_vectors(n: int, dim: int = DIM, nonzero: int = NONZERO, seed: int = 1) -> np.ndarray:
    """Sparse ternary vectors of n hash buckets, drawn from their numbers."""
    out = np.zeros((n, dim), np.float32)
    rows = np.arange(n).astype(tk.U64) + tk.U64(seed << 32)
    for k in range(nonzero):
        h = tk.mix(rows * tk.U64(nonzero) + tk.U64(k))
        out[np.arange(n), (h % tk.U64(dim)).astype(int)] += np.where((h >> tk.U64(40)) & tk.U64(1), 1.0, -1.0).astype(np.float32)
    return out


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket, shape, first token of each text) of the tokens of a block."""
    starts, ends, first = tk.words(data, offs, tk.SPACED)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64), first
    low = np.where(CORE[data], tk.LOWER[data], 0).astype(np.uint8)
    # Symbols count as one byte each, so a word and its trimmings differ only in shape: hash letters alone.
    only = low.astype(tk.U64)
    up, down = tk.powers(tk.BYTE_BASE, len(data) + 1)
    inner = np.zeros(len(data) + 1, np.int64)
    np.cumsum(low > 0, out=inner[1:])
    sums = np.zeros(len(data) + 1, tk.U64)
    np.cumsum(only * up[inner[:-1]], out=sums[1:])
    hashes = tk.mix((sums[ends] - sums[starts]) * down[inner[starts]])
    seen = np.bitwise_or.reduceat(KIND[data], np.c_[starts, ends].ravel()[: -1 if ends[-1] == len(data) else None])[::2].astype(np.int64)
    symbol = np.zeros(len(data) + 1, np.int64)
    np.cumsum(KIND[data] == 16, out=symbol[1:])
    many = np.minimum(symbol[ends] - symbol[starts], 3)
    whole = tk.span_hash(data, starts, ends)
    again = np.zeros(len(starts), bool)
    again[1:] = whole[1:] == whole[:-1]
    again[np.minimum(first[:-1], len(starts) - 1)] = False
    shape = seen | (again.astype(np.int64) << 5) | (many << 6)
    return (hashes % tk.U64(BUCKETS)).astype(np.int64), shape, first


@dataclass
class Quality:
    """Word vectors, shape vectors, network and temperature."""

    vectors: np.ndarray
    shapes: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    prior: float

    def features(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        word, shape, first = tokens(data, offs)
        n = np.diff(first)
        out = np.zeros((len(n), self.vectors.shape[1] + self.shapes.shape[1] + 1), np.float64)
        out[:, -1] = np.log1p(n)
        full = np.flatnonzero(n)
        if len(full):
            cut = first[:-1][full]
            both = np.concatenate([self.vectors[word], self.shapes[shape]], axis=1)
            out[full, :-1] = np.add.reduceat(both, cut, axis=0, dtype=np.float64) / n[full][:, None]
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(((x - self.mean) / self.scale) @ w1 + b1) @ w2 + b2[0]

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(offs) - 1, self.prior)
        return 1 / (1 + np.exp(-self.logits(self.features(data, offs)) / self.temperature))


def word_vectors(texts: list[str]) -> np.ndarray:
    """Unit word vectors: sums of the index vectors of each word, its neighbours and its shape."""
    index, shapes = index_vectors(BUCKETS), index_vectors(SHAPES, seed=2)
    total = np.zeros((BUCKETS, DIM), np.float32)
    for _, _, data, offs in tk.blocks(pa.array(texts, pa.string())):
        word, shape, first = tokens(data, offs)
        if not len(word):
            continue
        own = index[word]
        context = own + shapes[shape]
        same = np.ones(len(word) - 1, bool)
        edge = first[(first > 0) & (first < len(word))]
        same[edge - 1] = False
        context[1:] += own[:-1] * same[:, None]
        context[:-1] += own[1:] * same[:, None]
        order = np.argsort(word, kind="stable")
        cut = np.flatnonzero(np.r_[True, word[order][1:] != word[order][:-1]])
        total[word[order][cut]] += np.add.reduceat(context[order], cut, axis=0)
    empty = ~total.any(axis=1)
    total[empty] = index[empty]
    return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> Quality:
    """Word vectors and network of labelled texts; a fifth of them sets the temperature."""
    prior = float(labels.mean()) if len(labels) else 0.5
    shapes = index_vectors(SHAPES, seed=2)
    model = Quality(word_vectors(texts), shapes, np.zeros(1), np.ones(1), [], 1.0, prior)
    if len(set(labels.tolist())) < 2:
        return model
    parts = [model.features(data, offs) for _, _, data, offs in tk.blocks(pa.array(texts, pa.string()))]
    x, y = np.concatenate(parts), labels.astype(np.float64)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    model.mean, model.scale = x[used].mean(0), x[used].std(0) + 1e-6
    z = (x - model.mean) / model.scale
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    moment = [[np.zeros_like(p), np.zeros_like(p)] for p in layers]
    # Both labels weigh the same while learning; the temperature step has a bias that undoes it.
    weight = np.where(y == 1, 0.5 / max(prior, 1e-9), 0.5 / max(1 - prior, 1e-9))
    step = 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(used), max(1, len(used) // 128)):
            w1, b1, w2, b2 = layers
            h = np.tanh(z[at] @ w1 + b1)
            p = 1 / (1 + np.exp(-(h @ w2 + b2[0])))
            d = (p - y[at]) * weight[at] / len(at)
            dh = np.outer(d, w2) * (1 - h * h)
            grads = [z[at].T @ dh + 1e-4 * w1, dh.sum(0), h.T @ d + 1e-4 * w2, np.array([d.sum()])]
            step += 1
            for p_, g, (m, v) in zip(layers, grads, moment, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p_ -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.layers = layers
    logit, truth = model.logits(x[held]), y[held]
    bias = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    best, shift = np.inf, 0.0
    for t in np.geomspace(0.2, 5, 40) if len(held) else ():
        for b in (0.0, 0.5 * bias, bias):
            q = (logit + b) / t
            loss = float(np.mean(np.logaddexp(0, q) - truth * q))
            if loss < best - 1e-6:
                best, model.temperature, shift = loss, float(t), b
    layers[3] = layers[3] + shift
    return model


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Quality:
    """A model of a bounded sample of (doc_id, quality) labels and their documents."""
    order = F.xxhash64("doc_id", F.lit("sample"))
    rows = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    chosen = rows.orderBy(order, "doc_id", "quality").limit(sample_rows)
    # At most sample_rows pairs of numbers: bounded, so it may be broadcast.
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    # Rows in the order of their ids' hashes; equal rows have one key.
    size, text_hash = F.coalesce(F.octet_length("text"), F.lit(0)), F.xxhash64("text")
    sizes = joined.select(order.alias("h"), "doc_id", "quality", size.alias("size"), text_hash.alias("t")).collect()
    sizes.sort(key=lambda r: (r.h, r.doc_id, r.quality, r.t))
    have, taken, last = 0, 0, None
    for r in sizes:
        have += r.size
        if have > sample_bytes and last is not None:
            break
        taken, last = taken + 1, r
    if last is None:
        return train([], np.empty(0, int))
    key, end = (order, F.col("doc_id"), F.col("quality"), text_hash), (last.h, last.doc_id, last.quality, last.t)
    got = joined.where(F.struct(*key) <= F.struct(*(F.lit(x).cast(t) for x, t in zip(end, ("long", "long", joined.schema["quality"].dataType, "long"), strict=True)))).select(order.alias("h"), "doc_id", "quality", "text", text_hash.alias("t")).collect()
    got = sorted(got, key=lambda r: (r.h, r.doc_id, r.quality, r.t))[:taken]
    got.sort(key=lambda r: (r.doc_id, r.quality, r.text or ""))
    texts, marks = [r.text or "" for r in got], np.array([int(r.quality > 0) for r in got], int)
    del got, sizes
    model = train(texts, marks)
    del texts
    sh.give_back()
    return model


def score(docs: DataFrame, model: Quality, *keep: str, text: bool = False) -> DataFrame:
    """The keep columns, score and predicted of each text; the text too if asked for."""
    sh.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select("text", *keep)
    skip = 0 if text else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            got = [model.scores(data, offs) for _, _, data, offs in tk.blocks(batch.column(0))]
            s = np.concatenate(got) if got else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[skip:], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*batch.schema.names[skip:], "score", "predicted"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[skip:]] + ["score double", "predicted int"])
    return base.mapInArrow(sh.frugal(run), schema)


def learnable(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from."""
    return labels.where(sh.crc_mod("doc_id", 3) != 1)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that the classifier doesn't reject."""
    model = fit(docs, learnable(labels))
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    base = docs.select("text", *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return score(base, model, *names.values(), text=True).where("predicted = 1").select(*[F.col(names.get(c, "text")).alias(c) for c in docs.columns])


def op5_quality(spark, sf_dir) -> DataFrame:
    """Contract query: the quality of each whole document, learned where crc32(id) mod 3 is not 1."""
    docs = sh.documents(spark, sf_dir)
    model = fit(docs, learnable(sh.documents(spark, sf_dir, "labels")))
    out = score(docs.select("text", F.col("doc_id").cast("long").alias("doc_id")), model, "doc_id")
    return out.select("doc_id", F.coalesce(sh.crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
