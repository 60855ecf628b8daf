"""Language identification by interpolated Kneser-Ney character models.

For each language a model of order ``order`` is made from character n-gram counts over the
letters of its training texts: lower case, everything else one blank. The highest order uses
counts, lower ones the numbers of distinct left contexts, each with its own absolute discount. A
text gets the language of the lowest cross-entropy per character. Scores are posteriors at a
temperature fitted on training texts the counts left out; ``rejected`` marks texts whose
cross-entropy is above the calibration texts' ``reject_quantile``.

Stored form. Each order is a sorted array of 64-bit hashes, shared by the languages, with a column
of log-probabilities for each, and one of contexts with back-off weights; look-ups are binary
searches, and a text looks up each of its distinct n-grams once.

How it scales. N-grams of all training texts are counted: by sorting in each task, then by one
aggregation, and all are kept: discounts, totals and continuation counts are those of the whole
input. The model reaches the driver and is broadcast, so it grows with the number of distinct
n-grams, and the driver's memory bounds it. Scoring needs no exchange.

Edge cases. Null texts and texts without letters (emoji aren't letters) are ``und`` with score 0.
Null ids are never learned from nor held out. Null languages are never learned. Without any training
text all predictions are ``und``. Very long texts are whole, one at a time in memory. Repeated rows
count and are predicted each. Equal cross-entropies go to the language that sorts first. An empty
table gives an empty one; columns other than the id, text and language aren't read, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm import _shared as sh
from meridia.llm import _tokens as tk

ORDER = 4
CALIBRATION_TEXTS = 1_500
REJECT_QUANTILE = 0.999
UND = "und"
BITS = 16
FIELD = np.uint64((1 << BITS) - 1)

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Code point -> itself if a letter, else a blank, up to 0xFFFF."""
    if not _letters:
        table = np.full(1 << 16, 0x20, np.uint32)
        for c in range(1 << 16):
            if chr(c).isalpha():
                table[c] = c
        _letters.append(table)
    return _letters[0]


def symbols(text: str | None) -> np.ndarray:
    """The text's letters with single blanks between words and at both ends, 16 bits each; empty without letters."""
    if not text:
        return np.empty(0, np.uint64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    if len(points) and points.max() >= 1 << 16:
        low = letter_table()[np.minimum(points, (1 << 16) - 1)]
        astral = np.unique(points[points >= 1 << 16])
        letters = astral[[chr(c).isalpha() for c in astral.tolist()]]
        folded = (points ^ (points >> np.uint32(3))) & np.uint32(0xFFFF)
        folded = np.where(np.isin(points, letters), np.where(folded == 0x20, 0x2FF, folded), 0x20)
        out = np.where(points < 1 << 16, low, folded)
    else:
        out = letter_table()[points]
    blank = out == 0x20
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    keep[:1] |= blank[:1]
    out = out[keep]
    if not len(out) or (len(out) == 1 and out[0] == 0x20):
        return np.empty(0, np.uint64)
    ends = [] if out[-1] == 0x20 else [0x20]
    starts = [] if out[0] == 0x20 else [0x20]
    return np.concatenate([starts, out, ends]).astype(np.uint64)


def ngrams(s: np.ndarray, order: int) -> np.ndarray:
    """Packed n-grams; the first characters have shorter contexts, padded by zeros."""
    out = s.copy()
    for k in range(1, order):
        out[k:] |= s[:-k] << np.uint64(BITS * k)
    return out[1:]


def hashed(packed: np.ndarray) -> np.ndarray:
    return tk.mix(packed + tk.U64(0x632BE59BD9B4E019))


def count_rows(order: int):
    """Arrow batches (lang, text) to (lang, gram, n), combined within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def flush(lang: str) -> pa.RecordBatch:
            grams, n = np.unique(np.concatenate(held[lang]), return_counts=True)
            held[lang] = []
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(tk.signed(grams)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

        size: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = symbols(text.as_py())
                if len(s):
                    held.setdefault(lang, []).append(ngrams(s, order))
                    size[lang] = size.get(lang, 0) + len(s)
                    if size[lang] > 4_000_000:
                        size[lang] = 0
                        yield flush(lang)
        for lang in held:
            if held[lang]:
                yield flush(lang)

    return run


@dataclass
class Model:
    """Kneser-Ney models of several languages in sorted hash arrays."""

    langs: list[str]
    order: int
    grams: list[np.ndarray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    floor: np.ndarray | None = None
    temperature: float = 1.0
    reject_above: np.ndarray | None = None

    @classmethod
    def fit(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> Model:
        """counts: language -> (packed n-grams of the highest order, counts)."""
        langs = sorted(counts)
        model = cls(langs, order)
        if not langs:
            return model
        tables: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(order)]
        alphabet = set()
        for lang in langs:
            grams, n = (np.asarray(x) for x in counts[lang])
            grams = grams.astype(np.uint64)
            sort = np.argsort(grams)
            grams, n = grams[sort], n[sort].astype(np.float64)
            tables[order - 1].append((grams, n))
            alphabet |= set(np.unique(grams & FIELD).tolist())
            for k in range(order - 2, -1, -1):
                # Distinct left extensions of each shorter n-gram.
                keep = np.uint64((1 << BITS * (k + 1)) - 1)
                grams, n = np.unique(tables[k + 1][-1][0] & keep, return_counts=True)
                tables[k].append((grams, n.astype(np.float64)))
        model.floor = np.full(len(langs), -np.log(len(alphabet) + 1.0))
        for k in range(order):
            union = np.unique(np.concatenate([g for g, _ in tables[k]]))
            context = np.unique(union >> np.uint64(BITS))
            share = np.zeros((len(union), len(langs)))
            weight = np.ones((len(context), len(langs)))
            for j, (grams, n) in enumerate(tables[k]):
                if not len(grams):
                    continue
                once, twice = (n == 1).sum(), (n == 2).sum()
                d = once / (once + 2.0 * twice) if once and twice else 0.5
                ctx, inv = np.unique(grams >> np.uint64(BITS), return_inverse=True)
                total, kinds = np.bincount(inv, n), np.bincount(inv)
                share[np.searchsorted(union, grams), j] = np.maximum(n - d, 0) / total[inv]
                weight[np.searchsorted(context, ctx), j] = d * kinds / total
            lower = np.exp(model.log_probs(union & np.uint64((1 << BITS * k) - 1), k))
            back = weight[np.searchsorted(context, union >> np.uint64(BITS))]
            log = np.log(np.maximum(share + back * lower, 1e-300))
            for keys, values, into, beside in ((union, log, model.grams, model.logs), (context, np.log(np.maximum(weight, 1e-300)), model.contexts, model.weights)):
                h = hashed(keys)
                sort = np.argsort(h)
                into.append(h[sort])
                beside.append(values[sort].astype(np.float32))
        return model

    def log_probs(self, packed: np.ndarray, order: int) -> np.ndarray:
        """Log-probability of the last character of each packed n-gram, for each language."""
        if order == 0:
            return np.broadcast_to(self.floor, (len(packed), len(self.langs)))
        keys, logs = self.grams[order - 1], self.logs[order - 1]
        h = hashed(packed)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        out = logs[at].astype(np.float64)
        miss = np.flatnonzero(keys[at] != h)
        if len(miss):
            gone = packed[miss]
            c = hashed(gone >> np.uint64(BITS))
            ctx = self.contexts[order - 1]
            j = np.minimum(np.searchsorted(ctx, c), len(ctx) - 1)
            weight = np.where((ctx[j] == c)[:, None], self.weights[order - 1][j], 0.0)
            out[miss] = weight + self.log_probs(gone & np.uint64((1 << BITS * (order - 1)) - 1), order - 1)
        return out

    def entropy(self, text: str | None) -> np.ndarray | None:
        """Nats per character under each language; None without letters."""
        s = symbols(text)
        if not len(s) or not self.langs:
            return None
        grams = np.sort(ngrams(s, self.order))
        new = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
        n = np.diff(np.r_[new, len(grams)])
        return -(n @ self.log_probs(grams[new], self.order)) / len(grams)

    def posterior(self, entropy: np.ndarray) -> np.ndarray:
        z = -(entropy - entropy.min()) / self.temperature
        e = np.exp(z)
        return e / e.sum()

    def calibrate(self, entropies: np.ndarray, truth: np.ndarray, quantile: float = REJECT_QUANTILE) -> None:
        """Fit the temperature by likelihood and the rejection bounds by a quantile."""
        self.reject_above = np.full(len(self.langs), np.inf)
        if not len(truth):
            return
        best = np.inf
        for t in np.geomspace(0.005, 1.0, 40):
            z = -(entropies - entropies.min(1, keepdims=True)) / t
            loss = float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(truth)), truth]))
            if loss < best:
                best, self.temperature = loss, float(t)
        for j in range(len(self.langs)):
            own = entropies[truth == j, j]
            if len(own) >= 20:
                self.reject_above[j] = np.quantile(own, quantile) * 1.05

    def predict(self, text: str | None) -> tuple[str, float, float | None, bool]:
        """(language, score, cross-entropy, rejected)."""
        e = self.entropy(text)
        if e is None:
            return UND, 0.0, None, True
        j = int(e.argmin())
        over = bool(self.reject_above is not None and e[j] > self.reject_above[j])
        return self.langs[j], float(self.posterior(e)[j]), float(e[j]), over


def ngram_counts(docs: DataFrame, order: int = ORDER) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Counts of all n-grams over all rows of (lang, text)."""
    sh.small_batches(docs.sparkSession)
    rows = docs.select("lang", "text").mapInArrow(count_rows(order), "lang string, gram long, n long")
    total = rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = total.toArrow().to_pandas()
    return {k: (g["gram"].to_numpy().view(np.uint64), g["n"].to_numpy()) for k, g in got.groupby("lang")}


def fit(train: DataFrame, order: int = ORDER, calibration_texts: int = CALIBRATION_TEXTS) -> Model:
    """A calibrated model of (doc_id, lang, text) rows.

    A bounded sample, the calibration_texts rows whose id hashes lowest among a sixteenth, fits the
    temperature and the rejection bounds. Only rows with its ids are left out of the counts.
    """
    train = train.where("lang is not null and text is not null and doc_id is not null")
    aside = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(16)) == 0
    sample = sh.sample(train.where(aside).select("lang", "text", "doc_id"), calibration_texts, "doc_id", "lang")
    # At most calibration_texts ids, so they may be broadcast.
    held = F.broadcast(sample.select("doc_id").distinct())
    model = Model.fit(ngram_counts(train.join(held, "doc_id", "left_anti"), order), order)
    sample = sample.select("lang", "text")
    ent, truth = [], []
    shared = train.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(lang, e.tolist()) for lang, t in zip(pdf["lang"], pdf["text"], strict=True) if (e := shared.value.entropy(t)) is not None]
            yield pd.DataFrame(rows, columns=["lang", "e"])

    for r in sample.mapInPandas(scored, "lang string, e array<double>").collect():
        if r.lang in model.langs:
            ent.append(r.e)
            truth.append(model.langs.index(r.lang))
    model.calibrate(np.array(ent).reshape(len(truth), len(model.langs)), np.array(truth, int))
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, cross_entropy and rejected of each text."""
    sh.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            got = [model.predict(t.as_py()) for t in batch.column(1)]
            cols = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")


def op1_language_id(spark, sf_dir) -> DataFrame:
    """Contract query: the language of each whole document, learned where crc32(id) mod 4 is not 2."""
    docs = sh.documents(spark, sf_dir)
    model = fit(docs.where(sh.crc_mod("doc_id", 4) != 2))
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(sh.crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
