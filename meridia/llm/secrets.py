"""Secret scanning: fixed patterns and a character convolutional network over every candidate.

Base findings are the patterns' matches (assign, access, hex); they always stay. Candidates are the
base findings and every other token that could hold a secret: 16 characters or more of the secret
alphabet with both letters and digits, unless a base finding covers it whole. The network reads a
candidate whole, with ``context`` characters on either side. Base findings get its score; other
candidates at or above the threshold are added as kind ``model``, those that reach beyond a base
finding too.

The network embeds characters, convolves, pools by maximum and mean, and ends in one hidden layer;
all in numpy. It learns from labelled findings: base findings in a bounded sample of documents and
generated keys of common formats in contexts drawn from all of these documents are positive, tokens
of harmless formats and ordinary candidates are negative. An ordinary candidate may be a secret that
no pattern knows: two networks, each fitted on half of the rows, score the other half, and ordinary
candidates that these call secrets aren't learned from. A temperature is fitted on left-out findings,
and the threshold is the largest at which at least ``recall`` of the left-out positives that no
pattern decides, the generated ones, are found.

How it scales. Fitting is bounded by ``sample_rows`` documents; scanning is a map over whole texts
without an exchange. Long candidates are read whole, in strips whose maxima and sums are combined.

Edge cases. Null and empty texts have no findings. Offsets are code points. Very long texts are whole,
one at a time in memory. Findings with one start are in the order of their kinds. Repeated rows each
have theirs. Without documents to learn from only generated findings teach the network. Empty tables
give no rows; further columns are carried if named, whatever they are called.
"""

from __future__ import annotations

import random
import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm import _shared as sh

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "model")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=@:~$%-]{16,}")

CONTEXT, RECALL = 20, 0.98
SAMPLE_ROWS, SYNTHETIC, STRETCH = 4_000, 1_500, 200
EMBED, WIDTH, FILTERS, HIDDEN = 8, 5, 24, 16
EPOCHS, RATE, CELLS = 12, 0.01, 200_000


def base_findings(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns, by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    out.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return out


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Spans of tokens with letters and digits that no base finding covers."""
    out, k, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        s = m.group()
        if any(c in string.digits for c in s) and any(c.isalpha() for c in s):
            a, b = m.span()
            # The furthest end of the base findings that begin at or before the token.
            while k < len(base) and base[k][0] <= a:
                reach = max(reach, base[k][1])
                k += 1
            if reach < b:
                out.append((a, b))
    return out


def coded(text: str, start: int, end: int, context: int = CONTEXT) -> np.ndarray:
    """Character classes of a candidate (1-95 printable, 96 others) and, from 97 on, of its surroundings."""

    def codes(s: str) -> np.ndarray:
        x = np.frombuffer(s.encode("utf-32-le", "replace"), np.int32)
        return np.where((x >= 32) & (x < 127), x - 31, 96).astype(np.int16)

    left, right = text[max(0, start - context) : start], text[end : end + context]
    return np.concatenate([codes(left) + 96, codes(text[start:end]), codes(right) + 96])


@dataclass
class Network:
    """Weights of the character network, its temperature and threshold."""

    w: list[np.ndarray]
    temperature: float = 1.0
    threshold: float = 1.1

    @classmethod
    def start(cls, seed: int = 3) -> Network:
        g = np.random.default_rng(seed)
        return cls([
            g.normal(0, 0.3, (193, EMBED)),
            g.normal(0, np.sqrt(2 / (EMBED * WIDTH)), (EMBED * WIDTH, FILTERS)), np.zeros(FILTERS),
            g.normal(0, np.sqrt(1 / FILTERS), (2 * FILTERS, HIDDEN)), np.zeros(HIDDEN),
            g.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1),
        ])

    @staticmethod
    def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Codes with padding 0 on both sides, and which windows have a character in their middle."""
        length = max(map(len, rows)) + WIDTH - 1
        out = np.zeros((len(rows), length), np.int64)
        for i, r in enumerate(rows):
            out[i, WIDTH // 2 : WIDTH // 2 + len(r)] = r
        lens = np.array([len(r) for r in rows])
        return out, np.arange(length - WIDTH + 1)[None, :] < lens[:, None]

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        e, k, kb, h, hb, o, ob = self.w
        emb = e[x] * (x > 0)[:, :, None]
        n, length = mask.shape
        windows = np.lib.stride_tricks.sliding_window_view(emb, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n, length, -1)
        conv = np.maximum(windows @ k + kb, 0) * mask[:, :, None]
        top = conv.argmax(1)
        count = mask.sum(1, keepdims=True)
        pooled = np.concatenate([conv.max(1), conv.sum(1) / count], axis=1)
        hidden = np.tanh(pooled @ h + hb)
        return hidden @ o + ob[0], (windows, conv, top, count, pooled, hidden)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        e, k, kb, h, hb, o, ob = self.w
        z, (windows, conv, top, count, pooled, hidden) = self.forward(x, mask)
        d = (1 / (1 + np.exp(-z)) - y) / len(y)
        dh = np.outer(d, o) * (1 - hidden**2)
        dp = dh @ h.T
        dconv = np.repeat((dp[:, FILTERS:] / count)[:, None, :], conv.shape[1], axis=1)
        rows, cols = np.arange(len(y))[:, None], np.arange(FILTERS)[None, :]
        dconv[rows, top, cols] += dp[:, :FILTERS]
        dconv *= conv > 0
        dw = (dconv @ k.T).reshape(*conv.shape[:2], WIDTH, EMBED)
        de = np.zeros_like(e)
        for i in range(WIDTH):
            at = x[:, i : i + conv.shape[1]]
            np.add.at(de, at, dw[:, :, i] * (at > 0)[:, :, None])
        return [de, np.tensordot(windows, dconv, ([0, 1], [0, 1])), dconv.sum((0, 1)), pooled.T @ dh, dh.sum(0), hidden.T @ d, np.array([d.sum()])]

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        """Of rows of any lengths, read whole, in batches of about CELLS characters."""
        out = np.empty(len(rows))
        order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
        while order and len(rows[order[-1]]) > CELLS:
            at = order.pop()
            out[at] = self.strips(rows[at])
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi - lo + 1) * len(rows[order[hi]]) <= CELLS:
                hi += 1
            at = order[lo:hi]
            out[at] = self.forward(*self.padded([rows[i] for i in at]))[0]
            lo = hi
        return out

    def strips(self, row: np.ndarray) -> float:
        """The logit of one row, read strip by strip: maxima and sums over the strips are those of the whole."""
        e, k, kb, h, hb, o, ob = self.w
        top, total, half = np.zeros(FILTERS), np.zeros(FILTERS), WIDTH // 2
        for lo in range(0, len(row), CELLS):
            hi = min(len(row), lo + CELLS)
            x = np.zeros(hi - lo + WIDTH - 1, np.int64)
            a, b = max(0, lo - half), min(len(row), hi + half)
            x[a - lo + half : b - lo + half] = row[a:b]
            emb = e[x] * (x > 0)[:, None]
            windows = np.lib.stride_tricks.sliding_window_view(emb, WIDTH, axis=0).transpose(0, 2, 1).reshape(hi - lo, -1)
            conv = np.maximum(windows @ k + kb, 0)
            top, total = np.maximum(top, conv.max(0)), total + conv.sum(0)
        hidden = np.tanh(np.concatenate([top, total / len(row)]) @ h + hb)
        return float(hidden @ o + ob[0])

    def probability(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(rows) / self.temperature)) if rows else np.empty(0)


def _descend(net: Network, rows: list[np.ndarray], labels: np.ndarray, used: np.ndarray, g: np.random.Generator) -> Network:
    """net, fitted on the used rows."""
    moment, step = [[np.zeros_like(p), np.zeros_like(p)] for p in net.w], 0
    used = used.copy()
    for _ in range(EPOCHS):
        g.shuffle(used)
        for at in np.array_split(used, max(1, len(used) // 64)):
            grads = net.gradients(*net.padded([rows[i] for i in at]), labels[at].astype(float))
            step += 1
            for p, d, (m, v) in zip(net.w, grads, moment, strict=True):
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def train(rows: list[np.ndarray], labels: np.ndarray, decisive: np.ndarray | None = None, doubtful: np.ndarray | None = None, recall: float = RECALL, seed: int = 3) -> Network:
    """A calibrated network with its recall-constrained threshold; a fifth of the rows is left out.

    decisive marks the positives that the threshold has to find, doubtful the negatives that may be
    secrets. Rows longer than the strips of scanning serve as well, by their first strip.
    """
    net = Network.start(seed)
    decisive = labels == 1 if decisive is None else decisive
    doubtful = np.zeros(len(labels), bool) if doubtful is None else doubtful
    if len(set(labels.tolist())) < 2:
        return net
    rows = [r[:CELLS] for r in rows]
    g = np.random.default_rng(seed)
    order = g.permutation(len(rows))
    if doubtful.any():
        trusted = np.ones(len(rows), bool)
        for used, scored in ((order[::2], order[1::2]), (order[1::2], order[::2])):
            if len(set(labels[used].tolist())) == 2:
                p = _descend(Network.start(seed), rows, labels, used, g).probability([rows[i] for i in scored])
                trusted[scored] = ~(doubtful[scored] & (p >= 0.5))
        order = order[trusted[order]]
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    _descend(net, rows, labels, used, g)
    z, y = net.logits([rows[i] for i in held]), labels[held].astype(float)
    net.temperature = float(min(np.geomspace(0.3, 5, 40), key=lambda t: np.mean(np.logaddexp(0, z / t) - y * z / t)))
    p = np.sort(1 / (1 + np.exp(-z[(y == 1) & decisive[held]] / net.temperature)))
    net.threshold = float(p[int(np.floor((1 - recall) * len(p)))]) if len(p) else 1.1
    return net


def generated(contexts: list[str], n: int = SYNTHETIC, seed: int = 9) -> tuple[list[np.ndarray], list[int]]:
    """Labelled findings of common formats, set into real contexts."""
    rnd = random.Random(seed)
    alnum, b64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"

    def draw(alphabet: str, k: int) -> str:
        return "".join(rnd.choice(alphabet) for _ in range(k))

    def word() -> str:
        return "".join(rnd.choice(["th", "er", "in", "on", "re", "ti", "es", "an", "le", "ch", "men", "ca"]) for _ in range(rnd.randint(2, 5)))

    secret = [
        lambda: rnd.choice(["ghp_", "gho_", "ghs_"]) + draw(alnum, 36), lambda: rnd.choice(["sk_live_", "rk_live_"]) + draw(alnum, 24), lambda: "xox" + rnd.choice("bp") + "-" + draw(string.digits, 11) + "-" + draw(alnum, 24),
        lambda: draw(b64, 40), lambda: draw(alnum, rnd.randint(20, 64)), lambda: "eyJ" + draw(alnum, 20) + "." + draw(alnum, 40) + "." + draw(alnum + "-_", 43), lambda: "AIza" + draw(alnum + "-_", 35), lambda: draw("0123456789abcdef", rnd.choice([32, 40, 64])),
        lambda: draw("0123456789ABCDEF", rnd.choice([32, 40])), lambda: "AKIA" + draw(string.ascii_uppercase + string.digits, 16),
    ]
    harmless = [
        lambda: f"{word()}.{rnd.randint(1, 99)}@{word()}{rnd.randint(1, 9)}.example.com", lambda: f"https://{word()}.example.org/{word()}/{rnd.randint(1, 99999)}", lambda: f"{word()}-{word()}-{rnd.randint(1900, 2030)}", lambda: f"{word()}_{word()}_{rnd.randint(1, 99)}.txt",
        lambda: f"20{rnd.randint(10, 30)}-0{rnd.randint(1, 9)}-1{rnd.randint(0, 9)}T1{rnd.randint(0, 9)}:00:00Z", lambda: f"{word()}{word()}{word()}{rnd.randint(1, 99)}", lambda: f"/usr/lib/{word()}/{word()}{rnd.randint(1, 9)}", lambda: f"{word()}={rnd.randint(1, 999)}&{word()}={word()}".replace("&", "%"),
    ]
    rows, labels = [], []
    for i in range(n):
        source = rnd.choice(contexts) if contexts else ""
        at = rnd.randint(0, max(0, len(source) - 60))
        s = rnd.choice(secret if i % 2 else harmless)()
        left = source[at : at + CONTEXT] + rnd.choice([" ", ' "', "=", ": "] if i % 2 else [" ", " ", ' "', ": "])
        text = left + s + rnd.choice([" ", '" ', "\n", ", "]) + source[at + 30 : at + 50]
        rows.append(coded(text, len(left), len(left) + len(s)))
        labels.append(i % 2)
    return rows, labels


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, recall: float = RECALL) -> Network:
    """A network of findings in the sample_rows documents of lowest id hash, and generated ones."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, labels, contexts = [], [], []
            for text in batch.column(0).to_pylist():
                base = base_findings(text)
                for a, b, _ in base:
                    rows.append(coded(text, a, b)[:CELLS])
                    labels.append(1)
                for a, b in candidates(text, base):
                    rows.append(coded(text, a, b)[:CELLS])
                    labels.append(0)
                # A stretch of surroundings from anywhere in the text.
                at = zlib.crc32(text.encode()) % max(1, len(text) - STRETCH)
                contexts.append(text[at : at + STRETCH])
            yield pa.RecordBatch.from_arrays([pa.array([[x.tolist() for x in rows]], pa.list_(pa.list_(pa.int32()))), pa.array([labels], pa.list_(pa.int32())), pa.array([contexts], pa.list_(pa.string()))], names=["rows", "labels", "contexts"])

    # Rows by the hash of text and id, if there is one: copies of a text are separate rows.
    key = ["text", "doc_id"] if "doc_id" in docs.columns else ["text"]
    sample = sh.sample(docs.where("text is not null").select(*key), sample_rows, *key).select("text")
    rows, labels, contexts = [], [], []
    for r in sample.mapInArrow(found, "rows array<array<int>>, labels array<int>, contexts array<string>").collect():
        rows += [np.array(x) for x in r.rows]
        labels += r.labels
        contexts += r.contexts
    more, kinds = generated(sorted(contexts))
    known = np.arange(len(rows) + len(more)) < len(rows)
    truth = np.array(labels + kinds, int)
    return train(rows + more, truth, (truth == 1) & ~known, (truth == 0) & known, recall)


def findings(docs: DataFrame, net: Network, *keep: str) -> DataFrame:
    """The keep columns, and found: array of (start, end, kind, score), by start, then kind as listed."""
    sh.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.slice(lo, 1000)
                rows, where = [], []
                for i, text in enumerate(part.column(0).to_pylist()):
                    text = text or ""
                    base = base_findings(text)
                    for a, b, k in [*base, *((a, b, "model") for a, b in candidates(text, base))]:
                        rows.append(coded(text, a, b))
                        where.append((i, a, b, k))
                out: list[list[tuple]] = [[] for _ in range(len(part))]
                for (i, a, b, k), p in zip(where, net.probability(rows).tolist(), strict=True):
                    if k != "model" or p >= net.threshold:
                        out[i].append((a, b, k, p))
                got = [[dict(zip(("start", "end", "kind", "score"), f, strict=True)) for f in sorted(x, key=lambda f: (f[0], KINDS.index(f[2])))] for x in out]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(got, kind)], names=[*part.schema.names[1:], "found"])

    base = docs.select(F.col("text").alias(sh.fresh("_text", list(keep))), *keep)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[1:]] + ["found array<struct<start:long,end:long,kind:string,score:double>>"])
    return base.mapInArrow(run, schema)


def op6_secrets(spark, sf_dir) -> DataFrame:
    """Contract query: secrets of each whole document."""
    docs = sh.documents(spark, sf_dir).select("text", F.col("doc_id").cast("long").alias("doc_id"))
    out = findings(docs, fit(docs), "doc_id")

    def spans(found):
        return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f.kind, f.start, f.end)), ",")

    def of(kind: str):
        return F.size(F.filter("found", lambda f: f.kind == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda f: f.kind != "model")
    return out.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(spans(base), 256).alias("base_sha256"), spans(F.col("found")).alias("spans"), of("model"))
