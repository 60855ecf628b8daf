"""BPE encoding and decoding of whole texts, with tree concatenation of long unsplit text.

The vocabulary file is one of the public tokenizers library's: NFC, white space, lower case, a
split into letters, digits and the rest, bytes as characters, merges by rank, a word-end suffix.
A text is the sequence of its pieces, and a piece's ids are kept in a bounded cache. The pieces of
a batch that the cache lacks are merged together over flat arrays, one merge for each in a round.

Long unsplit pieces. A piece of more than ``leaf`` bytes is cut into leaves, which are encoded in
parallel as rows of their own, and joined pairwise, level by level. At a join a window of tokens
on either side is encoded again, and grows until its first token equals the left side's and its
last the right side's there. BPE output is valid exactly when each pair of adjacent tokens is, and
by that agreement every pair is one of a valid encoding, so the result is that of the whole piece.

Edge cases. Null and empty text have no tokens. Strings of special tokens become those tokens.
Texts are never cut, however long. Repeated rows stay, each with its tokens; null ids stay null; no
order matters, so there are no ties. An empty table gives an empty one. Columns other than doc_id
and text aren't read, so none can clash.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm import _shared as sh

LEAF = 4096
#: Texts with a chunk this long go the parallel way.
LONG_CHUNK = 65536
#: Entries of a generation of a cache; there are two.
CACHE = 100_000
#: Pieces of at most so many bytes are merged together, longer ones by a queue of their own.
SHORT_PIECE = 64
VOCABULARY = "word_bpe_49k.json"

SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
ASCII_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable, else from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class Cache:
    """A dict of two generations: what isn't asked for while one fills up is forgotten."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def get(self, key):
        got = self.young.get(key)
        if got is None:
            got = self.old.get(key)
            if got is not None:
                self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str | None = None, cache: int = CACHE):
        spec = json.load(open(path or default_path(), encoding="utf-8"))
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.names = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letters = byte_alphabet()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + end] for c in letters]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.symbols: dict[int, tuple[int, ...]] = {i: (i,) for i in [*self.inner, *self.final]}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[(vocab[a], vocab[b])] = (rank, new := vocab[a + b])
            self.symbols.setdefault(new, self.symbols[vocab[a]] + self.symbols[vocab[b]])
        self.width = max(self.names) + 1
        codes = np.array([a * self.width + b for a, b in self.merges], np.int64)
        order = np.argsort(codes)
        self.codes = np.r_[codes[order], np.iinfo(np.int64).max]
        both = np.array(list(self.merges.values()), np.int64).reshape(-1, 2)[order]
        self.none = len(self.merges)
        self.ranks, self.made = np.r_[both[:, 0], self.none], np.r_[both[:, 1], 0]
        self.byte_inner, self.byte_final = np.array(self.inner, np.int64), np.array(self.final, np.int64)
        self.pieces = Cache(cache)

    def base(self, piece: bytes, final: bool = True) -> list[int]:
        """A piece's bytes as symbols; the last of a whole piece ends the word."""
        out = [self.inner[b] for b in piece]
        if final and piece:
            out[-1] = self.final[piece[-1]]
        return out

    def merge(self, ids: list[int]) -> list[int]:
        """Symbols merged by rank, the leftmost of equal rank first."""
        merges = self.merges
        if len(ids) > 48:
            return self._merge_long(ids)
        ids = list(ids)
        while len(ids) > 1:
            best = None
            for i in range(len(ids) - 1):
                m = merges.get((ids[i], ids[i + 1]))
                if m is not None and (best is None or m < best):
                    best, at = m, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        merges, n = self.merges, len(ids)
        ids, nxt, prv = list(ids), [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m[0], i, a, b, m[1]) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (m := merges.get((a, b)))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = nxt[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            nxt[i] = k = nxt[j]
            nxt[j] = -1
            if k >= 0:
                prv[k] = i
                if m := merges.get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, new, ids[k], m[1]))
            h = prv[i]
            if h >= 0 and (m := merges.get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, ids[h], new, m[1]))
        out, i = [], 0
        while i >= 0:
            out.append(ids[i])
            i = nxt[i]
        return out

    def join(self, left: list[int], right: list[int], window: int = 2) -> list[int]:
        """The encoding of two neighbours' text, from their encodings."""
        if not left or not right:
            return left + right
        while True:
            a, b = left[-window:], right[:window]
            new = self.merge([s for t in a + b for s in self.symbols[t]])
            fits_left = len(a) == len(left) or new[0] == a[0]
            fits_right = len(b) == len(right) or new[-1] == b[-1]
            if fits_left and fits_right:
                return left[: len(left) - len(a)] + new + right[len(b) :]
            window *= 2

    def tree(self, parts: list[list[int]]) -> list[int]:
        """Encoded leaves joined pairwise, level by level."""
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def looked_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where codes has the pairs; the last place stands for none."""
        code = left * self.width + right
        at = np.searchsorted(self.codes, code)
        return np.where(self.codes[at] == code, at, self.none)

    def merge_all(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of many short pieces: in each round the first pair of least rank of every piece merges."""
        if not pieces:
            return []
        size = np.array([len(p) for p in pieces], np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        last = np.cumsum(size) - 1
        sym = self.byte_inner[data]
        sym[last] = self.byte_final[data[last]]
        owner = np.repeat(np.arange(len(pieces)), size)
        out: list[list[int]] = [[]] * len(pieces)
        at = np.full(len(sym), self.none)
        at[:-1] = self.looked_up(sym[:-1], sym[1:])
        at[last] = self.none
        while len(sym):
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            size = np.diff(np.r_[start, len(owner)])
            rank = self.ranks[at]
            least = np.minimum.reduceat(rank, start)
            over = least == self.none
            if over.any():
                ended = np.repeat(over, size)
                flat, cut = sym[ended].tolist(), np.r_[0, np.cumsum(size[over])].tolist()
                for k, p in enumerate(owner[start[over]].tolist()):
                    out[p] = flat[cut[k] : cut[k + 1]]
                go = ~ended
                sym, owner, at, rank = sym[go], owner[go], at[go], rank[go]
                size, least = size[~over], least[~over]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            hit = hit[np.r_[True, owner[hit[1:]] != owner[hit[:-1]]]]
            sym[hit] = self.made[at[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            hit -= np.arange(len(hit))
            sym, owner, at = sym[keep], owner[keep], at[keep]
            for i in (hit, hit[hit > 0] - 1):
                j = np.minimum(i + 1, len(sym) - 1)
                same = (owner[i] == owner[j]) & (i < j)
                at[i] = np.where(same, self.looked_up(sym[i], sym[j]), self.none)
        return out

    def piece(self, piece: str, leaf: int = LEAF) -> list[int]:
        raw = piece.encode()
        if len(raw) > leaf:
            return self.tree([self.merge(s) for s in self.leaves(raw, leaf)])
        return self.merge(self.base(raw))

    def leaves(self, raw: bytes, leaf: int) -> list[list[int]]:
        whole = self.base(raw)
        return [whole[i : i + leaf] for i in range(0, len(whole), leaf)]

    def normal(self, text: str) -> str:
        """text in NFC and lower case, character by character."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                return "".join(c.lower() for c in text)
        return text.lower()

    def split(self, text: str) -> list[str]:
        """The pieces of a text."""
        return ASCII_PIECE.findall(text.lower()) if text.isascii() else PIECE.findall(self.normal(text))

    def learn(self, pieces: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of distinct pieces."""
        names, put = self.names, self.pieces.put
        short = [p for p in pieces if len(p) <= SHORT_PIECE // 4]
        found = dict(zip(short, self.merge_all([p.encode() for p in short]), strict=True))
        out = []
        for p in pieces:
            ids = found[p] if len(p) <= SHORT_PIECE // 4 else self.piece(p)
            out.append((struct.pack(f"<{len(ids)}I", *ids), names[ids[0]] if len(ids) == 1 else " ".join([names[i] for i in ids])))
            if len(p) <= SHORT_PIECE:
                put(p, out[-1])
        return out

    def texts(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """(ids, decoded text) of whole texts; pieces that aren't known are learned together."""
        rows: list[list] = []
        for text in texts:
            if not text:
                rows.append([])
            elif "<|" in text and self.cut and self.cut.search(text):
                rows.append([x for s in self.cut.split(text) for x in ([self.special[s]] if s in self.special else self.split(s))])
            else:
                rows.append(self.split(text))
        get, ids, decoded = self.pieces.get, {}, {}
        new = []
        for p in set().union(*rows):
            got = (struct.pack("<I", p), self.names[p]) if isinstance(p, int) else get(p)
            if got is None:
                new.append(p)
            else:
                ids[p], decoded[p] = got
        for p, got in zip(new, self.learn(new), strict=True):
            ids[p], decoded[p] = got
        return [(b"".join([ids[p] for p in row]), " ".join([decoded[p] for p in row])) for row in rows]

    def text(self, text: str | None) -> tuple[bytes, str]:
        """(ids, decoded text) of a whole text."""
        return self.texts([text])[0]

    def decode(self, ids: bytes) -> str:
        names = self.names
        return " ".join([names[i] for i in np.frombuffer(ids, "<u4").tolist()])


_encoders: dict[str, Bpe] = {}


def encoder(path: str | None) -> Bpe:
    """One encoder for each path and Python worker."""
    key = path or default_path()
    if key not in _encoders:
        _encoders[key] = Bpe(key)
    return _encoders[key]


def encode_rows(path: str | None):
    """Batches with text first to the other columns, n_tokens, ids and decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            texts = batch.column(0)
            for i in range(0, len(batch), 500):
                got = bpe.texts(texts.slice(i, 500).to_pylist())
                rest = batch.slice(i, 500)
                yield pa.RecordBatch.from_arrays(
                    [*rest.columns[1:], pa.array([len(g[0]) // 4 for g in got], pa.int64()), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.string())],
                    names=[*rest.schema.names[1:], "n_tokens", "ids", "decoded"],
                )

    return run


def leaf_rows(path: str | None, leaf: int):
    """Batches (text, rk) to (rk, seq, piece, special, symbols): each short stretch or leaf of a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for text, rk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, piece = [], 0
                for s in bpe.cut.split(text) if bpe.cut else [text]:
                    if s in bpe.special:
                        rows.append((rk, len(rows), piece, bpe.special[s], None))
                        piece += 1
                        continue
                    for chunk in (x for x in SPACE.split(s) if x):
                        for p in bpe.split(chunk):
                            for symbols in bpe.leaves(p.encode(), leaf):
                                rows.append((rk, len(rows), piece, -1, np.asarray(symbols, "<u4").tobytes()))
                            piece += 1
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                        names=["rk", "seq", "piece", "special", "symbols"],
                    )

    return run


def merge_rows(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            ids = [None if s is None else np.asarray(bpe.merge(np.frombuffer(s, "<u4").tolist()), "<u4").tobytes() for s in batch.column("symbols").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.binary())], names=["rk", "seq", "piece", "special", "ids"])

    return run


def _encode_long(docs: DataFrame, path: str | None, leaf: int) -> DataFrame:
    """rk and ids of texts with long chunks: leaves are encoded as rows of their own, then joined."""

    def concat(part: pd.DataFrame) -> pd.DataFrame:
        bpe = encoder(path)
        part = part.sort_values("seq")
        out: list[int] = []
        for _, rows in part.groupby("piece", sort=True):
            if rows["special"].iloc[0] >= 0:
                out.append(int(rows["special"].iloc[0]))
            else:
                out += bpe.tree([np.frombuffer(x, "<u4").tolist() for x in rows["ids"]])
        raw = np.asarray(out, "<u4").tobytes()
        return pd.DataFrame({"rk": [part["rk"].iloc[0]], "n_tokens": [len(out)], "ids": [raw], "decoded": [bpe.decode(raw)]})

    rows = docs.select("text", "rk").distinct().mapInArrow(leaf_rows(path, leaf), "rk binary, seq long, piece long, special long, symbols binary")
    rows = rows.repartition("rk", F.floor(F.col("seq") / 8)).mapInArrow(merge_rows(path), "rk binary, seq long, piece long, special long, ids binary")
    return rows.groupBy("rk").applyInPandas(concat, "rk binary, n_tokens long, ids binary, decoded string")


def encode(docs: DataFrame, path: str | None = None, leaf: int = LEAF, long_chunk: int = LONG_CHUNK) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and decoded of each text."""
    base = docs.select(F.col("text"), F.col("doc_id"))
    is_long = (F.coalesce(F.length("text"), F.lit(0)) >= long_chunk) & F.coalesce(F.col("text").rlike(r"\S{%d}" % long_chunk), F.lit(False))
    short = base.where(~is_long).mapInArrow(sh.frugal(encode_rows(path)), "doc_id long, n_tokens long, ids binary, decoded string")
    long = base.where(is_long).withColumn("rk", sh.row_key())
    joined = long.select("doc_id", "rk").join(_encode_long(long, path, leaf), "rk", "left")
    empty = F.unhex(F.lit(""))
    joined = joined.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("ids", empty).alias("ids"), F.coalesce("decoded", F.lit("")).alias("decoded"))
    return short.unionByName(joined)


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            texts = [bpe.decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def op8_bpe(spark, sf_dir) -> DataFrame:
    """Contract query: digests of the ids and of the decoded text of each whole document."""
    sh.small_batches(spark)
    out = encode(sh.documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
