"""Vectorised byte-level words and Rabin-Karp hashes over Arrow text buffers.

All functions work on a block: the UTF-8 bytes of several documents, back to back, and the
offsets at which each begins. Word separators are ASCII bytes here, so bytes decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
MASK = (1 << 64) - 1
#: Bytes in a block, unless one text alone is longer.
BLOCK_BYTES = 1 << 19

#: Words of anything but ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words of ASCII digits, lower-case ASCII letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

BYTE_BASE, BYTE_BASE_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
WORD_BASE, WORD_BASE_2 = 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; base is odd."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, BLOCK_BYTES + (1 << 16))
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, U64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=U64))
        got = (both[0], both[1])
        if n <= BLOCK_BYTES + (1 << 16):
            _powers[base] = got
    return got[0][:n], got[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts of about limit bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of the words, and the number of the first word of each text."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    inside = table[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = offs[(offs > 0) & (offs < n)]
    before[edge], after[edge - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BYTE_BASE) -> np.ndarray:
    """A 64-bit hash of each byte span, by prefix sums of byte * base**i."""
    up, down = powers(base, len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def window_hash(hashes: np.ndarray, n: int, base: int = WORD_BASE) -> np.ndarray:
    """A 64-bit hash of each n consecutive word hashes, across texts too; len(hashes) - n + 1 values."""
    k = len(hashes)
    if k < n:
        return np.empty(0, U64)
    up, down = powers(base, k + 1)
    sums = np.zeros(k + 1, U64)
    np.cumsum(hashes * up[:k], out=sums[1:])
    return mix((sums[n:] - sums[: k - n + 1]) * down[: k - n + 1])


def range_hash(hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int = WORD_BASE) -> np.ndarray:
    """A 64-bit hash of each run of word hashes [lo, hi)."""
    k = len(hashes)
    up, down = powers(base, k + 1)
    sums = np.zeros(k + 1, U64)
    np.cumsum(hashes * up[:k], out=sums[1:])
    return mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(U64))


def owners(first: np.ndarray) -> np.ndarray:
    """The text of each word, from words()' first."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def inside(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which windows of n words, of total words, lie in one text."""
    k = max(0, total - n + 1)
    if not k:
        return np.zeros(0, bool)
    end = np.repeat(first[1:], np.diff(first))[:k]
    return np.arange(k) + n <= end


def joined(data: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> list[bytes]:
    """The kept words of each text, joined by one space."""
    n = len(data)
    mark = np.zeros(n + 2, np.int32)
    s, e = starts[keep], ends[keep]
    np.add.at(mark, s, 1)
    np.add.at(mark, e + 1, -1)
    take = np.cumsum(mark[:n]) > 0
    out = data.copy()
    limit = np.zeros(n + 1, bool)
    limit[offs] = True
    sep = e[~limit[e]]
    out[sep] = 0x20
    take[e[limit[e] & (e < n)]] = False
    take[s] = True
    upto = np.zeros(n + 1, np.int64)
    np.cumsum(take, out=upto[1:])
    packed = out[take].tobytes()
    cut = upto[offs]
    result = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        piece = packed[a:b]
        result.append(piece[:-1] if piece.endswith(b" ") else piece)
    return result


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return x.view(np.int64)
