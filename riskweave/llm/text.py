"""Vectorised text kernels shared by the operators: Arrow batches in, numpy arrays out.

Every kernel works on the UTF-8 bytes of a block of whole documents.  Blocks
only bound the working memory (a document is never cut); results do not depend
on how rows fall into batches or blocks.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
MASK64 = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1  # odd, so invertible modulo 2**64


def _tables():
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    space = np.zeros(256, dtype=bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    codes = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return lower, space, codes


LOWER, SPACE, CODES = _tables()


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    inv = pow(_P, -1, 1 << 64)
    out = []
    for base in (_P, inv):
        p = np.empty(n, dtype=np.uint64)
        p[0] = 1
        k = 1
        while k < n:  # doubling: p[k:2k] = p[:k] * base**k
            m = min(k, n - k)
            p[k:k + m] = p[:m] * np.uint64(pow(base, k, 1 << 64))
            k += m
        out.append(p)
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = BLOCK_BYTES
    while size < n:
        size *= 2
    return _powers(size)


CHUNK = 1 << 14              # values hashed at a time: they stay in the processor's cache


def _mix_here(h: np.ndarray, spare: np.ndarray) -> None:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
        np.right_shift(h, np.uint64(shift), out=spare)
        h ^= spare
        if factor:
            h *= np.uint64(factor)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the word."""
    h = h.astype(np.uint64, copy=True)
    spare = np.empty(min(len(h), CHUNK), np.uint64)
    for at in range(0, len(h), CHUNK):
        _mix_here(h[at:at + CHUNK], spare[:len(h) - at])
    return h


def combine(parts: list[np.ndarray], salt: int = 0) -> np.ndarray:
    """Order-dependent hash of equally long arrays of hashes."""
    acc = np.full(len(parts[0]), np.uint64(salt & MASK64), dtype=np.uint64)
    spare = np.empty(min(len(acc), CHUNK), np.uint64)
    for at in range(0, len(acc), CHUNK):
        here = acc[at:at + CHUNK]
        for p in parts:
            here *= np.uint64(_P)
            here += p[at:at + CHUNK]
            _mix_here(here, spare[:len(here)])
    return acc


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is an empty one."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + n + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offs


def blocks(offs: np.ndarray, size: int | None = None):
    """Document ranges (lo, hi) of about ``size`` bytes each; one long document may be larger."""
    size = size or BLOCK_BYTES
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


class Words:
    """Words of a block: byte range, hash and document of each, in order.

    ``sep`` marks the separator bytes; ``doc_ptr`` gives each document's first
    word (length = documents + 1).
    """

    def __init__(self, raw: np.ndarray, offs: np.ndarray, lower: bool = True, sep: np.ndarray = SPACE):
        base = offs[0]
        b = raw[base:offs[-1]]
        bounds = (offs - base).astype(np.int64)
        self.bytes = LOWER[b] if lower else b
        n = len(b)
        gap = np.ones(n + 1, dtype=bool)
        gap[:n] = sep[self.bytes]
        first = np.zeros(n + 1, dtype=bool)
        first[bounds] = True
        inside = ~gap[:n]
        prev_gap = np.empty(n, dtype=bool)
        if n:
            prev_gap[0] = True
            prev_gap[1:] = gap[:n - 1]
        self.start = np.flatnonzero(inside & (prev_gap | first[:n]))
        self.end = np.flatnonzero(inside & (gap[1:] | first[1:])) + 1
        self.doc_ptr = np.searchsorted(self.start, bounds)
        self.n_docs = len(bounds) - 1

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word (of its bytes and its length)."""
        n = len(self.bytes)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        p, inv = powers(n + 1)
        run = np.empty(n + 1, dtype=np.uint64)
        run[0] = 0
        np.cumsum(CODES[self.bytes] * p[:n], out=run[1:])
        h = (run[self.end] - run[self.start]) * inv[self.start]
        return mix(h + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def counts(self) -> np.ndarray:
        return np.diff(self.doc_ptr)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts())


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, document) of every window of ``k`` words inside one document."""
    c = words.counts()
    n = np.maximum(c - (k - 1), 0)
    doc = np.repeat(np.arange(words.n_docs), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + words.doc_ptr[:-1][doc]
    return at, doc


def ragged(values: np.ndarray, ptr: np.ndarray, typ: pa.DataType) -> pa.Array:
    """A list column from flat values and row pointers."""
    return pa.LargeListArray.from_arrays(pa.array(ptr.astype(np.int64)), pa.array(values, typ)) \
        if len(values) > 2**31 - 2 else \
        pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(values, typ))
