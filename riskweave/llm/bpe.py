"""Token ids of whole texts for byte-level BPE vocabularies, vectorised per block.

The text is cut into pre-token pieces with array operations on its code
points; each distinct piece of a block is encoded once and the ids are
gathered back.  The ids equal those of the ``tokenizers`` library for the
same file (``add_special_tokens=False``, special strings as ordinary text),
which the tests compare; texts with unassigned code points go through that
library as a whole, since Unicode versions may differ on them.
"""

from __future__ import annotations

import functools
import json
import sys
import unicodedata

import numpy as np

from .text import mix

LETTER, NUMBER, OTHER, BLANK, UNKNOWN = 0, 1, 2, 3, 4
#: Code points with the White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
PIECES_KEPT = 300_000  # distinct pieces remembered between blocks; only a cache


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((UNKNOWN if (c := unicodedata.category(chr(i))) == "Cn" else kind.get(c[0], OTHER)
                       for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[WHITE_SPACE] = BLANK
    return out


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, as letter -> byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder for one vocabulary file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [vocab[a + b] for a, b in merges]
        letters = byte_letters()
        # ids in merge order: then a piece's ids follow from the ranks alone
        self.by_rank = made == sorted(made) and all(c in vocab for c in letters)
        if self.by_rank:
            used = set(made) | {vocab[c] for c in letters}
            ranks = {bytes(letters[c] for c in tok): i for tok, i in vocab.items() if i in used}
            self._one = tiktoken.Encoding("ranks", pat_str=r"\S+|\s+", mergeable_ranks=ranks,
                                          special_tokens={})._encode_single_piece
        self._forget()

    def _forget(self):
        self.known: dict[int, int] = {}
        self.ids = np.empty(1 << 16, np.int32)
        self.ptr = [0]

    def _encode(self, pieces: list[str]) -> list[list[int]]:
        if self.by_rank:
            one = self._one
            return [one(p.encode()) for p in pieces]
        return [e.ids for e in self.whole.encode_batch(pieces, add_special_tokens=False)]

    def _learn(self, keys: list[int], pieces: list[str]) -> None:
        for k, got in zip(keys, self._encode(pieces)):
            end = self.ptr[-1] + len(got)
            if end > len(self.ids):
                self.ids = np.concatenate([self.ids, np.empty(max(len(self.ids), len(got)), np.int32)])
            self.ids[self.ptr[-1]:end] = got
            self.known[k] = len(self.ptr) - 1
            self.ptr.append(end)

    def encode(self, data: bytes, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, document pointers) of a block given as UTF-8 bytes and byte offsets from 0."""
        n_docs = len(offs) - 1
        if len(data) == 0:
            return np.zeros(0, np.int32), np.zeros(n_docs + 1, np.int64)
        text = data.decode("utf-8")
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        bounds = np.searchsorted(lead, offs)
        start = piece_starts(cp, bounds)
        if start is None:
            return self._whole_texts(text, bounds)
        ends = np.append(start[1:], len(cp))
        key = piece_hashes(cp, start, ends)
        uniq, first, back = np.unique(key, return_index=True, return_inverse=True)
        names = uniq.tolist()
        if len(self.known) > PIECES_KEPT:
            self._forget()
        at = [self.known.get(k, -1) for k in names]
        new = [i for i, a in enumerate(at) if a < 0]
        if new:
            s, e = start[first[new]].tolist(), ends[first[new]].tolist()
            base = len(self.ptr) - 1
            self._learn([names[i] for i in new], [text[a:b] for a, b in zip(s, e)])
            for k, i in enumerate(new):
                at[i] = base + k
        ptr = np.asarray(self.ptr, np.int64)
        at = np.asarray(at, np.int64)[back]
        size = ptr[at + 1] - ptr[at]
        out_ptr = np.concatenate([[0], np.cumsum(size)])
        src = np.repeat(ptr[at] - out_ptr[:-1], size) + np.arange(out_ptr[-1])
        return self.ids[src], out_ptr[np.searchsorted(start, bounds)]

    def _whole_texts(self, text: str, bounds: np.ndarray):
        parts = [text[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        got = [np.asarray(e.ids, np.int32) for e in self.whole.encode_batch(parts, add_special_tokens=False)]
        return (np.concatenate(got) if got else np.zeros(0, np.int32)), \
            np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int64)


def piece_starts(cp: np.ndarray, bounds: np.ndarray) -> np.ndarray | None:
    """First code point of every pre-token piece; None if a code point's class is not certain.

    Pieces are: an apostrophe contraction; an optional space with a run of
    letters, of numbers or of other characters; white space up to the last
    character before a word; that last character where it is no plain space.
    """
    n = len(cp)
    kind = classes()[cp]
    if (kind == UNKNOWN).any():
        return None
    first = np.zeros(n + 3, bool)
    first[bounds] = True
    first[n:] = True
    same = np.zeros(n + 3, bool)           # same[i]: i continues the run of i - 1
    same[1:n] = (kind[1:] == kind[:-1]) & ~first[1:n]
    start = ~same
    blank = kind == BLANK
    last = np.flatnonzero(blank & ~first[1:n + 1] & ~np.append(blank[1:], True))
    start[last] = True
    start[last[cp[last] == 32] + 1] = False
    quote = np.flatnonzero(cp == 39)
    quote = quote[start[quote] & ~same[quote] & ~first[quote + 1]]
    if len(quote):
        pad = np.concatenate([cp, np.zeros(3, np.uint32)])
        a, b = pad[quote + 1], pad[quote + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ~first[quote + 2] & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e")))
                                   | ((a == ord("l")) & (b == ord("l"))))
        for at, size in ((quote[one], 1), (quote[two], 2)):
            start[at + 1] = False
            rest = at + 1 + size
            start[rest[same[rest]]] = True
    return np.flatnonzero(start[:n])


@functools.lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    return mix(np.arange(sys.maxunicode + 1, dtype=np.uint64) + np.uint64(0x51ED27)) | np.uint64(1)


def piece_hashes(cp: np.ndarray, start: np.ndarray, ends: np.ndarray) -> np.ndarray:
    from .text import powers
    p, inv = powers(len(cp) + 1)
    run = np.empty(len(cp) + 1, np.uint64)
    run[0] = 0
    np.cumsum(_codes()[cp] * p[:len(cp)], out=run[1:])
    h = (run[ends] - run[start]) * inv[start]
    return mix(h + (ends - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@functools.lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)
