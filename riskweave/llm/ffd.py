"""First-fit decreasing with a tournament tree, run independently in randomised groups of documents.

A document is its token ids and an end id.  Whole sequences of a long document
are cut off its front; the rest of it (shorter than a sequence) is packed with
the rests of its group.  Groups are drawn by a stored random number, hold about
``group_rows`` pieces whatever the corpus, and need one shuffle of the ids.
Inside a group first-fit decreasing finds every piece's bin by walking down a
tree that keeps the larger room of each pair of bins; then the emptiest bins
are dissolved into the gaps of the fullest, so that all sequences but one are
full, and that one is cut at the powers of two of its length, which need no
padding.  A group so ends with at most log2(capacity) short sequences.

Edge cases: a null or empty text is the end id alone; repeated rows are packed
once each; a null id is carried through; an empty table gives no rows; very
long texts are read in parts cut at blanks, never as a prefix.  Columns other
than ``doc_id`` and ``text`` are not read, whatever their names.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .store import written
from .text import mix

CAPACITY = 2048
END_ID = 1
#: Expected pieces of a group: a few MB of ids.
GROUP_ROWS = 4096
SEED = 13
PART_CHARS = 1 << 20      # a text is encoded in parts of about this size
KEPT_BYTES = 160 << 20    # encoded words and pieces remembered between texts; only a cache


class Tournament:
    """Rooms of bins in a winner tree: an inner node holds the larger room below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Put ``size`` into the first bin with room for it."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        room[at] -= size
        first = at - self.leaves
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
        return first


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of indexes into ``sizes``, largest first; equal sizes in the given order."""
    tree, bins = Tournament(len(sizes), capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = tree.place(sizes[i])
        if at == len(bins):
            bins.append([])
        bins[at].append(i)
    return bins


def fill_gaps(bins: list[list[tuple[int, int, int]]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Dissolve the emptiest bins into the gaps of the fullest; cut what is left at powers of two.

    Bins hold (item, start in it, length).  All results but those of the last
    bin have the full capacity.
    """
    order = sorted(bins, key=lambda b: sum(p[2] for p in b))
    gaps = [capacity - sum(p[2] for p in b) for b in order]
    lo, hi = 0, len(order) - 1
    while lo < hi:
        if not gaps[hi]:
            hi -= 1
        elif not order[lo]:
            lo += 1
        else:
            item, start, size = order[lo].pop()
            moved = min(size, gaps[hi])
            if moved < size:
                order[lo].append((item, start, size - moved))
            order[hi].append((item, start + size - moved, moved))
            gaps[hi] -= moved
            gaps[lo] += moved
    full = [b for i, b in enumerate(order) if b and i != lo]
    last = order[lo] if order else []
    return full + (binary_parts(last) if order and gaps[lo] else [last] if last else [])


def binary_parts(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Cut a run of pieces into runs whose lengths are the powers of two of its total, largest first."""
    total, out, queue = sum(p[2] for p in pieces), [], list(reversed(pieces))
    for k in reversed(range(total.bit_length())):
        if not total >> k & 1:
            continue
        need, run = 1 << k, []
        while need:
            item, start, size = queue.pop()
            if size > need:
                queue.append((item, start + need, size - need))
                size = need
            run.append((item, start, size))
            need -= size
        out.append(run)
    return out


# ---------------------------------------------------------------- token ids
#: The pieces of the word vocabularies (as their files state it) ..
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: .. and the same for words of printable ASCII and Latin-1 letters alone.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PLAIN_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class Coder:
    """Ids of texts under a vocabulary whose pieces never span a blank, each distinct word encoded once.

    Blank, tab, line feed and carriage return separate; what lies between two
    of them has the same ids wherever it stands, so the ids of a text are those
    of its words, one after the other.  Words of printable ASCII and Latin-1
    letters are split here and their pieces go to the library's BPE model;
    all other words go through the whole library.  The tests compare with whole
    texts.  Other vocabularies are encoded text by text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = [s["type"] for s in (made["normalizer"] or {}).get("normalizers", [])]
        splits = (made["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and splits[0].get("pattern") == {"Regex": SPLIT}
        self.model = self.tok.model
        self.letters = {b: c for c, b in byte_letters().items()}
        self.wide = {c: "".join(self.letters[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        self.four = [i.to_bytes(4, "little") for i in range(self.tok.get_vocab_size())]
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.size = 0

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            text = piece if piece.isascii() else piece.translate(self.wide)
            ids = self.pieces[piece] = b"".join([self.four[t.id] for t in self.model.tokenize(text)])
            self.size += len(ids) + len(piece) + 170
        return ids

    def _learn(self, words: list[str]) -> None:
        rest = []
        for w in words:
            if PLAIN.fullmatch(w):
                ids = self.words[w] = b"".join([self._piece(p) for p in PLAIN_SPLIT.findall(w.lower())])
                self.size += len(ids) + len(w) + 170
            else:
                rest.append(w)
        for w, e in zip(rest, self.tok.encode_batch(rest, add_special_tokens=False)):
            self.words[w] = np.asarray(e.ids, "<u4").tobytes()
            self.size += len(self.words[w]) + 4 * len(w) + 170

    def encode(self, text: str) -> bytes:
        """Token ids, four little-endian bytes each."""
        if not self.by_word:
            return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        out = []
        for part in parts(text):
            words = part.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            if self.size > KEPT_BYTES:
                self.words.clear()
                self.pieces.clear()
                self.size = 0
            new = set(words).difference(self.words)
            if new:
                self._learn(list(new))
            out.append(b"".join(map(self.words.__getitem__, words)))
        return b"".join(out)


def parts(text: str, size: int | None = None):
    """The text in parts of about ``size`` characters, cut before a blank."""
    size, at = size or PART_CHARS, 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


@functools.lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"   # a Spark task has one core
    return Coder(path)


# ---------------------------------------------------------------- Spark side
CUT = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()),
                 ("draw", pa.int64())])


def cut_documents(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, seed: int) -> DataFrame:
    """Pieces of at most ``capacity`` ids (two bytes an id where they fit, else four) with a random number each."""
    def run(batches):
        code, task, nth = coder(vocabulary), TaskContext.get().partitionId(), 0
        for rb in batches:
            rows, held = [], 0
            for doc_id, text in zip(rb.column("doc_id"), rb.column("text")):
                text = (text.as_py() or b"").decode("utf-8", "replace")
                ids = np.append(np.frombuffer(code.encode(text), "<u4"), np.uint32(end_id))
                for start in range(0, len(ids), capacity):
                    piece = ids[start:start + capacity]
                    wide = int(piece.max()) > 0xFFFF
                    rows.append((doc_id.as_py(), len(ids), start,
                                 b"\x04" + piece.astype("<u4").tobytes() if wide else b"\x02" + piece.astype("<u2").tobytes(),
                                 nth))
                    nth += 1
                    held += len(rows[-1][3])
                if held > 1 << 22:
                    yield drawn(rows, task, seed)
                    rows, held = [], 0
            yield drawn(rows, task, seed)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").cast("binary").alias("text"))
    return given.mapInArrow(run, "doc_id long, doc_tokens long, start long, ids binary, draw long")


def drawn(rows: list[tuple], task: int, seed: int) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 5
    key = mix(np.asarray(cols[4], np.uint64) + np.uint64((task + 1) << 36) + mix(np.array([seed], np.uint64)))
    return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(cols[:4], CUT)),
                                       pa.array((key >> np.uint64(1)).astype(np.int64))], schema=CUT)


def widen(ids: bytes) -> bytes:
    return ids[1:] if ids[0] == 4 else np.frombuffer(ids, "<u2", offset=1).astype("<u4").tobytes()


def pack_group(table: pa.Table, group: int, capacity: int) -> pa.Table:
    """All pieces of one group with their sequence and offset."""
    table = table.sort_by([("draw", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
    ids = [widen(x) for x in table.column("ids").to_pylist()]
    sizes = [len(x) // 4 for x in ids]
    short = [i for i, n in enumerate(sizes) if n < capacity]
    bins = [[(short[j], 0, sizes[short[j]]) for j in b] for b in first_fit_decreasing([sizes[i] for i in short], capacity)]
    sequences = [[(i, 0, n)] for i, n in enumerate(sizes) if n == capacity] + fill_gaps(bins, capacity)
    rows = []
    for number, pieces in enumerate(sequences):
        offset = 0
        for item, start, size in pieces:
            rows.append((item, start, ids[item][4 * start:4 * (start + size)], size, (group << 32) + number, offset))
            offset += size
    item, start, data, size, number, offset = zip(*rows)
    item = np.asarray(item)
    return pa.table({"doc_id": table.column("doc_id").take(pa.array(item)),
                     "start": pa.array(table.column("start").to_numpy()[item] + np.asarray(start)),
                     "length": pa.array(size, pa.int64()), "ids": pa.array(data, pa.binary()),
                     "doc_tokens": table.column("doc_tokens").take(pa.array(item)),
                     "sequence_id": pa.array(number, pa.int64()), "offset": pa.array(offset, pa.int64())})


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID,
         group_rows: int = GROUP_ROWS, seed: int = SEED) -> DataFrame:
    """Per piece: doc_id, start, length, ids (four little-endian bytes each), doc_tokens, sequence_id, offset."""
    cut = written(cut_documents(docs, vocabulary, capacity, end_id, seed), "ffd-pieces")
    groups = max(1, -(-cut.count() // group_rows))

    def run(key, table):
        return pack_group(table, key[0].as_py(), capacity)
    return (cut.withColumn("group", F.pmod("draw", F.lit(groups))).groupBy("group")
            .applyInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, "
                               "sequence_id long, offset long"))


def padding(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, tokens, padded tokens (none at a power of two)."""
    s = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    pad = F.when(F.expr("n & (n - 1)") == 0, 0).otherwise(capacity - F.col("n"))
    return s.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(pad).alias("padded"))


def op13_ffd_packing(docs: DataFrame, vocabulary: str) -> DataFrame:
    return pack(docs, vocabulary).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                                         "sequence_id", "offset")
