"""Interpolated modified Kneser-Ney n-gram model, counted in Spark, memory-mapped for scoring.

Counting: every task reduces its texts to distinct n-grams (64-bit word
hashes) with counts and deals them by a hash of the context into shards;
the task of a shard merges what all tasks found, writes its sorted arrays as
files to the shared folder and passes each distinct n-gram's suffix on, whose
number of distinct left neighbours is the count of the next lower order.  So
each order is one shuffle, and the number of shards grows with the corpus.

Stored are counts: for every order and shard the sorted n-gram hashes with
their counts, and the sorted context hashes with their total and the numbers
of followers seen once, twice and more often.  Discounts come from the counts
of counts.  Workers map the files (those of a store that cannot be mapped are
copied to the worker's own temporary folder, mapped and unlinked) and look up
sorted queries, so only touched pages are read.

Scoring: the texts are stored in batches; each batch deals its distinct
contexts and n-grams of an order, sorted, to the shards, the task of a shard
maps that shard's files once and answers all batches, and a batch puts its
answers, which come in the order of its own sorted queries, together.  So each
file is read once however large the corpus, and no task needs more than one
shard or one batch.

A text is its words and an end mark, after n - 1 begin marks.  A word that was
never seen has the share of the uniform distribution over V + 1 words.

Edge cases: a null or empty text is its end mark; rows with a null id are
scored, and train as their crc tells (an empty text's); repeated rows count
each; without training text all probabilities are 1.
"""

from __future__ import annotations

import functools
import io
import os
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import drop, file_system, id_crc, put, release, shared_folder, written
from .text import Words, blocks, combine, mix, utf8

BEGIN, END = np.uint64(0xB0B0B0B0B0B0B0B1), np.uint64(0xE0E0E0E0E0E0E0E1)
HIGH = np.uint64(0xFFFFFFFF00000000)
SHARD_BYTES = 24 << 20       # text bytes per shard of counts
SCORE_BYTES = 8 << 20        # text bytes per batch of scored documents
ANSWER_KEYS = 1 << 22        # keys a shard's task looks up at a time
TOKEN_BYTES = 1 << 18        # text bytes cut into words at a time
HOLD = 3_000_000             # n-grams a task holds before it merges them
RAW = 0                      # the level of the plain word counts
BLOBS = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("shard", T.IntegerType()),
                      T.StructField("words", T.BinaryType()), T.StructField("counts", T.BinaryType()),
                      T.StructField("n", T.LongType())])


def tokens(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes with an end mark after each document, document pointers)."""
    w = Words(raw, offs)
    return np.insert(w.hashes(), w.doc_ptr[1:], END), w.doc_ptr + np.arange(len(w.doc_ptr))


def ngrams(tok: np.ndarray, ptr: np.ndarray, order: int) -> list[np.ndarray]:
    """The ``order`` words of the n-gram that ends at every token, oldest first."""
    at = np.arange(len(tok)) - np.repeat(ptr[:-1], np.diff(ptr))
    out = []
    for back in range(order - 1, -1, -1):
        col = np.empty_like(tok)
        col[back:] = tok[:len(tok) - back]
        col[at < back] = BEGIN
        out.append(col)
    return out


def context_key(cols: list[np.ndarray]) -> np.ndarray:
    return combine(cols[:-1], salt=len(cols)) if len(cols) > 1 else mix(cols[0] ^ np.uint64(0x77))


def gram_key(cols: list[np.ndarray], ctx: np.ndarray, bits: int) -> np.ndarray:
    """Hash of the n-gram; its first ``bits`` bits, the shard, are those of the context."""
    if bits == 0:
        return combine([ctx, cols[-1]])
    low = combine([ctx, cols[-1]]) >> np.uint64(bits)
    return (ctx >> np.uint64(64 - bits) << np.uint64(64 - bits)) | low


def merge(cols: list[np.ndarray], counts: np.ndarray, key: np.ndarray):
    """Distinct n-grams in order of their key, with summed counts (equal keys may come in any order)."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(counts[order], first) if len(key) else counts
    return [c[order[first]] for c in cols], total, key[first]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their counts.  np.unique hashes since numpy 2.3, fifty times as slow on such keys."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(first, append=len(keys))


def places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the place of every key in them."""
    order = np.argsort(keys)
    there = keys[order]
    first = np.append(True, there[1:] != there[:-1])[:len(keys)]
    back = np.empty(len(keys), np.int32 if len(keys) < 1 << 31 else np.int64)
    back[order] = np.cumsum(first, dtype=back.dtype) - 1
    return there[first], back


def _runs(context: list[np.ndarray]) -> np.ndarray:
    """An order that puts equal contexts, and contexts with the same last word, beside each other."""
    near, far = context[-1], combine(context[:-1]) if len(context) > 2 else context[0]
    return np.argsort(near if len(context) == 1 else (near & HIGH) | (far >> np.uint64(32)))


def _out(level: int, cols, counts, key, bits: int):
    """One row per shard; cols sorted by key, so each shard is a slice."""
    if not len(key):
        return
    shard = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
    cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]).tolist() + [len(shard)]
    rows = []
    for a, b in zip(cut[:-1], cut[1:]):
        like = _runs([c[a:b] for c in cols[:-1]]) if len(cols) > 1 else slice(None)   # runs of a context shuffle small
        small = counts[a:b][like].astype(np.min_scalar_type(int(counts[a:b].max())))
        rows.append((level, int(shard[a]), b"".join(c[a:b][like].tobytes() for c in cols), small.tobytes(), b - a))
    for at in range(0, len(rows), 64):
        part = list(zip(*rows[at:at + 64]))
        yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), pa.array(part[1], pa.int32()),
                                          pa.array(part[2], pa.binary()), pa.array(part[3], pa.binary()),
                                          pa.array(part[4], pa.int64())], names=BLOBS.names)


def _counted(order: int, bits: int):
    """mapInArrow over training texts: n-grams of the highest order and words, merged per task."""
    def run(batches):
        held: dict[int, list] = {order: [], RAW: []}     # (words, counts, key) of n-grams, not all distinct

        def squeeze(level):
            if not held[level]:
                return [], np.zeros(0, np.int64), np.zeros(0, np.uint64)
            cols = [np.concatenate(c) for c in zip(*(x[0] for x in held[level]))]
            held[level] = [merge(cols, *(np.concatenate([x[i] for x in held[level]]) for i in (1, 2)))]
            return held[level][0]

        def flush():
            for level in (order, RAW):
                yield from _out(level, *squeeze(level), bits)
                held[level] = []

        for rb in batches:
            raw, offs = utf8(rb.column("text"))
            for lo, hi in blocks(offs, TOKEN_BYTES):
                tok, ptr = tokens(raw, offs[lo:hi + 1])
                cols = ngrams(tok, ptr, order)
                words, n = distinct(tok)
                for level, c, seen in ((order, cols, np.ones(len(tok), np.int64)), (RAW, [words], n)):
                    held[level].append((c, seen, gram_key(c, context_key(c), bits)))
                if sum(len(x[1]) for x in held[order]) > HOLD:
                    squeeze(order), squeeze(RAW)
                    if len(held[order][0][1]) > HOLD // 2:
                        yield from flush()
        yield from flush()
    return run


# ---------------------------------------------------------------- files in the shared folder
def _put(uri: str, name: str, array: np.ndarray) -> None:
    data = io.BytesIO()
    np.save(data, array)
    put(uri, f"{name}.npy", data.getbuffer())


@functools.lru_cache(maxsize=4096)
def _mapped(uri: str, name: str) -> np.ndarray:
    store, path = file_system(uri)
    full = f"{path}/{name}.npy"
    if isinstance(store, fs.LocalFileSystem):
        return np.load(full, mmap_mode="r") if os.path.exists(full) else np.zeros(0, np.uint64)
    if store.get_file_info(full).type == fs.FileType.NotFound:
        return np.zeros(0, np.uint64)
    with tempfile.NamedTemporaryFile(suffix=".npy") as own:   # unlinked at once; the mapping keeps it
        with store.open_input_stream(full) as f:
            while block := f.read(1 << 22):
                own.write(block)
        own.flush()
        return np.load(own.name, mmap_mode="r")


def _write_level(uri: str, level: int, shard: int, cols, counts, key) -> None:
    """Files of one order and shard: n-grams with counts, contexts with their totals and follower numbers."""
    name = f"{level}-{shard}"
    _put(uri, f"{name}-key", key)
    _put(uri, f"{name}-count", counts.astype(np.min_scalar_type(int(counts.max()))))
    if level > 1:
        ctx = context_key(cols)
        order = np.argsort(ctx)
        c, n = ctx[order], counts[order]
        first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        _put(uri, f"{name}-context", c[first])
        totals = {"total": n, **{f"n{i}": seen for i, seen in enumerate((n == 1, n == 2, n > 2), 1)}}
        for what, x in totals.items():
            x = np.add.reduceat(x.astype(np.int64), first)
            _put(uri, f"{name}-{what}", x.astype(np.min_scalar_type(int(x.max()))))


STATS = T.StructType([*BLOBS.fields, T.StructField("stats", T.ArrayType(T.LongType()))])


def _merged(uri: str, bits: int):
    """applyInArrow for a (level, shard): write its files, pass on the suffixes, report counts of counts.

    The report holds the number of n-grams with count 1, 2, 3, 4 and 5 or
    more, the number of distinct n-grams and the sum of the counts.
    """
    def run(key, table):
        level, shard = key[0].as_py(), key[1].as_py()
        width, cols, counts = max(level, 1), [], []
        for rb in table.to_batches():
            for w, c, n in zip(rb.column("words"), rb.column("counts"), rb.column("n").to_pylist()):
                cols.append(np.frombuffer(w.as_buffer(), np.uint64).reshape(width, n))
                data = c.as_buffer()
                counts.append(np.frombuffer(data, f"u{data.size // n}").astype(np.int64))
        cols = list(np.concatenate(cols, axis=1))
        cols, counts, k = merge(cols, np.concatenate(counts), gram_key(cols, context_key(cols), bits))
        _write_level(uri, level, shard, cols, counts, k)
        report = [int((counts == i).sum()) for i in range(1, 5)] + [len(counts), int(counts.sum())]
        out = []
        if level > 1:
            rest = cols[1:]
            rest, ones, rk = merge(rest, np.ones(len(counts), np.int64), gram_key(rest, context_key(rest), bits))
            out = list(_out(level - 1, rest, ones, rk, bits))
        out.append(pa.RecordBatch.from_arrays(
            [pa.array([level], pa.int32()), pa.array([shard], pa.int32()), pa.array([None], pa.binary()),
             pa.array([None], pa.binary()), pa.array([0], pa.int64())], names=BLOBS.names))
        full = [pa.RecordBatch.from_arrays(
            [*b.columns, pa.array([report if w is None else None for w in b.column("words").to_pylist()],
                                  pa.list_(pa.int64()))], names=STATS.names) for b in out]
        return pa.Table.from_batches(full)
    return run


@dataclass
class Model:
    uri: str
    order: int
    bits: int
    discounts: dict[int, tuple[float, float, float]]   # per order, for counts 1, 2 and 3 or more
    bigrams: float                                     # sum of the lowest order's counts
    follow: tuple[int, int, int]                       # words of the lowest order with count 1, 2, more
    vocabulary: int                                    # V
    train_tokens: int                                  # N


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts; 0.5, 1 and 1.5 where the counts of counts give none."""
    if min(n1, n2, n3, n4) > 0:
        y = n1 / (n1 + 2 * n2)
        d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        if all(0 <= x <= i for i, x in enumerate(d, 1)):
            return d
    return 0.5, 1.0, 1.5


def fit(docs: DataFrame, order: int = 3) -> Model:
    """Count all texts of ``docs``; the model's files lie in the shared folder."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (max(1, size // SHARD_BYTES) - 1).bit_length())
    uri = shared_folder(spark, "lm")
    text = docs.select(F.col("text").cast("string").alias("text"))
    rows = text.mapInArrow(_counted(order, bits), BLOBS)
    stats: dict[int, np.ndarray] = {}
    done = None
    for level in range(order, 0, -1):
        here = [level, RAW] if level == order else [level]
        before, done = done, written(rows.groupBy("level", "shard").applyInArrow(_merged(uri, bits), STATS), "counts")
        for r in done.where("stats is not null").groupBy("level").agg(
                *[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(6)]).collect():   # a row per level
            if r["level"] in here:
                stats[r["level"]] = np.array(r[1:], dtype=np.int64)
        rows = done.where("stats is null").select(*BLOBS.names)
        if before is not None:
            drop(before)
        release(spark)
    drop(done)
    none = np.zeros(6, np.int64)
    low = stats.get(1, none)
    return Model(uri, order, bits, {k: discounts(*(int(x) for x in stats.get(k, none)[:4])) for k in range(1, order + 1)},
                 float(low[5]), (int(low[0]), int(low[1]), int(low[4] - low[0] - low[1])),
                 int(stats.get(RAW, none)[4]), int(stats.get(RAW, none)[5]))


# ---------------------------------------------------------------- scoring
def _lookup(m: Model, level: int, kind: str, keys: np.ndarray, values: list[str]) -> list[np.ndarray]:
    """Values of sorted ``keys`` (0 where absent) from the level's shards."""
    out = [np.zeros(len(keys), np.float64) for _ in values]
    shard = (keys >> np.uint64(64 - m.bits)).astype(np.int64) if m.bits else np.zeros(len(keys), np.int64)
    cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]).tolist() + [len(shard)] if len(keys) else [0]
    for a, b in zip(cut[:-1], cut[1:]):
        name = f"{level}-{shard[a]}"
        have = _mapped(m.uri, f"{name}-{kind}")
        if not len(have):
            continue
        at = np.minimum(np.searchsorted(have, keys[a:b]), len(have) - 1)
        hit = np.flatnonzero(have[at] == keys[a:b])
        for o, v in zip(out, values):
            o[a + hit] = _mapped(m.uri, f"{name}-{v}")[at[hit]]
    return out


def _find(m: Model, level: int, kind: str, keys: np.ndarray, values: list[str]) -> list[np.ndarray]:
    """As ``_lookup`` for keys in any order; each distinct key is looked up once."""
    uniq, back = places(keys)
    return [v[back] for v in _lookup(m, level, kind, uniq, values)]


class Text:
    """Tokens of some documents and the n-grams that end at each."""

    def __init__(self, m: Model, tok: np.ndarray, ptr: np.ndarray):
        self.m, self.tok, self.ptr = m, tok, ptr
        self.cols = ngrams(tok, ptr, m.order)

    @functools.cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words and the begin mark, and the places of every token and of the one before it."""
        words, place = places(np.append(self.tok, BEGIN))
        before = np.append(place[-1:], place[:-2])
        before[self.ptr[:-1]] = place[-1]
        return words, place[:-1], before

    def wanted(self, level: int) -> list[tuple[str, np.ndarray, list[str], np.ndarray | None]]:
        """What a level looks up: (kind of file, keys, names of the values, each token's place in the keys or None)."""
        bits, stats = self.m.bits, ["total", "n1", "n2", "n3"]
        if level <= 1:
            words, place, _ = self.words
            return [("key", gram_key([words], context_key([words]), bits), ["count"], place)]
        part = self.cols[-level:]
        ctx = context_key(part)
        grams = ("key", gram_key(part, ctx, bits), ["count"], None)
        if level == 2:
            words, _, before = self.words
            return [("context", context_key([words, words]), stats, before), grams]
        return [("context", ctx, stats, None), grams]

    def found(self, level: int, find) -> list[list[np.ndarray]]:
        """The values of every token."""
        out = []
        for kind, keys, values, place in self.wanted(level):
            got = find(level, kind, keys, values)
            out.append(got if place is None else [x[place] for x in got])
        return out


def probabilities(m: Model, tok: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Model probability of every token after its predecessors in the document."""
    return _probabilities(Text(m, tok, ptr), functools.partial(_find, m))


def _probabilities(text: Text, find) -> np.ndarray:
    """``find(level, kind, keys, values)`` gives the stored values of keys."""
    m = text.m
    d = m.discounts[1]
    uniform = 1.0 / (m.vocabulary + 1)
    if m.bigrams:
        ((c,),) = text.found(1, find)
        spare = sum(x * n for x, n in zip(d, m.follow)) / m.bigrams
        p = (c - _taken(c, d)) / m.bigrams + spare * uniform
    else:
        p = np.full(len(text.tok), uniform)
    for level in range(2, m.order + 1):
        d = m.discounts[level]
        (total, n1, n2, n3), (c,) = text.found(level, find)
        seen = np.maximum(total, 1)
        high = (c - _taken(c, d)) / seen
        back = np.where(total > 0, (d[0] * n1 + d[1] * n2 + d[2] * n3) / seen, 1.0)
        p = high + back * p
    return p


def _taken(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """The discount of each count."""
    return np.array([0.0, *d])[np.minimum(c, 3).astype(np.int8)]


def score_block(m: Model, raw: np.ndarray, offs: np.ndarray, find=None):
    """(tokens, known tokens, base log10, model log10) of every document of a block."""
    find = find or functools.partial(_find, m)
    text = Text(m, *_tokens(raw, offs))
    ((c,),) = text.found(RAW, find)
    base = np.log10((c + 0.1) / (m.train_tokens + 0.1 * (m.vocabulary + 1)))
    model = np.log10(_probabilities(text, find))
    at = text.ptr[:-1]
    return (np.diff(text.ptr), np.add.reduceat((c > 0).astype(np.int64), at), np.add.reduceat(base, at),
            np.add.reduceat(model, at))


def _tokens(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``tokens`` of many documents, a cache-sized block at a time."""
    parts = [tokens(raw, offs[lo:hi + 1]) for lo, hi in blocks(offs, TOKEN_BYTES)]
    sizes = np.concatenate([[0], *(np.diff(ptr) for _, ptr in parts)])
    return np.concatenate([tok for tok, _ in parts]), np.cumsum(sizes)


# ---------------------------------------------------------------- scoring a table: batches ask, shards answer
ASKED = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("shard", T.IntegerType()),
                      T.StructField("batch", T.StringType()), T.StructField("keys", T.ArrayType(T.BinaryType()))])
ANSWERS = T.StructType([*ASKED.fields[:3], T.StructField("values", T.ArrayType(T.BinaryType()))])


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys as byte planes of their differences: the high planes are zeros, which a shuffle compresses."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return gaps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, len(planes) // 8).T).view(np.uint64).ravel(), dtype=np.uint64)


def _cut(m: Model, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shards, their bounds) of sorted keys."""
    if not m.bits:
        return np.zeros(1, np.int64), np.array([0, len(keys)])
    shards = np.arange(1 << m.bits)
    return shards, np.append(np.searchsorted(keys, shards.astype(np.uint64) << np.uint64(64 - m.bits)), len(keys))


def _stored(uri: str, target: int):
    """mapInArrow over doc_id, text: files of about ``target`` bytes of whole documents, and a row with each one's name."""
    def run(batches):
        held, size = [], 0

        def flush():
            data, name = io.BytesIO(), uuid.uuid4().hex
            table = pa.Table.from_batches(held).combine_chunks()
            with pa.ipc.new_stream(data, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            put(uri, name, data.getbuffer())
            return pa.RecordBatch.from_arrays([pa.array([name])], names=["batch"])

        for rb in batches:
            _, offs = utf8(rb.column("text"))
            for lo, hi in blocks(offs, max(1, target // 8)):
                held.append(rb.slice(lo, hi - lo))
                size += offs[hi] - offs[lo]
                if size >= target:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
    return run


def _batch(uri: str, name: str) -> pa.Table:
    store, path = file_system(uri)
    with store.open_input_stream(f"{path}/{name}") as f:
        return pa.ipc.open_stream(f.read()).read_all()


def _asked(uri: str, m: Model, levels: list[int]):
    """mapInArrow over batch names: for every level and shard the sorted distinct keys that the batch needs."""
    def run(batches):
        for name in (x for rb in batches for x in rb.column("batch").to_pylist()):
            text = Text(m, *_tokens(*utf8(_batch(uri, name).column("text"))))
            for level in levels:
                parts = []
                for _, keys, *_ in text.wanted(level):
                    keys, _ = distinct(keys)
                    shards, cut = _cut(m, keys)
                    parts.append([pack(keys[a:b]) for a, b in zip(cut[:-1], cut[1:])])
                rows = [(int(s), list(k)) for s, *k in zip(shards, *parts) if any(k)]
                for at in range(0, len(rows), 64):
                    shard, keys = zip(*rows[at:at + 64])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([level] * len(shard), pa.int32()), pa.array(shard, pa.int32()),
                         pa.array([name] * len(shard)), pa.array(keys, pa.list_(pa.binary()))], names=ASKED.names)
    return run


def _answered(m: Model):
    """applyInArrow for a (level, shard): the values of all batches' keys, each array as small as its numbers allow."""
    def run(key, table):
        level = key[0].as_py()
        kinds = [(w[0], w[2]) for w in Text(m, np.zeros(0, np.uint64), np.zeros(1, np.int64)).wanted(level)]
        asked = [row.values for row in table.column("keys")]
        out = [[] for _ in asked]
        sizes = np.array([sum(len(x.as_buffer()) for x in row) // 8 for row in asked])
        for part in np.split(np.arange(len(asked)), np.flatnonzero(np.diff(np.cumsum(sizes) // ANSWER_KEYS)) + 1):
            for i, (kind, values) in enumerate(kinds):
                keys = [unpack(asked[r][i].as_buffer()) for r in part]
                cut = np.cumsum([0, *map(len, keys)])
                keys = np.concatenate(keys)
                order = np.argsort(keys)             # one walk over the file for all these batches
                for x in _lookup(m, level, kind, keys[order], values):
                    got = np.empty_like(x)
                    got[order] = x
                    for r, a, b in zip(part, cut[:-1], cut[1:]):
                        here = got[a:b]
                        out[r].append(here.astype(np.min_scalar_type(int(here.max()) if b > a else 0)).tobytes())
        return table.select(ASKED.names[:3]).append_column("values", pa.array(out, pa.list_(pa.binary())))
    return run


def _given(m: Model, table: pa.Table):
    """``find`` from the answers to one batch."""
    rows = sorted(zip(table.column("level").to_pylist(), table.column("shard").to_pylist(), table.column("values")),
                  key=lambda r: r[:2])
    answers: dict[int, dict] = {}
    for level, shard, values in rows:
        answers.setdefault(level, {})[shard] = values.values

    def find(level, kind, keys, values):
        uniq, back = places(keys)
        out = [np.zeros(len(uniq), np.float64) for _ in values]
        first = 4 if level > 1 and kind == "key" else 0
        for shard, a, b in zip(*(lambda s, c: (s, c[:-1], c[1:]))(*_cut(m, uniq))):
            if b > a:
                for o, data in zip(out, answers[level][shard][first:first + len(values)]):
                    data = data.as_buffer()
                    o[a:b] = np.frombuffer(data, f"u{data.size // (b - a)}")
        return [o[back] for o in out]
    return find


def _combined(uri: str, m: Model, names: list[str]):
    """applyInArrow for a batch: the scores of its documents."""
    def run(key, table):
        docs = _batch(uri, key[0].as_py())
        got = score_block(m, *utf8(docs.column("text")), _given(m, table))
        return pa.Table.from_arrays([docs.column("doc_id"), *(pa.array(g) for g in got)], names=names)
    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score for every row; ``model`` is a few numbers and a path."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()),
                           T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()),
                           T.StructField("score", T.DoubleType())])
    spark = docs.sparkSession
    uri = shared_folder(spark, "lm-texts")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    batches = written(texts.mapInArrow(_stored(uri, SCORE_BYTES), "batch string"), "batches")
    batches = batches.repartition(max(1, batches.count() // 2))      # names only; two batches a task
    answers = None
    for levels in [*([x] for x in range(model.order, 2, -1)), [RAW, *range(1, min(model.order, 2) + 1)]]:
        asked = batches.mapInArrow(_asked(uri, model, levels), ASKED)
        got = written(asked.groupBy("level", "shard").applyInArrow(_answered(model), ANSWERS), "answers", "zstd")
        answers = got if answers is None else answers.unionByName(got)
        release(spark)
    return answers.groupBy("batch").applyInArrow(_combined(uri, model, schema.names), schema)


def op1_lm_scoring(docs: DataFrame, order: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row."""
    held = (id_crc() % 10) == 0
    model = fit(docs.where(~held), order)
    return score(docs, model).select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
