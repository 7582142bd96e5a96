"""Best-fit packing of documents into fixed-length sequences by bin completion.

Only the lengths decide a packing, and a length is at most the capacity, so
the problem that is solved on the driver is the histogram of piece lengths:
at most ``capacity`` numbers, whatever the corpus.  Best fit decreasing gives
the first incumbent; branch and bound then fills one bin at a time around the
largest remaining piece, tries only undominated fillings in order of their
waste, and cuts branches whose waste cannot beat the incumbent.  The plan says
which ranks of each length go to which sequences; pieces are ranked with
sums of counts per task, never in one place.

Edge cases: a null or empty text is the end id alone; repeated rows are
packed once each; a null id is carried through; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .store import written
from .text import blocks, utf8

CAPACITY = 2048
END_ID = 0
#: Steps of the search after which the incumbent stands (it is then at most that far from the bound).
MAX_NODES = 3_000


# ---------------------------------------------------------------- planning on the histogram
def best_fit(hist: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing: (piece lengths of a bin, number of such bins)."""
    open_bins: dict[int, list[list]] = {}          # free space -> [[contents, bins]]
    for size in sorted(hist, reverse=True):
        left = hist[size]
        for free in sorted(f for f in open_bins if f >= size):
            fits, classes = free // size, open_bins.pop(free)
            while classes and left:
                contents, bins = classes.pop()
                full = min(bins, left // fits)
                if full:
                    open_bins.setdefault(free - fits * size, []).append([contents + (size,) * fits, full])
                    left -= full * fits
                if full < bins and left:           # fewer pieces left than one more bin holds
                    open_bins.setdefault(free - left * size, []).append([contents + (size,) * left, 1])
                    full, left = full + 1, 0
                if full < bins:
                    classes.append([contents, bins - full])
            if classes:
                open_bins.setdefault(free, []).extend(classes)
            if not left:
                break
        per = capacity // size
        if left >= per:
            open_bins.setdefault(capacity - per * size, []).append([(size,) * per, left // per])
            left %= per
        if left:
            open_bins.setdefault(capacity - left * size, []).append([(size,) * left, 1])
    merged = Counter()
    for classes in open_bins.values():
        for contents, bins in classes:
            merged[contents] += bins
    return sorted(merged.items(), reverse=True)


def lower_bound(hist: dict[int, int], capacity: int) -> int:
    """The larger of the volume bound and, for every t, the bound that keeps pieces over capacity - t apart."""
    best = -(-sum(s * c for s, c in hist.items()) // capacity)
    count = np.zeros(capacity + 2, dtype=object)
    for s, c in hist.items():
        count[s] += c
    n_upto = np.cumsum(count)                       # pieces, and their total length, of at most each length
    len_upto = np.cumsum(count * np.arange(capacity + 2))
    half = capacity // 2
    for t in (s for s in hist if s <= half):
        big = n_upto[capacity] - n_upto[capacity - t]
        mid = n_upto[capacity - t] - n_upto[half]
        room = mid * capacity - (len_upto[capacity - t] - len_upto[half])
        small = len_upto[half] - len_upto[t - 1]
        best = max(best, big + mid + max(0, -(-(small - room) // capacity)))
    return best


def fillings(sizes: list[int], left: list[int], room: int, waste: int, limit: int) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room``, least waste first, wasting at most ``waste``.

    A filling is dominated if one remaining piece could take the place of one
    or two of its pieces, is larger than them, and still fits (or is as large
    as two of them): a bin with that piece instead is never worse.
    """
    found: dict[tuple[int, ...], int] = {}
    have = [-s for s in sizes]                      # ascending, for bisect
    used: Counter = Counter()
    steps = 0

    def grow(i: int, free: int, taken: tuple[int, ...]):
        nonlocal steps
        steps += 1
        leaf = True
        for j in range(max(i, bisect_left(have, -free)), len(sizes)):
            size = sizes[j]
            if left[j] <= used[size]:
                continue
            leaf = False
            used[size] += 1
            grow(j, free - size, taken + (size,))
            used[size] -= 1
            if steps > 100 * limit or len(found) >= 4 * limit:
                return
        if leaf and free <= waste:
            found[taken] = free

    grow(0, room, ())
    kept = []
    for taken, free in sorted(found.items(), key=lambda f: (f[1], [-x for x in f[0]])):
        own = Counter(taken)

        def better(lo: int, hi: int) -> bool:
            """Whether a piece that is not in the filling has a length in [lo, hi]."""
            return any(left[j] > own[sizes[j]] for j in range(bisect_left(have, -hi), bisect_right(have, -lo)))
        pairs = {a + b for n, a in enumerate(taken) for b in taken[n + 1:]}
        if not (any(better(u + 1, u + free) for u in own) or any(better(u, u + free) for u in pairs)):
            kept.append(taken)
        if len(kept) >= limit:
            break
    return kept


def plan(hist: dict[int, int], capacity: int = CAPACITY, max_nodes: int = MAX_NODES) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (piece lengths, count); the counts of every length add up to the histogram's."""
    hist = {s: c for s, c in hist.items() if c > 0}
    best = best_fit(hist, capacity)
    bins = sum(c for _, c in best)
    floor = lower_bound(hist, capacity)
    sizes = sorted(hist, reverse=True)
    left = [hist[s] for s in sizes]
    total = sum(s * c for s, c in hist.items())
    at = {s: i for i, s in enumerate(sizes)}
    nodes = 0
    # depth first over (filling, how often it is repeated); each level keeps an iterator of its choices
    stack: list = []
    made: list[tuple[tuple[int, ...], int]] = []
    used = waste = 0

    def choices():
        head = next((i for i, c in enumerate(left) if c), None)
        if head is None:
            return None
        spare = (bins - 1) * capacity - total - waste
        left[head] -= 1
        opts = fillings(sizes, left, capacity - sizes[head], spare, 12)
        left[head] += 1
        out = []
        for taken in opts:
            need = Counter((sizes[head], *taken))
            times = min(left[at[s]] // k for s, k in need.items())
            loss = capacity - sizes[head] - sum(taken)
            if loss:
                times = min(times, max(1, spare // loss))
            out += [(need, loss, t) for t in dict.fromkeys((times, 1))]
        return iter(out)

    it = choices() if bins > floor else None
    while it is not None and nodes < max_nodes and bins > floor:
        step = next(it, None)
        if step is None:
            if not stack:
                break
            it, (need, loss, times) = stack.pop()
            made.pop()
            used, waste = used - times, waste - loss * times
            for s, k in need.items():
                left[at[s]] += k * times
            continue
        need, loss, times = step
        if waste + loss * times > (bins - 1) * capacity - total or used + times >= bins:
            continue
        nodes += 1
        for s, k in need.items():
            left[at[s]] -= k * times
        used, waste = used + times, waste + loss * times
        made.append((tuple(sorted(need.elements(), reverse=True)), times))
        stack.append((it, step))
        it = choices()
        if it is None:                              # everything is placed in fewer bins: the new incumbent
            best, bins = list(made), used
            it = iter(())
    return best


def layout(bins: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, first sequence, offset, ranks per sequence step) in order of rank."""
    out: dict[int, list] = {}
    rank: Counter = Counter()
    first = 0
    for contents, count in bins:
        offset = 0
        for size in contents:
            out.setdefault(size, []).append((rank[size], first, offset))
            rank[size] += count
            offset += size
        first += count
    return {s: np.array(v, dtype=np.int64) for s, v in out.items()}


# ---------------------------------------------------------------- Spark side
PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()),
                       T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                       T.StructField("ids_crc32", T.LongType()), T.StructField("task", T.IntegerType()),
                       T.StructField("nth", T.LongType())])


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole capacities, after a first piece with the rest."""
    rest = n % capacity
    starts = ([0] if rest else []) + list(range(rest, n, capacity))
    return [(s, e - s) for s, e in zip(starts, starts[1:] + [n])]


def token_ids(rb, column: str, coder: bpe.Bpe):
    """(row, ids with the end id) for every row of a batch."""
    raw, offs = utf8(rb.column(column))
    for lo, hi in blocks(offs):
        o = offs[lo:hi + 1]
        ids, ptr = coder.encode(raw[o[0]:o[-1]].tobytes(), o - o[0])
        ids = np.insert(ids.astype("<u4"), ptr[1:], END_ID)
        ptr = ptr + np.arange(len(ptr))
        for i in range(hi - lo):
            yield lo + i, ids[ptr[i]:ptr[i + 1]]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document, with a running number per (task, length) for the ranking."""
    def run(batches):
        coder, task, seen = bpe.load(vocabulary), TaskContext.get().partitionId(), Counter()
        for rb in batches:
            ids_of, rows = rb.column("doc_id").to_pylist(), []
            for i, ids in token_ids(rb, "text", coder):
                for k, (start, size) in enumerate(cuts(len(ids), capacity)):
                    crc = zlib.crc32(ids[start:start + size].tobytes())
                    rows.append((ids_of[i], k, start, size, crc, task, seen[size]))
                    seen[size] += 1
            cols = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(),
                                                       pa.int32(), pa.int64()))], names=PIECES.names)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, PIECES)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, max_nodes: int = MAX_NODES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    spark = docs.sparkSession
    cut = written(pieces(docs, vocabulary, capacity), "pieces")
    counts = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    base = counts.select("task", "length", (F.sum("n").over(
        W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    hist = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    places = spark.sparkContext.broadcast(layout(plan(hist, capacity, max_nodes)))                 # bounded like it

    def place(batches):
        table = places.value
        for rb in batches:
            size, rank = rb.column("length").to_numpy(), rb.column("rank").to_numpy()
            seq, off = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for s in np.unique(size):
                here = size == s
                rows = table[int(s)]
                at = np.searchsorted(rows[:, 0], rank[here], side="right") - 1
                seq[here] = rows[at, 1] + rank[here] - rows[at, 0]
                off[here] = rows[at, 2]
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in names), pa.array(seq), pa.array(off)],
                                             names=[*names, "sequence_id", "offset"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = cut.join(base, ["task", "length"]).select(*names, (F.col("base") + F.col("nth")).alias("rank"))
    schema = T.StructType([*[PIECES[n] for n in names], T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)


def sequences(docs: DataFrame, packed: DataFrame, vocabulary: str) -> DataFrame:
    """(sequence_id, ids): the token ids of every packed sequence, for documents with distinct ids."""
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("all_ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        coder = bpe.load(vocabulary)
        for rb in batches:
            ids_of = rb.column("doc_id").to_pylist()
            got = [(ids_of[i], ids.astype(np.int32)) for i, ids in token_ids(rb, "text", coder)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()),
                                              pa.array([g[1] for g in got], pa.list_(pa.int32()))], names=out.names)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, out)
    part = packed.join(ids, "doc_id").select("sequence_id", "offset", F.slice(
        "all_ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("ids"))
    return (part.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
            .select("sequence_id", F.flatten(F.col("p.ids")).alias("ids")))
