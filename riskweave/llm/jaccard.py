"""Exact n-gram Jaccard join by token-combination prefixes.

A document's set holds the hashes of its word n-grams (64 bits).  The set's
elements are ordered from rare to frequent; frequency comes from a table of
counts over all documents (hashed to a fixed number of cells, so elements of
one cell share a rank; any order that all documents share gives exact
results).  Elements whose cell holds many times the mean are frequent: they
are split into classes by hash, as many as the set's size band asks for, and a
class is indexed by combinations of two elements; rare ones are indexed alone.

Prefix rule: with at most e = n - ceil(t * n) elements of a set missing in a
partner, a prefix in which sum over classes of max(0, p_k - (k - 1)) exceeds
e cannot be without a shared k-combination of some class k, so every linked
pair meets in a bucket.  Prefixes grow until the rule holds.  Of the smaller set of
a pair a partner lacks fewer elements (e = n - ceil(2 * t / (1 + t) * n)), so
its prefix is shorter: only these keys make a set a lead of the bucket, and sets
that share a common passage without being near any other are compared with
leads alone.  Keys carry the size band of the set, those of the shorter prefix
the next one too, as linked sets have similar sizes.  Sets of a few elements
use single ones only.  Every pair that meets is settled by its exact
intersection (see ``graph.linked``).

Edge cases: null or empty text or no word: empty set, component is the row's
own id; a null id takes no part and has a null component; rows that share an
id are one document and connected; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import linked, shared_buckets
from .store import small, written
from .text import Words, blocks, combine, mix, ragged, utf8, windows


@dataclass(frozen=True)
class Params:
    n: int = 3                 # words in an n-gram
    num: int = 90              # Jaccard threshold num / den
    den: int = 100
    cell_bits: int = 17        # cells of the frequency table: 2**cell_bits, whatever the corpus
    per_class: int = 16        # a class of frequent elements for so many elements of a size band's smallest set
    pairs_from: int = 8        # size bands whose smallest set has so many elements use pairs
    frequent: float = 8.0      # an element is frequent from so many times the mean cell on
    band: int = 4              # a size band spans a factor of (den / num)**band
    parts: int = 64            # counts by part of the element space that bound a pair's intersection


def shingle_sets(raw: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements sorted within each document, document pointers); shorter texts are one element."""
    w = Words(raw, offs)
    h = w.hashes()
    at, doc = windows(w, n)
    elem = combine([h[at + i] for i in range(n)], salt=n)
    count = w.counts()
    for m in range(1, n):                                   # a text of m < n words is one sequence
        short = np.flatnonzero(count == m)
        first = w.doc_ptr[short]
        elem = np.concatenate([elem, combine([h[first + i] for i in range(m)], salt=m)])
        doc = np.concatenate([doc, short])
    order = np.lexsort((elem, doc))
    elem, doc = elem[order], doc[order]
    if len(elem):
        new = np.ones(len(elem), bool)
        new[1:] = (elem[1:] != elem[:-1]) | (doc[1:] != doc[:-1])
        elem, doc = elem[new], doc[new]
    return elem, np.searchsorted(doc, np.arange(w.n_docs + 1))


def _cells(elem: np.ndarray, bits: int) -> np.ndarray:
    return (elem >> np.uint64(64 - bits)).astype(np.int64)


def frequencies(docs: DataFrame, p: Params) -> np.ndarray:
    """Occurrences (once per document) of all documents' elements by cell; bounded by 2**cell_bits."""
    def run(batches):
        total = np.zeros(1 << p.cell_bits, np.int64)
        for rb in batches:
            raw, offs = utf8(rb.column("text"))
            for lo, hi in blocks(offs):
                elem, _ = shingle_sets(raw, offs[lo:hi + 1], p.n)
                total += np.bincount(_cells(elem, p.cell_bits), minlength=len(total))
        some = np.flatnonzero(total)
        for at in range(0, len(some), 1 << 16):
            s = some[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(total[s])], names=["cell", "n"])
    got = docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << p.cell_bits, np.int64)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out


def classes(band: int, p: Params) -> int:
    """Classes of the frequent elements in sets of a size band; 0: its sets are too small for pairs."""
    smallest = (p.den / p.num) ** (p.band * band)
    return max(1, int(smallest / p.per_class)) if smallest >= p.pairs_from else 0


def prefix_keys(e: np.ndarray, rare: int, miss: int, groups: int) -> np.ndarray:
    """Keys of the prefix of a set (elements in order, ``rare`` of them rare) of which a partner lacks up to ``miss``."""
    if not groups:
        return mix(e[:miss + 1])
    used = min(rare, miss + 1)
    keys = [mix(e[:used])]
    if used <= miss:
        tail = e[rare:]
        group = (mix(tail) % np.uint64(groups)).astype(np.int64)
        seen = np.zeros(len(tail), np.int64)                # how many of its class come before each element
        by = np.argsort(group, kind="stable")
        g = group[by]
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        seen[by] = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
        stop = int(np.searchsorted(np.cumsum(seen > 0), miss + 1 - used)) + 1
        tail, group = tail[:stop], group[:stop]
        by = np.argsort(group, kind="stable")
        for part in np.split(tail[by], np.flatnonzero(np.diff(group[by])) + 1):
            if len(part) > 1:
                i, j = np.triu_indices(len(part), 1)
                keys.append(combine([np.minimum(part[i], part[j]), np.maximum(part[i], part[j])], salt=2))
    return np.unique(np.concatenate(keys))


def signatures(elem: np.ndarray, freq: np.ndarray, mean: float, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of one set (elements sorted by hash): as the smaller set of a pair, and the other ones as the larger."""
    n = len(elem)
    f = freq[_cells(elem, p.cell_bits)]
    e = elem[np.lexsort((elem, f))]
    rare = int((f < p.frequent * mean).sum())               # frequencies ascend: rare elements come first
    below = n - -(-2 * n * p.num // (p.num + p.den))        # elements that a partner of this size or more may lack
    above = n - -(-n * p.num // p.den)                      # and one of this size or less
    # a larger partner has at most den / num times the size: it is in the same size band, or in the next one
    # for a set whose own size is that close to its end
    step = math.log(n) / math.log(p.den / p.num * (1 + 1e-9))
    own, last = int(step / p.band), int((step + 1) / p.band)
    as_smaller = [combine([prefix_keys(e, rare, below, classes(k, p))], salt=k) for k in range(own, last + 1)]
    as_larger = combine([prefix_keys(e, rare, above, classes(own, p))], salt=own)
    return np.concatenate(as_smaller), np.setdiff1d(as_larger, as_smaller[0])


def part_counts(elem: np.ndarray, ptr: np.ndarray, parts: int) -> list[bytes]:
    """How many elements of each set lie in each part of the element space (32-bit counts)."""
    doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    part = (mix(elem) % np.uint64(parts)).astype(np.int64)
    got = np.bincount(doc * parts + part, minlength=(len(ptr) - 1) * parts).astype(np.uint32)
    return [row.tobytes() for row in got.reshape(-1, parts)]


def profiles(docs: DataFrame, freq, p: Params) -> DataFrame:
    """doc_id, n_shingles, two fingerprints of the set, counts by part, index keys (``signatures``)."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()),
                           T.StructField("f1", T.LongType()), T.StructField("f2", T.LongType()),
                           T.StructField("parts", T.BinaryType()),
                           T.StructField("less", T.ArrayType(T.LongType())), T.StructField("more", T.ArrayType(T.LongType()))])

    def lists(rows):
        ends = np.concatenate([[0], np.cumsum([len(s) for s in rows])])
        return ragged(np.concatenate([np.zeros(0, np.uint64), *rows]).view(np.int64), ends, pa.int64())

    def run(batches):
        table = freq.value
        mean = table.sum() / len(table)
        for rb in batches:
            raw, offs = utf8(rb.column("text"))
            size, f1, f2, parts, keys = [], [], [], [], []
            none = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            for lo, hi in blocks(offs):
                elem, ptr = shingle_sets(raw, offs[lo:hi + 1], p.n)
                one = np.concatenate([[0], np.cumsum(mix(elem ^ np.uint64(0x1111)))]).astype(np.uint64)
                two = np.concatenate([[0], np.cumsum(mix(elem ^ np.uint64(0x2222)))]).astype(np.uint64)
                size.append(np.diff(ptr))
                f1.append(one[ptr[1:]] - one[ptr[:-1]])
                f2.append(two[ptr[1:]] - two[ptr[:-1]])
                parts += part_counts(elem, ptr, p.parts)
                keys += [signatures(elem[a:b], table, mean, p) if b > a else none
                         for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist())]
            num = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (size, f1, f2)]
            yield pa.RecordBatch.from_arrays(
                [rb.column("doc_id"), *(pa.array(x.astype(np.uint64).view(np.int64)) for x in num),
                 pa.array(parts, pa.binary()), lists([k[0] for k in keys]), lists([k[1] for k in keys])], names=schema.names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, schema)


def meets(common, u, v, p: Params):
    return p.den * common >= p.num * (u + v - common)


def verifier(docs: DataFrame, counts: DataFrame, p: Params):
    """Keeps the pairs (a, b) whose sets meet the threshold; counts: (node, parts).

    An intersection is at most the sum over parts of the smaller count.  Only
    pairs that this bound lets through have the sets of their texts built and compared.
    """
    def bounded(batches):
        for rb in batches:
            a, b = (np.frombuffer(b"".join(rb.column(c).to_pylist()), np.uint32).reshape(-1, p.parts).astype(np.int64)
                    for c in ("pa", "pb"))
            ok = pa.array(meets(np.minimum(a, b).sum(axis=1), a.sum(axis=1), b.sum(axis=1), p))
            yield pa.RecordBatch.from_arrays([rb.column("a").filter(ok), rb.column("b").filter(ok)], names=["a", "b"])

    def sets(col):
        raw, offs = utf8(col)
        for lo, hi in blocks(offs):
            elem, ptr = shingle_sets(raw, offs[lo:hi + 1], p.n)
            for i, j in zip(ptr[:-1].tolist(), ptr[1:].tolist()):
                yield elem[i:j]

    def exact(batches):
        for rb in batches:
            keep = []
            for u, v in zip(sets(rb.column("ta")), sets(rb.column("tb"))):
                common = 0
                if len(u) and len(v):
                    at = np.minimum(np.searchsorted(v, u), len(v) - 1)
                    common = int((v[at] == u).sum())
                keep.append(common > 0 and bool(meets(common, len(u), len(v), p)))
            ok = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([rb.column("a").filter(ok), rb.column("b").filter(ok)], names=["a", "b"])

    def with_both(pairs: DataFrame, table: DataFrame, col: str) -> DataFrame:
        for c in "ab":
            pairs = pairs.join(table.select(F.col("node").alias(c), F.col(col).alias(col[0] + c)), c)
        return pairs

    def verify(pairs: DataFrame) -> DataFrame:
        near = with_both(pairs, counts, "parts").select("a", "b", "pa", "pb").mapInArrow(bounded, "a long, b long")
        near = written(near.distinct(), "near")
        ids = small(written(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ids"))
        # texts travel instead of sets: they take less room in a shuffle
        given = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
        texts = given.join(ids, "node", "left_semi")
        return with_both(near, texts, "text").select("a", "b", "ta", "tb").mapInArrow(exact, "a long, b long").distinct()
    return verify


def join(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    p = params or Params()
    freq = docs.sparkSession.sparkContext.broadcast(frequencies(docs, p))
    prof = written(profiles(docs, freq, p), "profiles")
    full = prof.where("doc_id is not null and n_shingles > 0")
    reps = written(full.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep")), "reps")
    named = full.select("doc_id", "f1", "f2", "n_shingles", "parts").join(reps, ["f1", "f2", "n_shingles"])
    counts = written(named.where("doc_id = rep").select(F.col("rep").alias("node"), "parts").distinct(), "counts")
    # copies stand for one another: only the first row's keys are dealt
    copies = small(written(named.where("doc_id <> rep").select("doc_id", "f1", "f2", "n_shingles").distinct(), "copies"))
    firsts = full.join(copies, ["doc_id", "f1", "f2", "n_shingles"], "left_anti")
    shared = shared_buckets(firsts.select(F.explode("less").alias("sig"), F.col("doc_id").alias("node"), F.lit(True).alias("lead"))
                            .union(firsts.select(F.explode("more"), "doc_id", F.lit(False))))
    # rows of one id with different texts are one document: connect their sets through it
    twice = full.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    same_id = (full.join(twice, "doc_id").join(reps, ["f1", "f2", "n_shingles"])
               .select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b"))
    label = linked(shared, verifier(docs, counts, p), same_id)
    out = prof.join(reps, ["f1", "f2", "n_shingles"], "left").join(
        label.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep"))
                      .otherwise(F.col("doc_id")).alias("component_id"))


def one_per_component(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """The documents without those that are linked to one with a smaller id (rows with a null id stay)."""
    got = join(docs, params)
    gone = got.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
