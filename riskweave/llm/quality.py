"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its words and character
n-grams, found by hashing into a fixed number of rows; a softmax layer turns
the average into class probabilities.  Training is numpy stochastic gradient
descent on a sample of labelled rows that is bounded by ``max_rows``; scoring
covers the whole text of every document.

Edge cases: a null or empty text has no features and scores by the bias
alone; a null id is carried through; repeated rows are each scored; a label
that is null is no label; a document with several labels counts by their
mean (0.5 and over: 1); with no labelled row at all every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import id_crc
from .text import CODES, Words, blocks, utf8


@dataclass
class Params:
    buckets: int = 1 << 16      # rows of the hashed embedding table
    dim: int = 8
    ngrams: tuple[int, ...] = (3, 5)
    max_rows: int = 4000        # bound of the labelled sample
    epochs: int = 10
    batch: int = 32
    rate: float = 8.0
    seed: int = 7


@dataclass
class Model:
    params: Params
    embed: np.ndarray           # buckets x dim
    out: np.ndarray             # classes x dim
    bias: np.ndarray            # classes
    trained_on: int = 0
    table: np.ndarray = field(init=False)

    def __post_init__(self):
        # the average is linear, so the output layer can be applied to the rows beforehand
        self.table = (self.embed @ self.out.T).astype(np.float32)


MARKER = 0x52455045  # the hashed "word" that stands for a repeated word


def _bucket(h: np.ndarray, p: Params) -> np.ndarray:
    shift = np.uint64(64 - (p.buckets.bit_length() - 1))
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int32)


def word_features(w: Words, p: Params) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, document pointers) of the words (case kept) and of a marker for words that repeat the one before."""
    h = w.hashes()
    same = np.zeros(len(h) + 1, dtype=bool)
    same[1:-1] = h[1:] == h[:-1]
    same[w.doc_ptr] = False
    again = np.flatnonzero(same)
    marker = _bucket(np.full(len(again), MARKER, np.uint64), p)
    return [(_bucket(h, p), w.doc_ptr), (marker, np.searchsorted(again, w.doc_ptr))]


def gram_features(b: np.ndarray, bounds: np.ndarray, n: int, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-byte window at every byte, and the positions whose window leaves its document."""
    code = CODES[b]
    h = np.zeros(len(b), dtype=np.uint64)
    for i in range(n):
        h *= np.uint64(0x100000001B3)
        h[:max(len(b) - i, 0)] += code[i:]
    ends = bounds[1:]
    over = (ends[:, None] - np.arange(1, n)).ravel()
    over = over[over >= np.repeat(bounds[:-1], n - 1)]
    return _bucket(h + np.uint64(n), p), over


def _sample_features(p: Params):
    """mapInArrow: (label, text) -> (label, bucket ids, shares of the features), one row per document."""
    kind = np.min_scalar_type(p.buckets - 1)

    def run(batches):
        for rb in batches:
            raw, offs = utf8(rb.column("text"))
            labels = rb.column("label").to_pylist()
            ids, cnt, rows = [], [], []
            for lo, hi in blocks(offs):
                w = Words(raw, offs[lo:hi + 1], lower=False)
                n_docs, bounds = w.n_docs, offs[lo:hi + 1] - offs[lo]
                key = [np.repeat(np.arange(n_docs), np.diff(ptr)) * p.buckets + f for f, ptr in word_features(w, p)]
                doc = np.repeat(np.arange(n_docs), np.diff(bounds))
                for n in p.ngrams:
                    f, over = gram_features(w.bytes, bounds, n, p)
                    key.append(np.delete(doc * p.buckets + f, over))
                key = np.concatenate(key)
                u, c = np.unique(key, return_counts=True)
                ptr = np.searchsorted(u, np.arange(n_docs + 1) * p.buckets)
                f = (u % p.buckets).astype(kind)
                for i in range(n_docs):
                    s = slice(ptr[i], ptr[i + 1])
                    rows.append(labels[lo + i])
                    ids.append(f[s].tobytes())
                    cnt.append((c[s] / max(c[s].sum(), 1)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int32()), pa.array(ids, pa.binary()), pa.array(cnt, pa.binary())],
                names=["label", "ids", "cnt"])
    return run


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], p: Params) -> Model:
    """Numpy SGD with a linearly falling rate over (label, bucket ids, shares) rows."""
    rng = np.random.default_rng(p.seed)
    embed = ((rng.random((p.buckets, p.dim)) - 0.5) * (2.0 / p.dim)).astype(np.float32)
    out = np.zeros((2, p.dim), dtype=np.float32)
    share = np.mean([r[0] for r in rows]) if rows else 0.5
    share = min(max(share, 1e-3), 1 - 1e-3)
    bias = np.log(np.array([1 - share, share], dtype=np.float32))
    rows = [r for r in rows if len(r[1])]
    steps, done = p.epochs * max(1, -(-len(rows) // p.batch)), 0
    for _ in range(p.epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), p.batch):
            pick = [rows[k] for k in order[at:at + p.batch]]
            y = np.array([r[0] for r in pick])
            idx = np.concatenate([r[1] for r in pick])
            wgt = np.concatenate([r[2] for r in pick])
            ptr = np.cumsum([0] + [len(r[1]) for r in pick])
            hid = np.add.reduceat(embed[idx] * wgt[:, None], ptr[:-1], axis=0)
            z = hid @ out.T + bias
            z -= z.max(axis=1, keepdims=True)
            pr = np.exp(z)
            pr /= pr.sum(axis=1, keepdims=True)
            pr[np.arange(len(y)), y] -= 1.0
            lr = p.rate * (1 - done / steps)
            back = pr @ out
            out -= (lr / len(y)) * (pr.T @ hid)
            bias -= (0.05 * lr / len(y)) * pr.sum(axis=0)
            rows_of, at_row = np.unique(idx, return_inverse=True)
            doc = np.repeat(np.arange(len(y)), np.diff(ptr))
            for c in range(p.dim):
                embed[rows_of, c] -= lr * np.bincount(at_row, weights=back[doc, c] * wgt)
            done += 1
    return Model(p, embed, out, bias, len(rows))


def fit(docs: DataFrame, labels: DataFrame, params: Params | None = None, label: str = "quality") -> Model:
    """Train on at most ``max_rows`` labelled documents (those with the smallest id hashes).

    The sample is taken from the label table first, so that only its rows of
    the documents are read further; both the sample (``max_rows`` rows) and the
    broadcast list of their ids are bounded.
    """
    p = params or Params()
    chosen = (labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("double").alias("y"))
              .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~F.isnan("y"))
              .groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_rows))
    sample = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
              .orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(p.max_rows)
              .select("label", "text"))
    schema = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("ids", T.BinaryType()),
                           T.StructField("cnt", T.BinaryType())])
    got = sample.mapInArrow(_sample_features(p), schema).toArrow()
    kind = np.min_scalar_type(p.buckets - 1)
    return train([(y, np.frombuffer(i.as_buffer(), kind), np.frombuffer(c.as_buffer(), np.float32))
                  for y, i, c in zip(got["label"].to_pylist(), got["ids"], got["cnt"])], p)


def _sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sum of values[ptr[i]:ptr[i + 1]] for every i, empty ranges included."""
    out = np.zeros(len(ptr) - 1)
    some = np.flatnonzero(ptr[1:] > ptr[:-1])
    if len(some):
        out[some] = np.add.reduceat(values[:ptr[-1]], ptr[some], dtype=np.float64)
    return out


def score_block(raw: np.ndarray, offs: np.ndarray, p: Params, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Probability of class 1 for every document of a block."""
    w = Words(raw, offs, lower=False)
    bounds = offs - offs[0]
    step = table[:, 1] - table[:, 0]
    total, cnt = np.zeros(w.n_docs), np.zeros(w.n_docs)
    for f, ptr in word_features(w, p):
        total += _sums(step[f], ptr)
        cnt += np.diff(ptr)
    for n in p.ngrams:
        f, over = gram_features(w.bytes, bounds, n, p)
        v = step[f]
        v[over] = 0.0
        total += _sums(v, bounds)
        cnt += np.maximum(np.diff(bounds) - n + 1, 0)
    return 1.0 / (1.0 + np.exp(-(total / np.maximum(cnt, 1) + bias[1] - bias[0])))


def scored(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns k0, k1, ... (the ``keep`` columns in order), score and predicted for every row.

    The broadcast model has ``buckets`` x 2 numbers, whatever the corpus.
    """
    got = docs.sparkSession.sparkContext.broadcast((model.params, model.table, model.bias))
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches):
        p, table, bias = got.value
        for rb in batches:
            raw, offs = utf8(rb.column("text"))
            s = np.concatenate([np.zeros(0)] + [score_block(raw, offs[lo:hi + 1], p, table, bias) for lo, hi in blocks(offs)])
            yield pa.RecordBatch.from_arrays(
                [*(rb.column(n) for n in names), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))],
                names=[*names, "score", "predicted"])

    given = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col("text").cast("string").alias("text"))
    schema = T.StructType([*[T.StructField(n, docs.schema[c].dataType) for c, n in zip(keep, names)],
                           T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return given.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (probability of label 1) and predicted for every row."""
    return scored(docs, model, ["doc_id"]).withColumnRenamed("k0", "doc_id")


def held_out(modulus: int = 3, remainder: int = 1):
    return (id_crc() % modulus) == remainder


def op4_quality_classifier(docs: DataFrame, labels: DataFrame, params: Params | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; held-out rows are never learned from."""
    model = fit(docs, labels.where(~held_out()), params)
    s = score(docs, model)
    return s.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, params: Params | None = None) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns."""
    model = fit(docs, labels.where(~held_out()), params)
    good = scored(docs, model, docs.columns).where("predicted = 1")
    return good.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])
