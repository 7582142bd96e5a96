"""Training-order materialisation: a keyed permutation of all sequences, written as fixed-stride shards.

A document's ids are cut into sequences of at most ``length`` tokens.  A
sequence's index is its document's number times the largest number of
sequences a document can have, plus its place in the document; a keyed Feistel
network over the next power of four, walked until it falls below the number of
indices, permutes them.  Sequences in the order of their permuted index are
the training order, so it depends on ids, key and these two bounds only, not
on how the input is split.  Equal ranges of the permuted indices are the
shards: about equally full whatever the ids, as the permutation spreads them.

A shard file holds one record of ``length`` tokens for each of its sequences,
in order (short ones filled with the end id), as little-endian unsigned
integers of 16 bits, or 32 where the vocabulary needs them.  A sequence's
global slot is the number of records in earlier shards plus its record, so
``read_slots`` can start at any slot, and a reader that stopped resumes at the
next one.  A repeated task writes the same file again.

Edge cases: a null or empty text is the end id alone; a null id is the number
after the largest; rows that share an id are ordered by their tokens; ids
further apart than the index space allows are numbered by a hash (equal
numbers ordered by id); an empty table has no shards.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .packing import END_ID, token_ids
from .store import file_system, put, shared_folder, written
from .text import mix

LENGTH = 256
SHARD_BYTES = 32 << 20
ROUNDS = 6
SPACE_BITS = 62


def feistel(x: np.ndarray, size: int, key: int) -> np.ndarray:
    """A permutation of 0 .. size - 1 that ``key`` selects, applied to ``x``."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(key * 0x9E3779B97F4A7C15 % (1 << 64)))
    y = x.astype(np.uint64)
    walk = np.arange(len(y))
    while len(walk):
        left, right = y[walk] >> np.uint64(half), y[walk] & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        y[walk] = (left << np.uint64(half)) | right
        walk = walk[y[walk] >= np.uint64(size)]
    return y


def numbering(docs: DataFrame, length: int) -> tuple[int, int, int]:
    """(smallest id, documents' numbers, sequences a document can have): a token has at least one byte."""
    r = docs.agg(F.min("doc_id"), F.max("doc_id"), F.max(F.octet_length("text"))).first()
    low, high, most = r[0] or 0, r[1] or 0, (r[2] or 0) + 1
    per = -(-most // length)
    return low, min(high - low + 2, max(1, (1 << SPACE_BITS) // per)), per


def sequences(docs: DataFrame, vocabulary: str, key: int = 1, length: int = LENGTH) -> tuple[DataFrame, int]:
    """Rows (place, doc_id, piece, n, ids) with the permuted index, and the number of indices."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    low, numbers, per = numbering(docs, length)
    size = numbers * per
    schema = T.StructType([T.StructField("place", T.LongType()), T.StructField("doc_id", T.LongType()),
                           T.StructField("piece", T.IntegerType()), T.StructField("n", T.IntegerType()),
                           T.StructField("ids", T.BinaryType())])

    def run(batches):
        coder = bpe.load(vocabulary)
        kind = record_type(coder.whole.get_vocab_size())
        for rb in batches:
            names = rb.column("doc_id").to_pylist()
            doc, piece, n, ids = [], [], [], []
            for i, got in token_ids(rb, "text", coder):
                for k in range(0, len(got), length):
                    part = got[k:k + length]
                    doc.append(names[i])
                    piece.append(k // length)
                    n.append(len(part))
                    ids.append(part.astype(kind).tobytes())
            number = np.array([numbers - 1 if d is None else d - low if d - low < numbers - 1 else
                               int(mix(np.array([d & ((1 << 64) - 1)], np.uint64))[0]) % numbers for d in doc], np.int64)
            at = feistel(number * per + np.array(piece, np.int64), size, key).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(doc, pa.int64()), pa.array(piece, pa.int32()),
                                              pa.array(n, pa.int32()), pa.array(ids, pa.binary())], names=schema.names)
    return docs.mapInArrow(run, schema), size


def record_type(vocabulary_size: int) -> str:
    return "<u2" if vocabulary_size <= 1 << 16 else "<u4"


def materialise(docs: DataFrame, vocabulary: str, key: int = 1, length: int = LENGTH,
                shard_bytes: int = SHARD_BYTES) -> tuple[str, DataFrame]:
    """Write the shards; their folder, and per sequence doc_id, piece, slot, shard, record, length, ids_crc32.

    ids_crc32 is of the sequence's ids as little-endian unsigned 32-bit integers.
    """
    spark = docs.sparkSession
    size_text = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows, size = sequences(docs, vocabulary, key, length)
    shards = max(1, -(-size_text // shard_bytes))
    width = -(-size // shards)
    folder = shared_folder(spark, "train")
    out = "shard long, record long, doc_id long, piece int, length long, ids_crc32 long"

    def write(group, table):
        kind = record_type(bpe.load(vocabulary).whole.get_vocab_size())
        step = np.dtype(kind).itemsize
        place, doc = table.column("place").to_pylist(), table.column("doc_id").to_pylist()
        piece, ids = table.column("piece").to_pylist(), table.column("ids").to_pylist()
        order = sorted(range(len(place)), key=lambda i: (place[i], doc[i] is None, doc[i] or 0, piece[i], ids[i]))
        pad = np.full(length, END_ID, kind).tobytes()
        put(folder, f"shard-{group[0].as_py():08d}.bin", b"".join(ids[i] + pad[len(ids[i]):] for i in order))
        crc = [zlib.crc32(np.frombuffer(ids[i], kind).astype("<u4").tobytes()) for i in order]
        n = len(order)
        return pa.table({"shard": pa.array([group[0].as_py()] * n, pa.int64()), "record": pa.array(range(n), pa.int64()),
                         "doc_id": pa.array([doc[i] for i in order], pa.int64()),
                         "piece": pa.array([piece[i] for i in order], pa.int32()),
                         "length": pa.array([len(ids[i]) // step for i in order], pa.int64()),
                         "ids_crc32": pa.array(crc, pa.int64())})
    done = rows.withColumn("shard", F.floor(F.col("place") / F.lit(width)).cast("long")).groupBy("shard").applyInArrow(write, out)
    done = written(done, "manifest")
    base = bases(done)
    return folder, done.join(base, "shard").select(
        "doc_id", "piece", (F.col("base") + F.col("record")).alias("slot"), "shard", "record", "length", "ids_crc32")


def bases(manifest: DataFrame) -> DataFrame:
    """(shard, base, records): the first slot of every shard; one small row per shard."""
    count = manifest.groupBy("shard").agg(F.count("*").alias("records"))
    before = F.sum("records").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, 0)) - F.col("records")
    return count.select("shard", before.alias("base"), "records")


def read_slots(folder: str, table: list[tuple[int, int, int]], start: int, count: int, kind: str = "<u2",
               length: int = LENGTH) -> np.ndarray:
    """The records of slots start .. start + count - 1 as a matrix; ``table``: rows of ``bases`` in order."""
    store, path = file_system(folder)
    stride, out = length * np.dtype(kind).itemsize, []
    for shard, base, records in table:
        a, b = max(start, base), min(start + count, base + records)
        if a < b:
            with store.open_input_file(f"{path}/shard-{shard:08d}.bin") as f:
                f.seek((a - base) * stride)
                out.append(np.frombuffer(f.read((b - a) * stride), kind).reshape(-1, length))
    return np.concatenate(out) if out else np.zeros((0, length), kind)
