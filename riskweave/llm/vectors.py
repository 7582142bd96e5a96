"""Shared parts of the vector searches: valid vectors, shards of bounded size, blocks of queries.

Both searches work on one row per shard (its index, as bytes) and one row per
block of queries, and meet in an equi-join on the shard number: every block
meets every shard, and no task holds more than one of each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHARD_ROWS = 8192
BLOCK_QUERIES = 1024
SALTS = 64


def valid(vectors: DataFrame, zero_ok: bool) -> DataFrame:
    """vec_id, vec (array of double) of the rows whose id and components are there and finite."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    keep = F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & ~bad
    return v.where(keep if zero_ok else keep & F.exists("vec", lambda x: x != 0))


def first_of_equal(v: DataFrame, k: int) -> DataFrame:
    """Of every group of equal vectors the k + 1 smallest ids, each once.

    As ties go to the smaller id, no other row of the group can be among a
    query's k results.  Two levels of ranking spread a frequent vector.
    """
    v = v.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    v = v.groupBy("vec", "salt", "vec_id").agg(F.lit(1).alias("one")).drop("one")
    by_salt = W.partitionBy("vec", "salt").orderBy("vec_id")
    v = v.withColumn("r", F.row_number().over(by_salt)).where(F.col("r") <= k + 1).drop("r", "salt")
    return v.withColumn("r", F.row_number().over(W.partitionBy("vec").orderBy("vec_id"))).where(F.col("r") <= k + 1).drop("r")


def sharded(v: DataFrame, build, per_shard: int = SHARD_ROWS) -> DataFrame:
    """(shard, dim, index) with ``build(ids, matrix) -> bytes`` for every shard of about ``per_shard`` rows."""
    n = max(1, -(-v.count() // per_shard))

    def run(key, table):
        ids = table.column("vec_id").to_numpy()
        mat = np.stack(table.column("vec").to_numpy(zero_copy_only=False))
        order = np.argsort(ids, kind="stable")
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "dim": pa.array([key[1].as_py()], pa.int32()),
                         "index": pa.array([build(ids[order], mat[order])], pa.binary())})
    return (v.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(n))).withColumn("dim", F.size("vec"))
            .groupBy("shard", "dim").applyInArrow(run, "shard long, dim int, index binary"))


def blocked(queries: DataFrame, per_block: int = BLOCK_QUERIES) -> DataFrame:
    """(block, dim, ids, mat): queries packed as bytes, about ``per_block`` in a row."""
    q = queries.groupBy("vec_id", "vec").agg(F.lit(1).alias("one")).drop("one")
    n = max(1, -(-q.count() // per_block))

    def run(key, table):
        mat = np.stack(table.column("vec").to_numpy(zero_copy_only=False))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "dim": pa.array([key[1].as_py()], pa.int32()),
                         "ids": pa.array([table.column("vec_id").to_numpy().tobytes()], pa.binary()),
                         "mat": pa.array([mat.tobytes()], pa.binary())})
    return (q.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n))).withColumn("dim", F.size("vec"))
            .groupBy("block", "dim").applyInArrow(run, "block long, dim int, ids binary, mat binary"))


def met(index: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every block of queries with every shard of its dimension."""
    shards = index.select("shard", "dim")
    pairs = blocks.join(shards, "dim")
    return pairs.join(index, ["shard", "dim"])


def best(found: DataFrame, k: int, largest: bool) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best, ties to the smaller id."""
    order = F.col("score").desc() if largest else F.col("score").asc()
    w = W.partitionBy("query_id").orderBy(order, "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
