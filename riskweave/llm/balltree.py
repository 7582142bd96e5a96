"""Exact top-k inner products by branch and bound in one ball tree per shard.

A node's points lie within a radius of its centre, so a query's inner product
with any of them is at most q.c + |q| r.  A block of queries descends the tree
together; each query takes the child with the larger bound first and leaves a
node whose bound is below its current kth score.  That score is shared: a
first pass finds every query's kth score in one shard, and all shards' searches
start from it.  Bounds carry slack for rounding and ties are kept, so results
are exact.

Each block of queries takes its first pass in a shard of its own.

Vectors are quantised to floor(64 x).  While |q| times the longest vector of a
shard is below 2**53, sums of float64 are exact integers; beyond, candidates
whose rounded score may reach the kth are scored in Python integers.  A score
beyond a long is given as the nearest long, and ranked as that.

Edge cases: rows with a null id or vector, an empty vector, or components that
are null, not finite or not finite times 64 take no part; rows that repeat id
and vector count
once; rows with a query's id are not its candidates; only vectors of one
length are compared; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import written
from .vectors import best, blocked, first_of_equal, met, sharded, valid

LEAF = 64
EXACT = float(1 << 53)     # sums of integers below this are exact in float64
LONG = (1 << 63) - 1


def quantised(v: DataFrame) -> DataFrame:
    """floor(64 x) as double: from 2**53 on a double has no fraction, and below that the floor fits a long."""
    whole = lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)
    out = v.withColumn("vec", F.transform("vec", lambda x: whole(x * 64)))
    return out.where(~F.exists("vec", lambda x: F.abs(x) == float("inf")))


def build(ids: np.ndarray, x: np.ndarray) -> bytes:
    """The tree as bytes: points in leaf order, and per node (first, last, left, right), centre and radius."""
    order = np.arange(len(ids))
    nodes, centres, radii = [], [], []

    def node(a: int, b: int) -> int:
        me = len(nodes)
        pts = x[order[a:b]]
        c = pts.mean(axis=0)
        d = np.nan_to_num(((pts - c) ** 2).sum(axis=1), nan=np.inf)
        nodes.append([a, b, -1, -1])
        centres.append(c)
        radii.append(float(np.sqrt(d.max())) * (1 + 1e-9))
        if b - a > LEAF and d.max() > 0:
            far = pts[d.argmax()]
            other = pts[((pts - far) ** 2).sum(axis=1).argmax()]
            side = np.nan_to_num(pts @ (other - far))
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(side, mid)]
            nodes[me][2:] = [node(a, a + mid), node(a + mid, b)]
        return me
    with np.errstate(over="ignore", invalid="ignore"):
        node(0, len(ids))
    head = np.array([len(ids), x.shape[1], len(nodes)], np.int64)
    return b"".join(p.tobytes() for p in (head, ids[order].astype(np.int64), x[order].astype(np.float64),
                                          np.array(nodes, np.int64), np.array(centres), np.array(radii)))


class Tree:
    def __init__(self, data):
        n, dim, m = np.frombuffer(data, np.int64, 3)
        at = 24
        self.ids = np.frombuffer(data, np.int64, n, at)
        at += 8 * n
        self.x = np.frombuffer(data, np.float64, n * dim, at).reshape(n, dim)
        at += 8 * n * dim
        self.nodes = np.frombuffer(data, np.int64, 4 * m, at).reshape(m, 4).tolist()
        at += 32 * m
        self.centres = np.frombuffer(data, np.float64, m * dim, at).reshape(m, dim)
        self.radii = np.frombuffer(data, np.float64, m, at + 8 * m * dim)
        with np.errstate(over="ignore"):
            self.longest = float(np.sqrt((self.x ** 2).sum(axis=1)).max()) if n else 0.0

    def bounds(self, q: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Upper bound of every query's inner products with every node's points."""
        with np.errstate(over="ignore", invalid="ignore"):
            b = q @ self.centres.T + norm[:, None] * self.radii
            b += (np.abs(b) + norm[:, None] * self.longest * self.x.shape[1]) * 1e-9 + 1e-6
        return np.nan_to_num(b, nan=np.inf, posinf=np.inf)


def search_wide(tree: Tree, qid: int, q: np.ndarray, k: int, floor: float) -> list[tuple[int, int]]:
    """(score, id) of one query's k best candidates in exact integers, best first."""
    with np.errstate(over="ignore", invalid="ignore"):
        norm = float(np.sqrt((q ** 2).sum()))
        slack = norm * tree.longest * len(q) * 2.0**-50
    whole = [int(v) for v in q]
    bound = tree.bounds(q[None], np.array([norm]))[0]
    kept: list[tuple[int, int]] = []
    kth = floor

    def visit(at: int):
        nonlocal kept, kth
        if bound[at] < kth:
            return
        a, b, left, right = tree.nodes[at]
        if left >= 0:
            for child in sorted((left, right), key=lambda c: -bound[c]):
                visit(child)
            return
        with np.errstate(over="ignore", invalid="ignore"):
            near = ~(tree.x[a:b] @ q + slack < kth) & (tree.ids[a:b] != qid)
        for i in np.flatnonzero(near) + a:
            score = sum(u * int(v) for u, v in zip(whole, tree.x[i]))
            kept.append((max(-LONG - 1, min(LONG, score)), int(tree.ids[i])))
        kept = sorted(kept, key=lambda c: (-c[0], c[1]))[:k]
        if len(kept) == k:
            kth = max(kth, below(kept[-1][0]))
    visit(0)
    return kept


def below(score: int) -> float:
    """A double that is no larger than an integer."""
    f = float(score)
    return f if f <= score else float(np.nextafter(f, -np.inf))


def answers(tree: Tree, qid: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray):
    """(query row, candidate's id, score) arrays, and each query's kth score (-inf: fewer), exact for all sizes."""
    with np.errstate(over="ignore"):
        wide = ~(np.sqrt((q ** 2).sum(axis=1)) * tree.longest < EXACT)
    small = np.flatnonzero(~wide)
    score, ids = search(tree, qid[small], q[small], k, floor[small])
    row, col = np.nonzero(score > -np.inf)
    out = [small[row]], [ids[row, col]], [score[row, col].astype(np.int64)]
    kth = np.full(len(qid), -np.inf)
    kth[small] = score[:, k - 1]
    for i in np.flatnonzero(wide):
        best_ = search_wide(tree, int(qid[i]), q[i], k, float(floor[i]))
        out[0].append(np.full(len(best_), i))
        out[1].append(np.array([c[1] for c in best_], np.int64))
        out[2].append(np.array([c[0] for c in best_], np.int64))
        if len(best_) == k:
            kth[i] = below(best_[-1][0])
    return (*(np.concatenate(o) for o in out), kth)


def search(tree: Tree, qid: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray):
    """(scores, ids) of each query's k best candidates that score at least ``floor``; -inf where there are fewer."""
    n = len(qid)
    norm = np.sqrt((q ** 2).sum(axis=1)) * (1 + 1e-9)
    score = np.full((n, k), -np.inf)
    ids = np.full((n, k), np.iinfo(np.int64).max)
    kth = floor.astype(np.float64).copy()
    bound = tree.bounds(q, norm)

    def leaf(a: int, b: int, who: np.ndarray):
        s = q[who] @ tree.x[a:b].T
        s[tree.ids[a:b] == qid[who][:, None]] = -np.inf
        s[s < kth[who][:, None]] = -np.inf
        some = np.flatnonzero((s > -np.inf).any(axis=1))
        if not len(some):
            return
        who, s = who[some], s[some]
        alls = np.concatenate([score[who], s], axis=1)
        alli = np.concatenate([ids[who], np.broadcast_to(tree.ids[a:b], s.shape)], axis=1)
        top = np.lexsort((alli, -alls), axis=1)[:, :k]
        score[who], ids[who] = np.take_along_axis(alls, top, 1), np.take_along_axis(alli, top, 1)
        kth[who] = np.maximum(kth[who], score[who, k - 1])

    def visit(at: int, who: np.ndarray):
        who = who[bound[who, at] >= kth[who]]
        if not len(who):
            return
        a, b, left, right = tree.nodes[at]
        if left < 0:
            leaf(a, b, who)
            return
        first = bound[who, left] >= bound[who, right]
        for group, order in ((who[first], (left, right)), (who[~first], (right, left))):
            for child in order:
                visit(child, group)
    visit(0, np.arange(n))
    return score, ids


def _searched(k: int):
    def run(batches):
        for rb in batches:
            for r in range(rb.num_rows):
                tree = Tree(rb.column("index")[r].as_buffer())
                qid = np.frombuffer(rb.column("ids")[r].as_buffer(), np.int64)
                q = np.frombuffer(rb.column("mat")[r].as_buffer(), np.float64).reshape(len(qid), -1)
                floor = np.frombuffer(rb.column("floor")[r].as_buffer(), np.float64)
                row, ids, score, _ = answers(tree, qid, q, k, floor)
                yield pa.RecordBatch.from_arrays([pa.array(qid[row]), pa.array(ids), pa.array(score)],
                                                 names=["query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of every query (vec_id divisible by ``every``)."""
    v = written(quantised(valid(vectors, zero_ok=True)), "vectors")
    index = written(sharded(first_of_equal(v, k), build), "trees")
    blocks = written(blocked(v.where(F.col("vec_id") % every == 0)), "queries")
    fields = "query_id long, vec_id long, score long"
    # a first floor for each query: its kth score in the shard that its block begins with; blocks are dealt over shards
    place = W.partitionBy("dim")
    shards = index.select("dim", "shard").select(
        "dim", "shard", (F.row_number().over(place.orderBy("shard")) - 1).alias("nth"), F.count("*").over(place).alias("of"))
    own = (blocks.select("block", "dim").join(shards, "dim")
           .where(F.col("nth") == F.pmod("block", "of")).select("block", "dim", "shard"))
    one = blocks.join(own, ["block", "dim"]).join(index, ["dim", "shard"])

    def floors(batches):
        for rb in batches:
            out = []
            for r in range(rb.num_rows):
                qid = np.frombuffer(rb.column("ids")[r].as_buffer(), np.int64)
                q = np.frombuffer(rb.column("mat")[r].as_buffer(), np.float64).reshape(len(qid), -1)
                *_, kth = answers(Tree(rb.column("index")[r].as_buffer()), qid, q, k, np.full(len(qid), -np.inf))
                out.append(kth.tobytes())
            yield pa.RecordBatch.from_arrays([rb.column("block"), rb.column("dim"), pa.array(out, pa.binary())],
                                             names=["block", "dim", "floor"])
    floor = written(one.select("block", "dim", "ids", "mat", "index").mapInArrow(floors, "block long, dim int, floor binary"),
                    "floors")
    pairs = met(index, blocks.join(floor, ["block", "dim"])).select("ids", "mat", "floor", "index")
    return best(pairs.mapInArrow(_searched(k), fields), k, largest=True)
