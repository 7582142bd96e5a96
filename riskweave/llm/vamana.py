"""Approximate nearest neighbours on a robust-pruned directed graph per shard.

Each shard's graph is built in growing batches: a greedy beam search from the
medoid over the graph so far proposes neighbours; relaxed distance pruning
keeps the nearest candidate and drops those that are ``alpha`` times closer to
it than to the point, until ``degree`` edges are kept; reverse edges are added
and pruned alike.  A query's beam search runs in every shard, and the shards'
finds are ranked by their exact distances.

Every valid row is indexed (equal vectors share a node, which lists the
smallest ids).  Edge cases: rows with a null id or vector, an empty or zero
vector, or null or non-finite components take no part; rows that repeat id
and vector count once; rows with a query's id are not its candidates; only
vectors of one length are compared; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .vectors import best, blocked, first_of_equal, met, sharded, valid


@dataclass(frozen=True)
class Params:
    degree: int = 32
    alpha: float = 1.2
    build_beam: int = 48
    beam: int = 96
    batch: int = 256
    seed: int = 5


def _gap(x: np.ndarray, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its own rows (-1: infinite)."""
    p = x[np.maximum(rows, 0)]
    d = np.einsum("bij,bij->bi", p, p) - 2 * np.einsum("bij,bj->bi", p, q) + np.einsum("bj,bj->b", q, q)[:, None]
    d[rows < 0] = np.inf
    return d


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, squared distances) of the ``width`` nearest points met by each query, nearest first."""
    n = len(q)
    rows = np.full((n, width), -1, np.int64)
    rows[:, 0] = start
    dist = np.full((n, width), np.inf)
    dist[:, 0] = _gap(x, rows[:, :1], q)[:, 0]
    done = np.zeros((n, width), bool)
    seen = np.zeros((n, len(x)), bool)
    seen[:, start] = True
    live = np.arange(n)
    while len(live):
        todo = ~done[live] & (rows[live] >= 0)
        at = todo.argmax(axis=1)                         # the beam is in order of distance
        some = todo[np.arange(len(live)), at]
        live, at = live[some], at[some]
        if not len(live):
            break
        done[live, at] = True
        near = graph[rows[live, at]]
        new = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        near = np.where(new, near, -1)
        r, c = np.nonzero(new)
        seen[live[r], near[r, c]] = True
        alld = np.concatenate([dist[live], _gap(x, near, q[live])], axis=1)
        allr = np.concatenate([rows[live], near], axis=1)
        alldone = np.concatenate([done[live], np.zeros(near.shape, bool)], axis=1)
        top = np.argsort(alld, axis=1, kind="stable")[:, :width]
        dist[live], rows[live] = np.take_along_axis(alld, top, 1), np.take_along_axis(allr, top, 1)
        done[live] = np.take_along_axis(alldone, top, 1)
        rows[live] = np.where(np.isinf(dist[live]), -1, rows[live])
    return rows, dist


def robust_prune(x: np.ndarray, own: np.ndarray, cand: np.ndarray, p: Params) -> np.ndarray:
    """At most ``degree`` diverse neighbours for each of ``own`` among its candidates (-1: none)."""
    cand = np.where(cand == own[:, None], -1, cand)
    order = np.sort(cand, axis=1)
    twice = np.zeros(cand.shape, bool)
    twice[:, 1:] = order[:, 1:] == order[:, :-1]
    cand = np.where(twice, -1, order)
    dist = _gap(x, cand, x[own])
    out = np.full((len(own), p.degree), -1, np.int64)
    pts = x[np.maximum(cand, 0)]
    for k in range(p.degree):
        pick = dist.argmin(axis=1)
        ok = np.isfinite(dist[np.arange(len(own)), pick])
        if not ok.any():
            break
        out[ok, k] = cand[ok, pick[ok]]
        chosen = pts[np.arange(len(own)), pick]
        between = ((pts - chosen[:, None, :]) ** 2).sum(axis=2)
        dist[(p.alpha ** 2) * between <= dist] = np.inf
        dist[np.arange(len(own)), pick] = np.inf
    return out


def build_graph(x: np.ndarray, p: Params) -> tuple[np.ndarray, int]:
    """(neighbours of every point, start point)."""
    n = len(x)
    graph = np.full((n, p.degree), -1, np.int64)
    start = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order = np.random.default_rng(p.seed).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    at = 1
    while at < n:
        batch = order[at:at + min(max(at, 8), p.batch)]
        found, _ = beam_search(x, graph, start, x[batch], p.build_beam)
        # members of a small early batch see one another, so that the first graph is connected
        if at < p.batch:
            found = np.concatenate([found, np.broadcast_to(batch, (len(batch), len(batch)))], axis=1)
        graph[batch] = robust_prune(x, batch, np.concatenate([found, graph[batch]], axis=1), p)
        src = np.repeat(batch, p.degree)
        dst = graph[batch].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        heads, first, count = np.unique(dst, return_index=True, return_counts=True)
        back = np.full((len(heads), int(count.max())), -1, np.int64)
        back[np.repeat(np.arange(len(heads)), count), np.arange(len(dst)) - np.repeat(first, count)] = src
        for a in range(0, len(heads), 512):
            h = heads[a:a + 512]
            both = np.concatenate([graph[h], back[a:a + 512]], axis=1)
            both = -np.sort(-both, axis=1)
            room = (both >= 0).sum(axis=1) <= p.degree
            keep = np.full((len(h), p.degree), -1, np.int64)
            m = min(p.degree, both.shape[1])
            keep[room, :m] = both[room, :m]
            if (~room).any():
                keep[~room] = robust_prune(x, h[~room], both[~room], p)
            graph[h] = keep
        at += len(batch)
    return graph, start


def builder(p: Params, k: int):
    """Index of a shard as bytes: distinct vectors, up to k + 1 ids of each, graph, start."""
    def build(ids: np.ndarray, mat: np.ndarray) -> bytes:
        x, back = np.unique(mat, axis=0, return_inverse=True)
        back = back.ravel()
        by = np.lexsort((ids, back))
        first = np.flatnonzero(np.r_[True, np.diff(back[by]) > 0])
        nth = np.arange(len(by)) - np.repeat(first, np.diff(np.r_[first, len(by)]))
        own = np.full((len(x), k + 1), -1, np.int64)
        ok = nth <= k
        own[back[by][ok], nth[ok]] = ids[by][ok]
        mean = x.mean(axis=0)
        graph, start = build_graph(x - mean, p)
        head = np.array([len(x), x.shape[1], p.degree, start], np.int64)
        return b"".join(a.tobytes() for a in (head, x, own, graph))
    return build


def _searched(p: Params, k: int):
    def run(batches):
        for rb in batches:
            for r in range(rb.num_rows):
                data = rb.column("index")[r].as_buffer()
                n, dim, degree, start = (int(v) for v in np.frombuffer(data, np.int64, 4))
                x = np.frombuffer(data, np.float64, n * dim, 32).reshape(n, dim)
                own = np.frombuffer(data, np.int64, n * (k + 1), 32 + 8 * n * dim).reshape(n, k + 1)
                graph = np.frombuffer(data, np.int64, n * degree, 32 + 8 * n * (dim + k + 1)).reshape(n, degree)
                qid = np.frombuffer(rb.column("ids")[r].as_buffer(), np.int64)
                q = np.frombuffer(rb.column("mat")[r].as_buffer(), np.float64).reshape(len(qid), dim)
                mean = x.mean(axis=0)
                for a in range(0, len(qid), p.batch):
                    part, who = q[a:a + p.batch], qid[a:a + p.batch]
                    rows, _ = beam_search(x - mean, graph, start, part - mean, p.beam)
                    row, col = np.nonzero(rows >= 0)
                    hit = rows[row, col]
                    d = np.sqrt(((x[hit] - part[row]) ** 2).sum(axis=1))
                    ids = own[hit]
                    ok = (ids >= 0) & (ids != who[row][:, None])
                    i, j = np.nonzero(ok)
                    qq, vv, dd = who[row[i]], ids[i, j], d[i]
                    by = np.lexsort((vv, dd, qq))                  # only each query's k best leave the shard
                    qq, vv, dd = qq[by], vv[by], dd[by]
                    first = np.flatnonzero(np.r_[True, qq[1:] != qq[:-1]]) if len(qq) else np.zeros(0, np.int64)
                    nth = np.arange(len(qq)) - np.repeat(first, np.diff(np.r_[first, len(qq)]))
                    keep = nth < k
                    yield pa.RecordBatch.from_arrays([pa.array(qq[keep]), pa.array(vv[keep]), pa.array(dd[keep])],
                                                     names=["query_id", "vec_id", "score"])
    return run


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, params: Params | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: up to k near rows of every query (vec_id divisible by ``every``)."""
    p = params or Params()
    v = written(valid(vectors, zero_ok=False), "vectors")
    index = written(sharded(first_of_equal(v, k), builder(p, k)), "graphs")
    blocks = written(blocked(v.where(F.col("vec_id") % every == 0)), "queries")
    pairs = met(index, blocks).select("ids", "mat", "index")
    return best(pairs.mapInArrow(_searched(p, k), "query_id long, vec_id long, score double"), k, largest=False)
