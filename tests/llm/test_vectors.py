"""Vector searches against brute force."""

import math
import random

import numpy as np
import pytest

from riskweave.llm import balltree, vamana, vectors


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, rank int").repartition(3)


def rows_for(n=900, dim=8, seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    same = [0.5] * dim
    rows += [(n + i, same) for i in range(120)]                       # a group of equal vectors
    rows += [(n + 200, [0.0] * dim), (n + 201, None), (None, same), (n + 202, []), (n + 203, [1.0, 2.0]),
             (n + 220, [float("nan")] * dim), (n + 240, [None] * dim), (n + 241, [float("inf")] + [0.0] * (dim - 1)), rows[3]]
    return [(i, v, "x", 7) for i, v in rows]


def usable(rows, zero_ok):
    out = {}
    for i, v, *_ in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or (not zero_ok and not any(v)):
            continue
        out[(i, tuple(np.float32(v).astype(float)))] = np.float32(v).astype(float)
    return [(i, v) for (i, _), v in out.items()]


def test_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 300)
    monkeypatch.setattr(vectors.sharded, "__defaults__", (300,))
    monkeypatch.setattr(vectors.blocked, "__defaults__", (20,))
    monkeypatch.setattr(balltree, "LEAF", 8)
    rows = rows_for()
    got = balltree.top_k(table(spark, rows)).collect()
    pts = [(i, np.floor(64 * v).astype(np.int64)) for i, v in usable(rows, True)]
    want = []
    for i, q in pts:
        if i % 20 == 0:
            s = sorted((-int(q @ c), j) for j, c in pts if j != i and len(c) == len(q))[:20]
            want += [(i, r, j, -x) for r, (x, j) in enumerate(s, 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)


def wide_rows(seed, scale, n=260, dim=5):
    rng = random.Random(seed)
    return [(i, [float(np.float32(rng.choice([-1, 1]) * scale ** rng.random() * rng.random())) for _ in range(dim)], "x", 7)
            for i in range(n)]


@pytest.mark.parametrize("scale", [1e7, 1e12, 1e19, 3e38])
def test_top_k_of_large_components_is_exact(spark, monkeypatch, scale):
    """Scores beyond 2**53 are exact integers, and beyond a long the nearest long."""
    monkeypatch.setattr(vectors.sharded, "__defaults__", (90,))
    monkeypatch.setattr(vectors.blocked, "__defaults__", (5,))
    monkeypatch.setattr(balltree, "LEAF", 8)
    rows = wide_rows(3, scale) + [(1000, [1.0] * 5, "x", 7), (1001, [0.0] * 5, "x", 7), (1020, [float(np.float32(1e7))] * 5, "x", 7)]
    got = balltree.top_k(table(spark, rows)).collect()
    pts = [(i, [math.floor(64 * x) for x in v.tolist()]) for i, v in usable(rows, True)]
    want = []
    for i, q in pts:
        if i % 20 == 0:
            s = sorted((-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(q, c)))), j) for j, c in pts if j != i)[:20]
            want += [(i, r, j, -x) for r, (x, j) in enumerate(s, 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)


def test_top_k_of_doubles_near_their_end(spark):
    rows = [(0, [1.0, 1.0]), (1, [1e7, 0.0]), (2, [2e7, 0.0]), (3, [1e300, 0.0]), (4, [-1e305, 1e305]), (5, [1e308, 0.0]),
            (20, [1e200, -1e200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in balltree.top_k(df).where("query_id = 0").orderBy("rank").collect()]
    # 64 * 1e308 is not finite, so that row takes no part
    assert got == [(3, 2**63 - 1), (2, 64 * 64 * 20_000_000), (1, 64 * 64 * 10_000_000), (4, 0), (20, 0)]


def test_graph_search_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(vectors.sharded, "__defaults__", (400,))
    rows = rows_for(dim=16)
    got = vamana.nearest(table(spark, rows)).collect()
    pts = usable(rows, False)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    hit = total = 0
    for i, q in pts:
        if i % 100:
            continue
        want = sorted((float(np.sqrt(((c - q) ** 2).sum())), j) for j, c in pts if j != i and len(c) == len(q))[:10]
        mine = sorted(by[i], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(want) + 1))
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        vec = {}
        for j, c in pts:
            vec.setdefault(j, []).append(c)
        assert all(any(abs(r.score - float(np.sqrt(((c - q) ** 2).sum()))) < 1e-12 for c in vec[r.vec_id]) for r in mine)
        hit += len({j for _, j in want} & {r.vec_id for r in mine})
        total += len(want)
    assert hit >= 0.95 * total


def test_robust_prune_keeps_diverse_edges():
    x = np.array([[0.0, 0], [1, 0], [1.1, 0], [0, 5], [0, 5.5]])
    got = vamana.robust_prune(x, np.array([0]), np.array([[1, 2, 3, 4, 4, -1, 0]]), vamana.Params(degree=4))
    assert [v for v in got[0].tolist() if v >= 0] == [1, 3]


def test_few_and_no_rows(spark):
    one = [(0, [1.0, 2.0], "x", 1)]
    assert balltree.top_k(table(spark, one)).count() == 0 and vamana.nearest(table(spark, one)).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert balltree.top_k(none).count() == 0 and vamana.nearest(none).count() == 0
    two = one + [(1, [2.0, 1.0], "x", 1)]
    r = balltree.top_k(table(spark, two)).collect()
    assert [(x.query_id, x.rank, x.vec_id, x.score) for x in r] == [(0, 1, 1, 64 * 128 * 2)]
