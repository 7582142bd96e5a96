"""Histogram boosting: equal to a plain row-by-row version, independent of partitions; edge cases."""

import os
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import boosting as B

FEATURES = ["x", "flag-a", "z"]


def table(n=1500, seed=3):
    rng = np.random.default_rng(seed)
    x, flag, z = np.round(rng.normal(size=n), 2), rng.integers(0, 2, n).astype(float), rng.integers(0, 9, n).astype(float)
    logit = 1.5 * x - 2 * flag + np.where(z > 5, 1.0, -0.5) * x
    y = (rng.random(n) < 1 / (1 + np.exp(-logit))).astype(int)
    x[rng.random(n) < 0.1] = np.nan
    return x, flag, z, y


def frame(spark, x, flag, z, y, parts=3):
    rows = [(i, None if np.isnan(a) and i % 2 else float(a), float(b), float(c), int(d))
            for i, (a, b, c, d) in enumerate(zip(x, flag, z, y))]
    return spark.createDataFrame(rows, "transaction_id long, x double, `flag-a` double, z double, is_fraud int").repartition(parts)


def plain(bins, y, p, cuts, base):
    """One node at a time over plain rows; best first, or depth first without a leaf limit."""
    n_rows, n_feat = bins.shape
    margin = np.full(n_rows, base)
    trees = []
    for number in range(p.trees):
        prob = 1 / (1 + np.exp(-margin))
        w = np.where(y == 1, p.pos_weight, 1.0)
        g, h = np.rint((prob - y) * w * 2**24), np.rint(prob * (1 - prob) * w * 2**24)
        allowed = B.columns_of(number, n_feat, p)

        def best(idx, depth):
            if p.depth is not None and depth >= p.depth:
                return None
            found = (p.min_gain, None)
            score = lambda i: (g[i].sum() / 2**24) ** 2 / (h[i].sum() / 2**24 + p.l2) if len(i) else 0.0
            for f in allowed:
                b = bins[idx, f]
                for cut in range(1, max(len(c) for c in cuts) + 1):
                    for miss in (False, True):
                        go = np.where(b == 0, miss, b <= cut)
                        lo, hi = idx[go], idx[~go]
                        if min(len(lo), len(hi)) < max(1, p.min_rows) or min(h[lo].sum(), h[hi].sum()) < p.min_hessian * 2**24:
                            continue
                        gain = 0.5 * (score(lo) + score(hi) - score(idx))
                        if gain > found[0]:
                            found = (gain, (f, cut, miss, lo, hi))
            return found if found[1] else None
        leaves = [(np.arange(n_rows), 0)]
        open_ = [(best(*leaves[0]), 0)]
        leaf = {0: leaves[0]}
        made = 1
        splits = 0
        while True:
            can = [(b, i) for b, i in open_ if b and i in leaf]
            if not can or (p.leaves is not None and len(leaf) >= p.leaves):
                break
            (_, (f, cut, miss, lo, hi)), i = max(can, key=lambda c: (c[0][0], -c[1]))
            depth = leaf.pop(i)[1] + 1
            splits += 1
            for part in (lo, hi):
                leaf[made] = (part, depth)
                open_.append((best(part, depth), made))
                made += 1
        for idx, _ in leaf.values():
            margin[idx] += -p.rate * (g[idx].sum() / 2**24) / (h[idx].sum() / 2**24 + p.l2)
        trees.append(splits)
    return margin, trees


PARAMS = [B.Params(trees=4, depth=3, bins=12), B.Params(trees=3, depth=None, leaves=6, l2=0.0, min_rows=20, min_hessian=1e-3,
                                                        rate=0.1, from_average=True, bins=9),
          B.Params(trees=4, depth=4, leaves=7, columns=0.7, pos_weight=1.5, min_hessian=10, bins=10)]


@pytest.mark.parametrize("p", PARAMS)
def test_equals_plain_version(spark, p):
    x, flag, z, y = table()
    df = frame(spark, x, flag, z, y)
    model = B.fit(df, FEATURES, params=p)
    bins = B.bin_rows([x, flag, z], model.cuts)
    margin, splits = plain(bins.astype(int), y, p, model.cuts, model.base)
    assert [int((t.feature >= 0).sum()) for t in model.trees] == splits
    assert np.allclose(model.margin(bins), margin, atol=1e-12)
    got = {r.transaction_id: r.probability for r in B.score(model, df).collect()}
    assert np.allclose([got[i] for i in range(len(y))], 1 / (1 + np.exp(-margin)), atol=1e-12)
    y1, p1 = y == 1, 1 / (1 + np.exp(-margin))
    assert p1[y1].mean() > p1[~y1].mean() + 0.05


def test_same_model_for_any_partitions_and_saved(spark, scratch):
    x, flag, z, y = table(600)
    p = B.Params(trees=12, depth=3, rows=0.6, columns=0.7, bins=16)       # more trees than CUT_EACH
    models = [B.fit(frame(spark, x, flag, z, y, k), FEATURES, params=p) for k in (1, 7)]
    models[0].cuts, models[1].cuts = models[1].cuts, models[0].cuts
    path = os.path.join(scratch, "model")
    B.save(spark, models[0], path)
    models.append(B.load(spark, path))
    for a, b in zip(models, models[1:]):
        assert all(np.array_equal(s, t) for s, t in zip(a.cuts, b.cuts)) and a.base == b.base and len(a.trees) == 12
        for s, t in zip(a.trees, b.trees):
            assert all(np.array_equal(getattr(s, k), getattr(t, k)) for k in ("feature", "upto", "missing_left", "left", "right"))
            assert np.allclose(s.value, t.value)


def test_row_share_is_kept_in_every_group_of_equal_rows():
    bins, y = np.arange(400).reshape(-1, 1) % 50, np.arange(400) % 2
    n = np.full(400, 1000)
    got = B.drawn(bins, y, n, 5, replace(B.BY_DEPTH, rows=0.7468))
    assert ((got == 746) | (got == 747)).all()
    one = [B.drawn(np.arange(4000).reshape(-1, 1), np.zeros(4000, int), np.ones(4000), t, replace(B.BY_DEPTH, rows=0.3)) for t in (1, 2)]
    assert all(abs(o.mean() - 0.3) < 0.03 for o in one) and (one[0] != one[1]).any()


def test_edge_cases(spark):
    df = frame(spark, *table(200))
    none = df.limit(0)
    empty = B.fit(none, FEATURES)
    assert empty.trees == [] and [r.probability for r in B.score(empty, df.limit(3)).collect()] == [0.5] * 3
    p = B.Params(trees=2, depth=2)
    same = B.fit(df.withColumn("is_fraud", F.lit(1)), FEATURES, params=p)       # one class
    assert all(r.probability > 0.5 for r in B.score(same, df).collect())
    nulls = df.withColumn("x", F.lit(None).cast("double")).withColumn("is_fraud", F.when(F.col("transaction_id") > 100, F.col("is_fraud")))
    model = B.fit(nulls, FEATURES, params=p)
    assert len(model.cuts[0]) == 0 and B.score(model, none).count() == 0
    assert B.score(model, nulls).count() == 200


def test_saved_parameters():
    first, second = B.tuned("first"), B.tuned("second")
    assert (first.trees, first.depth, first.leaves, first.min_hessian) == (267, 9, None, 10.0)
    assert (second.trees, second.depth, second.leaves, second.min_rows) == (152, 8, 159, 7)


def same(a, b):
    return len(a.trees) == len(b.trees) and all(
        np.array_equal(getattr(s, k), getattr(t, k)) for s, t in zip(a.trees, b.trees) for k in s.__dataclass_fields__)


@pytest.mark.parametrize("p", [replace(PARAMS[1], trees=12), replace(PARAMS[2], trees=12, rows=0.6)])
def test_rounds_in_the_driver_and_as_jobs_make_one_model(spark, monkeypatch, p):
    df = frame(spark, *table(600))
    here = B.fit(df, FEATURES, params=p)
    monkeypatch.setattr(B, "DRIVER_ROWS", 0)
    jobs = B.fit(df, FEATURES, params=p)
    assert len(here.trees) == 12 and same(here, jobs)


def test_sums_of_cells_stay_whole():
    """Counts times units pass 2**53, where floating-point sums would lose the last bits."""
    p, leaf = replace(B.BY_DEPTH, pos_weight=3.0), B.as_tree([B.Node(None, 0)], [], [0], B.BY_DEPTH)
    n = np.array([(1 << 31) + 1, (1 << 30) + 3, 5])
    bins, y = np.array([[1], [1], [0]], np.uint16), np.array([1, 0, 1])
    got = B.cells(bins, y, n, np.array([0.1, 0.3, 0.2]), leaf, 0, [0], [0], 3, p)
    g, h = (x.tolist() for x in B.gradients(y, np.array([0.1, 0.3, 0.2]), p))
    want = [[sum(v[i] * int(n[i]) for i in rows) for v in (g, h, [1] * 3)] for rows in ([2], [0, 1], [])]
    assert got[0, 0].tolist() == want and abs(want[1][0]) > 1 << 53


@pytest.mark.parametrize("query, trees", [("hist_boost_scores", 100), ("hist_boost_tuned_scores", 152),
                                          ("gbt_tuned_scores", 267)])
def test_registered_queries_grow_every_tree_of_their_parameters(spark, monkeypatch, query, trees):
    from riskweave.plans import registry
    registry.load_all()
    models, score = [], B.score
    monkeypatch.setattr(B, "score", lambda model, *a, **k: models.append(model) or score(model, *a, **k))
    assert registry.QUERIES[query](spark, "/root/testdata/sf0.001").count() > 0
    assert [len(m.trees) for m in models] == [trees]
