"""Drift tests and distances against numpy over plain samples; edge cases."""

import math

import numpy as np
from pyspark.sql import functions as F

from riskweave.operators import drift_tests as DT


def samples(seed, n, m):
    rng = np.random.default_rng(seed)
    return np.round(rng.normal(size=n), 1), np.round(rng.normal(0.2, 1.3, size=m), 1)


def ks_plain(a, b):
    x = np.unique(np.concatenate([a, b]))
    return np.abs(np.searchsorted(np.sort(a), x, "right") / len(a) - np.searchsorted(np.sort(b), x, "right") / len(b)).max()


def wasserstein_plain(a, b):
    x = np.unique(np.concatenate([a, b]))
    fa, fb = (np.searchsorted(np.sort(s), x, "right") / len(s) for s in (a, b))
    return float((np.abs(fa - fb)[:-1] * np.diff(x)).sum()) / a.std()


def js_plain(p, q):
    m = (p + q) / 2
    part = lambda s: sum(v * math.log2(v / w) for v, w in zip(s, m) if v)
    return math.sqrt((part(p) + part(q)) / 2)


def frame(spark, x, flag, cat):
    return spark.createDataFrame([(float(a), bool(b), str(c), int(b)) for a, b, c in zip(x, flag, cat)],
                                 "`x-1` double, flag boolean, cat string, bit int")


def test_equal_to_numpy(spark):
    a, b = samples(1, 700, 400)
    rng = np.random.default_rng(2)
    fa, fb = rng.random(700) < 0.3, rng.random(400) < 0.4
    ca, cb = rng.integers(0, 5, 700), rng.integers(0, 6, 400)
    ref, cur = frame(spark, a, fa, ca), frame(spark, b, fb, cb)
    extra = spark.createDataFrame([(float("nan"), None, None, None), (None, None, None, None)], ref.schema)
    ref, cur, cols = ref.unionByName(extra), cur.unionByName(extra), ["x-1", "flag", "cat", "bit"]
    t = {r.feature: r for r in DT.tests(ref, cur, cols).collect()}
    assert {c: t[c].kind for c in cols} == {"x-1": "number", "flag": "flag", "cat": "category", "bit": "flag"}
    ks = ks_plain(a, b)
    lam = math.sqrt(700 * 400 / 1100) * ks
    p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 200))
    assert abs(t["x-1"].statistic - ks) < 2e-6 and abs(t["x-1"].p_value - p) < 2e-6
    pool = (fa.sum() + fb.sum()) / 1100
    z = (fb.mean() - fa.mean()) / math.sqrt(pool * (1 - pool) * (1 / 700 + 1 / 400))
    assert abs(t["flag"].statistic - z) < 2e-6 and abs(t["flag"].p_value - math.erfc(abs(z) / math.sqrt(2))) < 2e-6
    assert t["flag"].statistic == t["bit"].statistic
    table = np.array([[(s == k).sum() for k in range(6)] for s in (ca, cb)], float)
    expect = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
    assert abs(t["cat"].statistic - ((table - expect) ** 2 / expect).sum()) < 2e-5 and t["cat"].drifted
    d = {r.feature: r for r in DT.distances(ref, cur, cols).collect()}
    assert abs(d["x-1"].distance - wasserstein_plain(a, b)) < 2e-6
    assert abs(d["cat"].distance - js_plain(table[0] / 700, table[1] / 400)) < 2e-6
    assert d["flag"].distance == d["bit"].distance and not d["flag"].drifted


def test_distribution_over_any_number_of_ranges(spark):
    a, b = samples(3, 500, 500)
    counts = DT.value_counts(spark.createDataFrame([(float(v),) for v in a], "x double"),
                             spark.createDataFrame([(float(v),) for v in b], "x double"), "x", DT.NUMBER)
    want = [tuple(r) for r in DT.distribution(counts, 1).orderBy("x").collect()]
    values = sorted({*a.tolist(), *b.tolist()})
    assert [w[3] for w in want] == [None, *values[:-1]]
    assert [w[4] for w in want] == [int((a < v).sum()) for v in values]
    for k in (2, 7, 300):
        assert [tuple(r) for r in DT.distribution(counts, k).orderBy("x").collect()] == want


def test_empty_and_constant_sides(spark):
    a, _ = samples(4, 60, 1)
    ref = frame(spark, a, a > 0, (a > 1).astype(int))
    none = ref.limit(0)
    cols = ["x-1", "flag", "cat"]
    for x, y in ((ref, none), (none, ref), (none, none)):
        assert not any(r.drifted or r.statistic is not None for r in DT.tests(x, y, cols).collect())
        assert not any(r.drifted or r.distance is not None for r in DT.distances(x, y, cols).collect())
    same = ref.withColumn("x-1", F.lit(2.5)).withColumn("flag", F.lit(True)).withColumn("cat", F.lit("a"))
    for r in DT.tests(same, same, cols).collect():
        assert r.statistic == 0 and r.p_value > 0.999 and not r.drifted
    assert all(r.distance == 0 for r in DT.distances(same, same, cols).collect())
