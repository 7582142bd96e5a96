"""Tree contributions: sum to the margin and equal brute-force Shapley values."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskweave.operators import explain as X


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(5)
    rows = [(i, rng.random(), rng.random(), float(rng.randint(0, 3)),
             float(rng.random() < 0.3)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double")
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    model = GBTClassifier(labelCol="y", maxIter=4, maxDepth=3, seed=1).fit(df)
    return df, model


def test_sum_to_margin(spark, fitted):
    df, model = fitted
    ex = X.explain(df, model, ["a", "b", "c"], ["a", "b", "c"], "id")
    raw = model.transform(df).select("id", (vector_to_array("rawPrediction")[1] * 2).alias("m"))
    j = ex.join(raw, "id").select(F.max(F.abs(F.col("raw_log_odds") - F.col("m"))).alias("err")).first()
    assert j.err < 1e-6


def _cond_exp(nodes_by_id, x, S, nid=0):
    n = nodes_by_id[nid]
    if n["left"] < 0:
        return n["value"]
    f, thr = n["feature"], n["thr"]
    if f in S:
        nxt = n["left"] if x[f] <= thr else n["right"]
        return _cond_exp(nodes_by_id, x, S, nxt)
    l, r = nodes_by_id[n["left"]], nodes_by_id[n["right"]]
    return (l["cover"] * _cond_exp(nodes_by_id, x, S, n["left"])
            + r["cover"] * _cond_exp(nodes_by_id, x, S, n["right"])) / n["cover"]


def test_brute_force_shapley(spark, fitted):
    df, model = fitted
    nodes = X._node_table(model)
    trees = {}
    for tid, t in nodes.groupby("treeID"):
        trees[int(tid)] = {int(r.id): {"value": r.value, "cover": r.cover, "left": int(r.left),
                                       "right": int(r.right), "feature": int(r.feature),
                                       "thr": float(r.thr[0]) if len(r.thr) else 0.0}
                           for r in t.itertuples()}
    w = model.treeWeights
    leaf_list, _ = X.leaves(model)
    xs = np.array([[r.a, r.b, r.c] for r in df.limit(5).collect()])
    phi = X._contrib(xs, leaf_list, 3)
    for k, x in enumerate(xs):
        for i in range(3):
            others = [j for j in range(3) if j != i]
            val = 0.0
            for size in range(3):
                for S in itertools.combinations(others, size):
                    c = math.factorial(size) * math.factorial(3 - size - 1) / math.factorial(3)
                    f = lambda s: sum(w[t] * _cond_exp(trees[t], x, set(s)) for t in trees)
                    val += c * (f(S + (i,)) - f(S))
            assert phi[k, i] == pytest.approx(val, abs=1e-9)
