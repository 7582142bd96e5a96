"""Exact per-row contributions for tree ensembles (M14, path-dependent TreeSHAP).

The fitted ensemble is written to the shared checkpoint folder and its node
table read back (trees x nodes rows, bounded by the model, not the data).
Each leaf is turned into (value, per-feature cover fraction z, per-feature
conditions); a row's contribution from one leaf only involves the distinct
features on that leaf's path, U:

    phi_i += v * (o_i - z_i) * sum_s c(s) * e_s(o, z; U \\ {i}),
    c(s) = s! (|U| - s - 1)! / |U|!,

where o_j says whether the row satisfies all of feature j's splits on the
path and e_s is the coefficient of t^s in prod_j (z_j + o_j t).  This is the
Shapley value of the path-dependent conditional expectation, computed with
numpy over a whole Arrow batch in ``mapInPandas``; the base value is the
cover-weighted mean leaf value.  Contributions + base = raw margin.
"""

from __future__ import annotations

import math
import os
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir


def _node_table(model) -> pd.DataFrame:
    from pyspark.sql import SparkSession
    s = SparkSession.getActiveSession()
    path = os.path.join(ensure_checkpoint_dir(s), "models", uuid.uuid4().hex)
    model.write().overwrite().save(path)
    nodes = s.read.parquet(os.path.join(path, "data")).select(
        "treeID", F.col("nodeData.id").alias("id"), F.col("nodeData.prediction").alias("value"),
        F.col("nodeData.impurityStats")[0].alias("cover"),
        F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.col("nodeData.split.leftCategoriesOrThreshold").alias("thr"),
        F.col("nodeData.split.numCategories").alias("ncat"))
    return nodes.toPandas()


def leaves(model) -> tuple[list, float]:
    """Leaf list [(weight * value, {feature: (z, [(thr, go_left)])})] and the base value."""
    nodes = _node_table(model)
    if (nodes["ncat"] > 0).any():
        raise ValueError("categorical splits are not supported")
    weights = list(model.treeWeights) if hasattr(model, "treeWeights") else [1.0]
    out, base = [], 0.0
    for tid, t in nodes.groupby("treeID"):
        w = weights[int(tid)]
        by_id = {int(r.id): r for r in t.itertuples()}

        def walk(nid, path):
            nonlocal base
            n = by_id[nid]
            if n.left < 0:
                feats = {}
                for f, thr, go_left, ratio in path:
                    z, conds = feats.get(f, (1.0, []))
                    feats[f] = (z * ratio, conds + [(thr, go_left)])
                z_all = math.prod(z for z, _ in feats.values())
                base_part = w * n.value * z_all
                out.append((w * n.value, feats))
                return base_part
            thr = float(n.thr[0])
            lc, rc = by_id[int(n.left)], by_id[int(n.right)]
            return (walk(int(n.left), path + [(int(n.feature), thr, True, lc.cover / n.cover)])
                    + walk(int(n.right), path + [(int(n.feature), thr, False, rc.cover / n.cover)]))

        base += walk(0, [])
    return out, base


def _contrib(x: np.ndarray, leaf_list, n_features: int) -> np.ndarray:
    phi = np.zeros((len(x), n_features))
    for v, feats in leaf_list:
        fs = list(feats)
        u = len(fs)
        if u == 0:
            continue
        zs = np.array([feats[f][0] for f in fs])
        os_ = []
        for f in fs:
            ok = np.ones(len(x), dtype=bool)
            for thr, go_left in feats[f][1]:
                ok &= (x[:, f] <= thr) if go_left else (x[:, f] > thr)
            os_.append(ok.astype(float))
        coef = [math.factorial(s) * math.factorial(u - s - 1) / math.factorial(u) for s in range(u)]
        for a, f in enumerate(fs):
            # e_s over the other features, as vectors over rows.
            e = [np.ones(len(x))] + [np.zeros(len(x)) for _ in range(u - 1)]
            deg = 0
            for b in range(u):
                if b == a:
                    continue
                deg += 1
                for s in range(deg, 0, -1):
                    e[s] = e[s] * zs[b] + e[s - 1] * os_[b]
                e[0] = e[0] * zs[b]
            total = sum(coef[s] * e[s] for s in range(u))
            phi[:, f] += v * (os_[a] - zs[a]) * total
    return phi


def explain(df: DataFrame, model, feature_cols: list[str], names: list[str], key: str,
            scale: float = 2.0) -> DataFrame:
    """Per-row contributions of a tree-ensemble margin, in log-odds units.

    ``scale`` = 2 for boosted trees (probability = sigmoid(2 * margin)).
    Output: key, base_value, contributions map, raw_log_odds (sum check).
    """
    leaf_list, base = leaves(model)
    bc = df.sparkSession.sparkContext.broadcast(leaf_list)
    n = len(feature_cols)
    schema = T.StructType([T.StructField(key, df.schema[key].dataType),
                           T.StructField("phi", T.ArrayType(T.DoubleType()))])

    def fn(it):
        for pdf in it:
            x = pdf[feature_cols].to_numpy(dtype=float)
            phi = _contrib(x, bc.value, n) * scale
            yield pd.DataFrame({key: pdf[key].values, "phi": list(phi)})

    out = df.select(key, *feature_cols).mapInPandas(fn, schema)
    m = F.map_from_arrays(F.array(*[F.lit(nm) for nm in names]), F.col("phi"))
    total = F.aggregate("phi", F.lit(0.0), lambda a, b: a + b)
    return out.select(key, F.lit(base * scale).alias("base_value"), m.alias("contributions"),
                      (F.lit(base * scale) + total).alias("raw_log_odds"))
