"""Isolation forest anomaly score (M13) as Spark jobs.

1. Sample: each row is kept with probability ~ 2 * trees * 256 / N by a key
   hash, so the sample is bounded whatever N is.
2. Each sampled row is offered to every tree with a per-tree hash; a tree
   keeps its 256 smallest hashes (window over one tree: <= bounded rows).
3. ``groupBy(tree).applyInPandas`` grows one isolation tree per group.
4. The forest (trees x at most 511 nodes, bounded) is broadcast and a
   vectorised ``pandas_udf`` computes the mean path length per row.
5. The offset is the exact contamination quantile of the training scores
   (distributed quantile search), and the risk is clip(1 - (decision + 0.5)).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import key_uniform
from ..session import cut_lineage
from .stats import exact_quantile

ANOMALY_FEATURES = ["amount", "hour", "channel_encoded", "location_encoded", "tx_count_last_hour"]
TREE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()),
    T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()),
    T.StructField("right", T.IntegerType()),
    T.StructField("size", T.IntegerType()),
])


def _c(n: float) -> float:
    """Average path length of an unsuccessful search in a BST of n nodes."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    nodes = []  # feature, threshold, left, right, size

    def build(idx, depth):
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, len(idx)])
        if depth >= max_depth or len(idx) <= 1:
            return me
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            return me
        f = int(rng.choice(usable))
        t = float(rng.uniform(lo[f], hi[f]))
        left = idx[sub[:, f] < t]
        right = idx[sub[:, f] >= t]
        nodes[me][0], nodes[me][1] = f, t
        nodes[me][2] = build(left, depth + 1)
        nodes[me][3] = build(right, depth + 1)
        return me

    build(np.arange(len(x)), 0)
    return nodes


def _grow_group(max_samples: int, features: list[str]):
    max_depth = int(math.ceil(math.log2(max(max_samples, 2))))

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf[features].to_numpy(dtype=float)
        nodes = _grow(x, np.random.default_rng(42 + tree), max_depth)
        return pd.DataFrame({
            "tree": tree, "node": np.arange(len(nodes), dtype="int32"),
            "feature": [n[0] for n in nodes], "threshold": [n[1] for n in nodes],
            "left": [n[2] for n in nodes], "right": [n[3] for n in nodes],
            "size": [n[4] for n in nodes]}).astype({"feature": "int32", "left": "int32",
                                                     "right": "int32", "size": "int32"})
    return fn


def fit_forest(df: DataFrame, key: str, features=ANOMALY_FEATURES, n_trees: int = 100,
               max_samples: int = 256) -> tuple[pd.DataFrame, int]:
    """Grow the forest; returns the node table (bounded: trees x 511 rows) and n_sub."""
    n = df.count()
    n_sub = min(max_samples, n)
    frac = min(1.0, 2.0 * n_trees * n_sub / max(n, 1))
    sample = df.where(key_uniform(F.col(key), F.lit("iforest")) < frac).select(key, *features)
    offered = sample.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"))
    offered = offered.withColumn("__u", key_uniform(F.col(key), F.col("tree"), F.lit("tree")))
    w = Window.partitionBy("tree").orderBy("__u", key)
    picked = offered.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n_sub)
    forest = (picked.select("tree", *[F.col(f).cast("double") for f in features])
                    .groupBy("tree").applyInPandas(_grow_group(n_sub, list(features)), TREE_SCHEMA))
    return forest.toPandas(), n_sub


def _path_lengths(forest: pd.DataFrame, x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for _, t in forest.groupby("tree"):
        t = t.sort_values("node")
        feat, thr = t["feature"].to_numpy(), t["threshold"].to_numpy()
        left, right, size = t["left"].to_numpy(), t["right"].to_numpy(), t["size"].to_numpy()
        node = np.zeros(len(x), dtype=int)
        depth = np.zeros(len(x))
        active = feat[node] >= 0
        while active.any():
            idx = np.flatnonzero(active)
            nd = node[idx]
            go_left = x[idx, feat[nd]] < thr[nd]
            node[idx] = np.where(go_left, left[nd], right[nd])
            depth[idx] += 1
            active = feat[node] >= 0
        c_leaf = np.array([_c(s) for s in size])  # per node (<= 511), not per row
        total += depth + c_leaf[node]
    return total / forest["tree"].nunique()


def score_forest(df: DataFrame, forest: pd.DataFrame, n_sub: int,
                 features=ANOMALY_FEATURES) -> DataFrame:
    """Add ``iso_score`` = -2^(-E[h] / c(n_sub)) (higher = more normal)."""
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast(forest)
    cn = _c(n_sub)

    @F.pandas_udf(T.DoubleType())
    def iso(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        return pd.Series(-np.power(2.0, -_path_lengths(bc.value, x) / cn))

    return df.withColumn("iso_score", iso(*[F.col(f).cast("double") for f in features]))


def isolation_scores(train: DataFrame, df: DataFrame, key: str, contamination: float = 0.03,
                     n_trees: int = 100) -> DataFrame:
    """Risk in [0, 1] from an isolation forest fitted on ``train``."""
    forest, n_sub = fit_forest(train, key, n_trees=n_trees)
    # Scores are written once: the quantile search reads them several times and
    # the Python scorer should run once per row.
    scored = cut_lineage(score_forest(df, forest, n_sub))
    trained = scored if df is train else cut_lineage(
        score_forest(train, forest, n_sub).select("iso_score"))
    offset = exact_quantile(trained, "iso_score", contamination)
    decision = F.col("iso_score") - F.lit(offset)
    risk = F.least(F.greatest(F.lit(1.0) - (decision + 0.5), F.lit(0.0)), F.lit(1.0))
    return scored.select("*", decision.alias("decision"), risk.alias("anomaly_risk"))
