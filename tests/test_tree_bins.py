"""Trees on counted bin patterns: every row counts, and the model is that of the single binned rows."""

import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskweave.operators import models as MD

FEATURES = ["amount", "flag-a"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = []
    for i in range(600):
        x, f = rng.choice([rng.random(), 0.5]), float(rng.random() < 0.01)
        out.append((f"T{i}", x if i % 50 else None, f, int(rng.random() < (0.8 if x > 0.4 or f else 0.2))))
    return spark.createDataFrame(out, "transaction_id string, amount double, `flag-a` double, is_fraud int").persist()


def test_counted_patterns_give_the_model_of_the_single_rows(spark, rows):
    params = {"maxIter": 3, "maxDepth": 3}
    model = MD.fit(rows, "gbt", features=FEATURES, params=params)
    bucket = model.stages[0]
    assert isinstance(bucket, Bucketizer)
    # a rare flag and the missing amounts have bins of their own
    binned, cols = MD.tree_inputs(model, rows, FEATURES)
    seen = {tuple(r) for r in binned.select("flag-a", cols[1]).distinct().collect()}
    assert len(seen) == 2 and len({b for _, b in seen}) == 2
    top = len(bucket.getSplitsArray()[0]) - 1
    assert {r[0] for r in binned.where(F.isnan("amount")).select(cols[0]).distinct().collect()} == {float(top)}
    bare = binned.select("transaction_id", F.col("is_fraud").cast("double").alias("y"),
                         *[F.col(c).alias(f"b{i}", metadata={}) for i, c in enumerate(cols)])
    plain = Pipeline(stages=[VectorAssembler(inputCols=["b0", "b1"], outputCol="features", handleInvalid="keep"),
                             GBTClassifier(labelCol="y", seed=42, maxBins=34, **params)]).fit(bare)
    want = {r.transaction_id: r.p for r in plain.transform(bare).select(
        "transaction_id", vector_to_array("probability")[1].alias("p")).collect()}
    got = {r.transaction_id: r.probability for r in MD.score(model, rows, features=FEATURES).collect()}
    assert len(got) == 600 and max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_blocks_hold_every_row(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 3), (1.0, 0.0, 1000), (1.0, 1.0, 900_001)], "b double, y double, __n long")
    got = {(r.b, r.y): r for r in MD.drawn_blocks(rows, 901_004).groupBy("b", "y").agg(
        F.sum("__n").alias("n"), F.count("*").alias("blocks"), F.max("__n").alias("most")).collect()}
    assert {k: r.n for k, r in got.items()} == {(0.0, 0.0): 3, (1.0, 0.0): 1000, (1.0, 1.0): 900_001}
    assert got[0.0, 0.0].blocks == 3 and got[1.0, 0.0].blocks >= 64 and got[1.0, 1.0].most <= 2
