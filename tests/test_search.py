"""A parameter search that is started again runs only the trials that are missing."""

import os

from pyspark.sql import functions as F

from riskweave import config as C
from riskweave.operators import models as MD


def test_search_resumes_and_runs_trials_side_by_side(spark, scratch, monkeypatch):
    rows = spark.range(60).select(
        F.concat(F.lit("T"), "id").alias("transaction_id"), (F.col("id") % 2).cast("int").alias("is_fraud"),
        *[((F.col("id") * (i + 3)) % 11 / 11 + F.col("id") % 2).alias(f) for i, f in enumerate(C.FEATURES)],
        F.floor(F.col("id") / 2 % 2).cast("int").alias("fold")).persist()
    space = {"maxIter": ("int", 1, 8), "regParam": ("log", 0.001, 1.0)}
    fitted = []
    plain = MD.fit
    monkeypatch.setattr(MD, "fit", lambda *a, **k: fitted.append(k["params"]) or plain(*a, **k))
    table = os.path.join(scratch, "search")
    first = MD.random_search(rows, "lr", space, 2, 2, results=table, parallel=2).collect()
    assert len(fitted) == 4 and [r.trial for r in first] == [0, 1]
    # one more trial: the two that are there are not run again
    more = MD.random_search(rows, "lr", space, 3, 2, results=table).collect()
    assert len(fitted) == 6 and more[:2] == first and len(more) == 3
    # another seed samples other parameters, so its trials are new
    assert more == MD.random_search(rows, "lr", space, 3, 2, results=table).collect() and len(fitted) == 6
    other = MD.random_search(rows, "lr", space, 1, 2, results=table, seed=7).collect()
    assert len(fitted) == 8 and other[0].params != first[0].params
