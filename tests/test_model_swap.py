"""A running stream takes a newly published model with its next micro-batch."""

import os
import time

import pytest
from pyspark.sql import functions as F

from riskweave import config as C
from riskweave.functions import scoring as S
from riskweave.operators import models as MD
from riskweave.sources import views as V
from riskweave.sources.tables import EVENT_SCHEMA
from riskweave.streaming import scoring as ST

SF = "/root/testdata/sf0.001"


def _model(spark, iterations):
    tx = V.transactions(spark, SF)
    fm = S.event_feature_map(F.col("amount"), F.col("channel"))
    train = tx.select("transaction_id", "is_fraud", *[fm[f].cast("double").alias(f) for f in C.FEATURES])
    return MD.fit(train, "lr", params={"maxIter": iterations})


def _events(spark):
    tx = V.transactions(spark, SF, with_velocity=True).orderBy("transaction_id").limit(90)
    return tx.select(*[F.col(f.name).cast(f.dataType) if f.name in tx.columns else
                       F.lit(None).cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA.fields]).persist()


@pytest.mark.parametrize("past", [False, True])
def test_swap_between_batches_without_a_restart(spark, scratch, past):
    src, out, root = (os.path.join(scratch, n) for n in ("events", "out", "models"))
    events = _events(spark)
    ids = [r.transaction_id for r in events.select("transaction_id").orderBy("transaction_id").collect()]

    def send(lo, hi):
        events.where(F.col("transaction_id").isin(ids[lo:hi])).coalesce(1).write.mode("append").json(src)
        time.sleep(1.1)

    send(0, 30)
    q = ST.start_scoring(ST.event_stream(spark, src), out, os.path.join(scratch, "ck"), available_now=False,
                         interval="200 milliseconds", scorer=MD.Published(root), past=past)
    try:
        q.processAllAvailable()
        versions, fitted = [None], [None]
        for lo, iterations in ((30, 1), (60, 20)):
            fitted.append(_model(spark, iterations))
            versions.append(MD.publish(spark, root, MD.save(fitted[-1], root, "lr")))
            send(lo, lo + 30)
            q.processAllAvailable()
    finally:
        q.stop()
    rows = spark.read.parquet(os.path.join(out, "scored")).collect()
    got = {r.transaction_id: (r.model_version, r.probability) for r in rows}
    assert len(rows) == 90
    for i, (version, model) in enumerate(zip(versions, fitted)):
        part = events.where(F.col("transaction_id").isin(ids[30 * i:30 * i + 30]))
        want = {r.transaction_id: r.probability
                for r in ST.score_events(part, scorer="rules" if model is None else model).collect()}
        for t in ids[30 * i:30 * i + 30]:
            assert got[t][0] == version
            if model is not None:
                assert got[t][1] == want[t]


def test_published(spark, scratch):
    p = MD.Published(scratch)
    assert p.current(spark) == (None, None)
    first = MD.publish(spark, scratch, MD.save(_model(spark, 1), scratch, "lr"))
    version, model = p.current(spark)
    assert version == first and p.current(spark)[1] is model            # loaded once
    # a pointer to a model that is not there keeps the one before
    broken = MD.publish(spark, scratch, os.path.join(scratch, "nothing"))
    assert broken > first
    assert p.current(spark) == (first, model) and broken in p.error
    third = MD.publish(spark, scratch, MD.save(_model(spark, 2), scratch, "lr"))
    assert p.current(spark)[0] == third and p.error is None
