"""Additive scorer: contributions sum to the log-odds; threshold property."""

import math

import pytest
from pyspark.sql import functions as F

from riskweave import config as C
from riskweave.functions import scoring as S


def _score(spark, cutoff):
    feats = {n: 0 for n in C.FEATURES}
    feats.update({"amount": 0.65, "channel_TRANSFER": 1, "source_dataset_PaySim": 1})
    df = spark.createDataFrame([tuple(float(feats[n]) for n in C.FEATURES)],
                               ", ".join(f"`{n}` double" for n in C.FEATURES))
    contribs = S.logodds_contributions({n: F.col(f"`{n}`") for n in C.FEATURES})
    lo, p, pred = S.logodds_score(contribs, cutoff)
    total = sum_cols = None
    for _, c in contribs:
        sum_cols = c if sum_cols is None else sum_cols + c
    return df.select(lo.alias("lo"), p.alias("p"), pred.alias("pred"), sum_cols.alias("s")).first()


def test_logodds_value(spark):
    r = _score(spark, 0.5)
    assert r.lo == pytest.approx(1.0215)
    assert r.p == pytest.approx(1 / (1 + math.exp(-1.0215)))
    assert r.lo == pytest.approx(C.LOGODDS_BASE + r.s)


def test_threshold_property(spark):
    p = _score(spark, 0.5).p
    assert _score(spark, p + (1 - p) / 2).pred == 0
    assert _score(spark, p / 2).pred == 1
