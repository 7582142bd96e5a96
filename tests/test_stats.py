"""Distributed statistics against numpy / brute force."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskweave.operators import drift as D
from riskweave.operators import metrics as M
from riskweave.operators.stats import exact_median, exact_quantile, mode_value
from riskweave.operators.velocity import windowed_count
from riskweave.sources import views as V

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("limit", [100000, 40])
def test_exact_quantiles(spark, limit):
    rng = np.random.default_rng(7)
    vals = np.round(rng.lognormal(3, 1.5, 5001), 2)
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,)], "x double")
    assert exact_median(df, "x", collect_limit=limit, buckets=8) == pytest.approx(float(np.median(vals)))
    for q in (0.03, 0.5, 0.95):
        assert exact_quantile(df, "x", q, collect_limit=limit, buckets=8) == \
            pytest.approx(float(np.quantile(vals, q)))


def test_mode_smallest_on_tie(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "c string")
    assert df.select(mode_value(df, "c").alias("m")).first().m == "a"


def test_bucketed_velocity_equals_plain_window(spark):
    tx = V.transactions(spark, SF)
    got = windowed_count(tx, ["sender"], "ts", 3600, "n", bucket_seconds=600)
    w = (Window.partitionBy("sender").orderBy(F.unix_micros(F.col("ts").cast("timestamp")))
         .rangeBetween(-3600 * 1_000_000, 0))
    want = tx.withColumn("n", (F.count(F.lit(1)).over(w) - 1).cast("int"))
    a = {r.transaction_id: r.n for r in got.select("transaction_id", "n").collect()}
    b = {r.transaction_id: r.n for r in want.select("transaction_id", "n").collect()}
    assert a == b


def test_psi_identical_is_zero(spark):
    df = spark.createDataFrame([(float(i % 17), i % 2) for i in range(500)], "amount double, channel_DEBIT int")
    p = D.psi(df, df, ["amount", "channel_DEBIT"]).collect()
    assert all(abs(r.psi) < 1e-12 and not r.drifted for r in p)


def test_auc_against_brute_force(spark):
    rng = np.random.default_rng(3)
    s = np.round(rng.random(400), 2)
    y = (rng.random(400) < s).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "probability double, is_fraud int")
    got = M.auc(df).first().auc_roc
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert got == pytest.approx(want, abs=1e-6)


def test_velocity_hot_sender_is_split(spark):
    """One sender holds a third of all rows: results equal the plain window and
    no window partition holds more than ~2 buckets of that sender's rows."""
    import datetime as dt
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(9000):
        sender = 1 if i % 3 == 0 else 2 + i % 50
        rows.append((f"T{i}", sender, base + dt.timedelta(seconds=37 * i)))
    df = spark.createDataFrame(rows, "transaction_id string, sender long, ts timestamp_ntz")
    got = windowed_count(df, ["sender"], "ts", 3600, "n", bucket_seconds=3600)
    w = (Window.partitionBy("sender").orderBy(F.unix_micros(F.col("ts").cast("timestamp")))
         .rangeBetween(-3600 * 1_000_000, 0))
    want = df.withColumn("n", (F.count(F.lit(1)).over(w) - 1).cast("int"))
    a = {r.transaction_id: r.n for r in got.collect()}
    b = {r.transaction_id: r.n for r in want.collect()}
    assert a == b
    hot = df.where("sender = 1").count()
    per_bucket = (df.where("sender = 1")
                    .groupBy(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600))
                    .count().agg(F.max("count")).first()[0])
    assert 2 * per_bucket < hot / 10


def test_retrain_reasons_text(spark):
    m = spark.createDataFrame([(0.1234,)], "f1_score double")
    v = spark.createDataFrame([(0.384615, True, ["amount", "channel_DEBIT"])],
                              "drift_share double, drift_detected boolean, drifted_features array<string>")
    r = D.retrain_decision(m, v).first()
    assert r.retrain is True
    assert r.reason == ("F1-score (0.1234) below threshold (0.85) | Data drift detected: 38.5% of "
                        "features drifted (threshold=30%). Drifted: ['amount', 'channel_DEBIT']")
    ok = D.retrain_decision(spark.createDataFrame([(0.9,)], "f1_score double"),
                            v.withColumn("drift_detected", F.lit(False))).first()
    assert ok.retrain is False and ok.reason == "No drift or performance degradation detected"
    forced = D.retrain_decision(spark.createDataFrame([(0.9,)], "f1_score double"),
                                v.withColumn("drift_detected", F.lit(False)), force=True).first()
    assert forced.retrain is True and forced.reason == "Manual force retrain requested by operator"


def _np_psi(ref, cur, bins=10, eps=1e-6):
    lo, hi = min(ref.min(), cur.min()), max(ref.max(), cur.max())
    if hi == lo:
        return 0.0
    edges = np.linspace(lo, hi, bins + 1)
    r = (np.histogram(ref, bins=edges)[0] + eps) / (len(ref) + eps * bins)
    c = (np.histogram(cur, bins=edges)[0] + eps) / (len(cur) + eps * bins)
    return float(np.sum((c - r) * np.log(c / r)))


def test_psi_matches_histogram_formula(spark):
    rng = np.random.default_rng(11)
    ref = rng.normal(0, 1, 3000)
    cur = rng.normal(0.4, 1.3, 2000)
    flag_r = (rng.random(3000) < 0.3).astype(float)
    flag_c = (rng.random(2000) < 0.6).astype(float)
    a = spark.createDataFrame([(float(x), float(f)) for x, f in zip(ref, flag_r)], "amount double, channel_DEBIT double")
    b = spark.createDataFrame([(float(x), float(f)) for x, f in zip(cur, flag_c)], "amount double, channel_DEBIT double")
    got = {r.feature: r.psi for r in D.psi(a, b, ["amount", "channel_DEBIT"]).collect()}
    assert got["amount"] == pytest.approx(_np_psi(ref, cur), abs=1e-6)
    assert got["channel_DEBIT"] == pytest.approx(_np_psi(flag_r, flag_c), abs=1e-6)


def test_drift_verdict_positive(spark):
    from riskweave import config as C
    rng = np.random.default_rng(5)
    def frame(shift):
        rows = []
        for _ in range(800):
            vals = [float(rng.random())] + [0.0] * (len(C.FEATURES) - 1)
            for j in range(1, 5):          # four channel flags flip with the shift
                vals[j] = float(rng.random() < (0.8 if shift else 0.1))
            rows.append(tuple(vals))
        return spark.createDataFrame(rows, ", ".join(f"`{f}` double" for f in C.FEATURES))
    v = D.drift_verdict(D.psi(frame(False), frame(True))).first()
    assert v.n_drifted == 4 and v.drift_detected
    assert list(v.drifted_features) == C.FEATURES[1:5]
    assert v.drift_share == round(4 / 13, 6)
