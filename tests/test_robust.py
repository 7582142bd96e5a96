"""Inputs that the test tables never hold: NaN, heavy values, ties, hot keys, other file systems."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskweave.operators import audit, balance, drift, quality, stats, velocity
from riskweave.sources.sinks import first_existing
from riskweave.streaming import scoring


def test_quantiles_of_heavy_and_infinite_values(spark, monkeypatch):
    got = []
    real = type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda self: got.append(len(r := real(self))) or r)
    half = spark.range(2000).select((F.col("id") % 2).cast("double").alias("x"))
    assert stats.exact_median(half, "x", collect_limit=10, buckets=4) == 0.5
    assert max(got) <= 10
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.lognormal(0, 5, 900), np.full(700, 3.25), [math.inf] * 9, [-math.inf] * 5, [1e308, -1e308]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double")
    for q in (0.0, 0.02, 0.25, 0.5, 0.77, 0.95):
        h = (len(values) - 1) * q
        s = np.sort(values)
        want = s[int(h)] if s[int(h)] == s[min(int(h) + 1, len(s) - 1)] else s[int(h)] + (s[int(h) + 1] - s[int(h)]) * (h - int(h))
        assert stats.exact_quantile(df, "x", q, collect_limit=20, buckets=8) == pytest.approx(want)
    assert stats.exact_quantile(df, "x", 1.0, 20, 8) == math.inf


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, 3.0), (4, None)], "id long, amount double")
    assert [r.amount for r in quality.impute(df, ["amount"], []).orderBy("id").collect()] == [1.0, 2.0, 3.0, 2.0]
    assert [r.amount for r in stats.min_max_scale(df, "amount").orderBy("id").collect()] == [0.0, None, 1.0, None]
    rows = spark.createDataFrame([(1, "X", float("nan"), 0, None), (1, "X", 2.0, 1, "n")],
                                 "step int, type string, amount double, isFraud int, nameOrig string")
    v = [r.violations for r in quality.validate(rows, quality.money_checks(rows.columns)).collect()]
    assert v == [["nameOrig_required", "amount_required"], []]
    ref = spark.createDataFrame([(float(i),) for i in range(20)] + [(float("nan"),)], "amount double")
    got = drift.psi(ref, ref, ["amount"]).first()
    assert got.psi == 0.0 and not got.drifted


def test_psi_bins_follow_the_edge_array(spark):
    ref = spark.createDataFrame([(i / 10,) for i in range(11)], "amount double")
    row = drift.bin_counts(ref, ref, ["amount"]).first()
    want = np.histogram([i / 10 for i in range(11)], bins=np.linspace(0, 1, 11))[0].tolist()
    assert [row[f"r{i}"] for i in range(10)] == want == [row[f"c{i}"] for i in range(10)]


def test_chi2_p_value(spark):
    rows = spark.createDataFrame([("a", 3.841, 1), ("b", 16.919, 9), ("c", 2.0, 9), ("d", 0.0, 0)],
                                 "feature string, chi2 double, dof int")
    p = {r.feature: r.p_value for r in drift.chi2_test(rows).collect()}
    assert p["a"] == pytest.approx(0.05, abs=0.006) and p["b"] == pytest.approx(0.05, abs=0.002)
    assert p["c"] > 0.9 and p["d"] == 1.0


def test_velocity_ties_edges_and_hot_sender(spark):
    rng = np.random.default_rng(1)
    base = dt.datetime(2024, 1, 1)
    sec = np.sort(rng.integers(0, 9000, 1500))
    rows = [(i, 1 if i % 10 else 2, base + dt.timedelta(seconds=int(s))) for i, s in enumerate(sec)]
    df = spark.createDataFrame(rows, "id long, sender long, ts timestamp")
    got = {r.id: r.n for r in velocity.windowed_count(df, ["sender"], "ts", 3600, "n").collect()}
    for i, s, t in rows:
        want = sum(1 for _, s2, t2 in rows if s2 == s and t - dt.timedelta(seconds=3600) <= t2 <= t) - 1
        assert got[i] == want


def test_stream_velocity_counts_ties_and_any_order():
    class State:
        exists, hasTimedOut, kept = False, False, None
        get = property(lambda self: self.kept)

        def update(self, v):
            self.kept, self.exists = v, True

        def setTimeoutTimestamp(self, t):
            pass
    at = pd.to_datetime(["2024-01-01 10:30", "2024-01-01 10:00", "2024-01-01 10:30"])
    frame = pd.DataFrame({"transaction_id": ["a", "b", "c"], "sender": [1, 1, 1], "ts": at})
    fn, state = scoring._velocity_fn(3_600_000_000), State()
    out = pd.concat(fn((1,), iter([frame.iloc[:1], frame.iloc[1:]]), state))
    assert dict(zip(out.transaction_id, out.tx_count_last_hour)) == {"a": 2, "b": 0, "c": 2}
    later = pd.DataFrame({"transaction_id": ["d"], "sender": [1], "ts": pd.to_datetime(["2024-01-01 11:10"])})
    assert next(fn((1,), iter([later]), state)).tx_count_last_hour.tolist() == [2]


def test_audit_on_a_uri_root(spark, scratch):
    root = f"file://{scratch}/audit"
    assert audit.recent(spark, root, "drift_checks").count() == 0
    audit.append(spark, root, "drift_checks", {"f1_score": 0.7})
    assert audit.last_f1(spark, root).first()[0] == 0.7
    assert audit.recent(spark, root, "drift_checks").count() == 1
    assert first_existing(f"file://{scratch}/none", f"file://{scratch}") == f"file://{scratch}"


def test_stratified_split_keeps_the_class_shares(spark):
    df = spark.range(1000).select(F.concat(F.lit("T"), F.col("id")).alias("transaction_id"),
                                  (F.col("id") % 20 == 0).cast("int").alias("is_fraud"))
    got = {(r.is_fraud, r.is_train): r["count"] for r in balance.stratified_split(df).groupBy("is_fraud", "is_train").count().collect()}
    assert got == {(1, True): 40, (1, False): 10, (0, True): 760, (0, False): 190}


def test_failed_drift_check_leaves_an_audit_row(spark, scratch):
    from riskweave.operators import jobs
    bad = spark.createDataFrame([(1, 0.5, 1)], "is_fraud int, probability double, prediction int")
    empty = spark.createDataFrame([(1,)], "nothing int")
    with pytest.raises(Exception):
        jobs.drift_check(bad, empty, empty, scratch)
    row = audit.recent(spark, scratch, "drift_checks").first()
    assert row.error and row.check_type == "scheduled"
