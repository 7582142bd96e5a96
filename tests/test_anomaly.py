"""Isolation forest invariants and the z-score scorer."""

from pyspark.sql import functions as F

from riskweave.functions import scoring as S
from riskweave.operators.anomaly import isolation_scores
from riskweave.operators import risk
from riskweave.sources import views as V

SF = "/root/testdata/sf0.001"


def _features(spark):
    tx = V.transactions(spark, SF, with_velocity=True)
    return tx.select("transaction_id", *S.anomaly_features(
        F.col("amount"), F.col("ts"), F.col("channel"), F.col("location"), F.col("tx_count_last_hour")))


def test_isolation_invariants(spark):
    feats = _features(spark)
    out = isolation_scores(feats, feats, "transaction_id", n_trees=30)
    s = out.agg(F.min("anomaly_risk").alias("lo"), F.max("anomaly_risk").alias("hi"),
                F.avg((F.col("decision") < 0).cast("double")).alias("below"),
                F.count(F.lit(1)).alias("n")).first()
    assert 0.0 <= s.lo <= s.hi <= 1.0
    assert s.n == feats.count()
    # The offset is the 3 % quantile of the training scores.
    assert abs(s.below - 0.03) < 0.01
    again = isolation_scores(feats, feats, "transaction_id", n_trees=30)
    a = {r.transaction_id: r.iso_score for r in out.select("transaction_id", "iso_score").collect()}
    b = {r.transaction_id: r.iso_score for r in again.select("transaction_id", "iso_score").collect()}
    assert a == b


def test_zscore_tiers(spark):
    train = spark.createDataFrame([(v,) for v in [10.0, 20.0, 30.0, 40.0, 50.0]], "amount double")
    df = spark.createDataFrame([(30.0,), (30.0 + 14.2 * 2.5,), (30.0 + 14.2 * 3.5,)], "amount double")
    got = [r.anomaly_score for r in risk.zscore_anomaly(df, train).collect()]
    assert got == [0.15, 0.60, 0.85]
    const = spark.createDataFrame([(5.0,), (5.0,)], "amount double")
    r = risk.zscore_anomaly(spark.createDataFrame([(7.5,)], "amount double"), const).first()
    assert r.train_std == 1.0 and r.anomaly_score == 0.60
