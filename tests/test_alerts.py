"""Alert explanations: top reasons order, waterfall end point, message shape."""

from pyspark.sql import functions as F

from riskweave import config as C
from riskweave.operators import alerts as A

SF = "/root/testdata/sf0.001"


def _alerts(spark):
    from riskweave.plans import registry
    registry.load_all()
    from riskweave.plans.q_alerts import alerts_df, scored_tx
    return alerts_df(spark, SF), scored_tx(spark, SF)


def test_top_reasons_order_and_ties(spark):
    m = {n: 0.0 for n in C.FEATURES}
    m.update({"amount": 0.3, "channel_CARD_WEB": -0.25, "channel_CASH_OUT": -0.2,
              "channel_DEBIT": 0.2, "channel_TRANSFER": 0.75, "source_dataset_PaySim": 0.4})
    df = spark.createDataFrame([("A1", m)], "alert_id string, shap_values map<string,double>")
    got = [(r["rank"], r.feature, r.direction, r.impact_pct) for r in A.top_reasons(df, 4).collect()]
    # |0.75| > |0.4| > |0.3| > |-0.25|; ties would keep feature order.
    assert got == [(1, "Channel: TRANSFER", "INCREASES", "75.00%"),
                   (2, "Pipeline: PaySim", "INCREASES", "40.00%"),
                   (3, "amount", "INCREASES", "30.00%"),
                   (4, "Channel: CARD_WEB", "DECREASES", "25.00%")]
    tie = dict(m, channel_DEBIT=0.2, channel_CASH_OUT=-0.2)
    df2 = spark.createDataFrame([("A2", tie)], "alert_id string, shap_values map<string,double>")
    order = [r.feature for r in A.top_reasons(df2, 6).orderBy("rank").collect()]
    assert order.index("Channel: CASH_OUT") < order.index("Channel: DEBIT")


def test_waterfall_ends_at_log_odds(spark):
    alerts, scored = _alerts(spark)
    wf = A.waterfall(alerts)
    last = wf.where(F.col("step") == 9).select("alert_id", "running_log_odds")
    lo = scored.select(A.alert_id(F.col("transaction_id")).alias("alert_id"), "log_odds")
    j = last.join(lo, "alert_id").select(F.max(F.abs(F.col("running_log_odds") - F.col("log_odds"))).alias("e"))
    assert j.first().e < 1e-9
    assert wf.groupBy("alert_id").count().where("count <> 11").count() == 0


def test_outbox_message_shape(spark):
    alerts, _ = _alerts(spark)
    out = A.outbox(alerts).collect()
    assert out
    for r in out[:20]:
        lines = r.message.split("\n")
        assert lines[0] == "[riskweave] FRAUD ALERT" and lines[1].startswith("Tx: TXN")
        assert lines[2].startswith("Amount: NGN ") and lines[6] == "Top Risk Factors:"
        assert len(lines) == 11 and lines[-1].startswith("-- Auto-blocked")
