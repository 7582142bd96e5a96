"""Canonical projections of the test tables behave as documented."""

from pyspark.sql import functions as F

from riskweave.functions import identity as I
from riskweave.operators import risk
from riskweave.sources import views as V

SF01 = "/root/testdata/sf0.01"


def test_account_digit_parity(spark):
    tx = V.transactions(spark, SF01)
    bad = tx.where(I.nuban_valid(F.col("account"), F.col("bank_code")) != (F.pmod("event_id", F.lit(2)) == 0))
    assert bad.count() == 0


def test_rule_hits_at_sf001(spark):
    """Every rule branch is populated by the projection (counts of 10,000 events)."""
    r = risk.apply_rules(V.transactions(spark, SF01, with_velocity=True), velocity_threshold=2)
    got = {row.rule: row.n for row in r.select(F.explode("triggered_rules").alias("rule"))
           .groupBy("rule").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got["BVN_DETAILS_MISMATCH"] == 189 and got["USSD_SINGLE_LIMIT_EXCEEDED"] == 1841
    assert got["NIGHT_WINDOW_LARGE_TRANSFER"] == 247 and got["LOCATION_ANOMALY"] == 345
    assert got["NEW_DEVICE_HIGH_VALUE_TX"] == 162 and got["HIGH_TRANSACTION_VELOCITY"] > 0


def test_raw_tables_exercise_cleaning(spark):
    m = V.raw_money(spark, SF01)
    c = V.raw_card(spark, SF01)
    assert m.where(F.col("amount").isNull()).count() > 0
    assert m.where(F.col("type").isNull()).count() > 0
    assert c.where(F.col("ProductCD") == "U").count() > 0
    assert c.select("TransactionID").distinct().count() == c.count()
