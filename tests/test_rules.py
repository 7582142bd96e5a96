"""Rule truth table (boundaries for every rule) and decision tiers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskweave.operators import risk

SCHEMA = ("transaction_id string, amount double, channel string, location string, "
          "historical_locations array<string>, device_is_new boolean, tx_count_last_hour int, "
          "bvn_matched boolean, ts timestamp_ntz")


def row(tid, amount=1000.0, channel="WEB", hour=12, location="Lagos", hist=("Lagos",),
        new=False, vel=0, bvn=True):
    return (tid, amount, channel, location, list(hist) if hist is not None else None, new, vel, bvn,
            dt.datetime(2024, 1, 10, hour, 30) if hour is not None else None)


CASES = [
    (row("bvn", bvn=False), ["BVN_DETAILS_MISMATCH"], 0.9, "BLOCKED"),
    (row("ussd_over", 25000.0, "USSD"), ["USSD_SINGLE_LIMIT_EXCEEDED"], 0.85, "BLOCKED"),
    (row("ussd_at", 20000.0, "ussd"), [], 0.0, "APPROVED"),
    (row("ussd_just_over", 20000.01, "USSD"), ["USSD_SINGLE_LIMIT_EXCEEDED"], 0.85, "BLOCKED"),
    (row("night23", 500000.0, hour=23), ["NIGHT_WINDOW_LARGE_TRANSFER"], 0.65, "PENDING_OTP"),
    (row("night0", 500000.0, hour=0), ["NIGHT_WINDOW_LARGE_TRANSFER"], 0.65, "PENDING_OTP"),
    (row("night3", 500000.0, hour=3), ["NIGHT_WINDOW_LARGE_TRANSFER"], 0.65, "PENDING_OTP"),
    (row("hour4", 500000.0, hour=4), [], 0.0, "APPROVED"),
    (row("hour22", 500000.0, hour=22), [], 0.0, "APPROVED"),
    (row("night_small", 499999.99, hour=0), [], 0.0, "APPROVED"),
    (row("vel5", vel=5), ["HIGH_TRANSACTION_VELOCITY"], 0.7, "PENDING_OTP"),
    (row("vel4", vel=4), [], 0.0, "APPROVED"),
    (row("loc", location="London", hist=("Lagos", "Abuja")), ["LOCATION_ANOMALY"], 0.75, "PENDING_OTP"),
    (row("loc_case", location="lagos"), ["LOCATION_ANOMALY"], 0.75, "PENDING_OTP"),
    (row("dev", 100000.0, new=True), ["NEW_DEVICE_HIGH_VALUE_TX"], 0.5, "PENDING_OTP"),
    (row("dev_small", 99999.99, new=True), [], 0.0, "APPROVED"),
    (row("all", 600000.0, "USSD", hour=23, location="London", new=True, vel=7, bvn=False),
     ["BVN_DETAILS_MISMATCH", "USSD_SINGLE_LIMIT_EXCEEDED", "NIGHT_WINDOW_LARGE_TRANSFER",
      "HIGH_TRANSACTION_VELOCITY", "LOCATION_ANOMALY", "NEW_DEVICE_HIGH_VALUE_TX"], 0.9, "BLOCKED"),
    # NULLs take the event defaults; a NULL timestamp never fires the night rule.
    (("nulls", None, None, None, None, None, None, None, None), [], 0.0, "APPROVED"),
    (row("null_ts", 900000.0, hour=None), [], 0.0, "APPROVED"),
]


@pytest.fixture(scope="module")
def ruled(spark):
    df = spark.createDataFrame([c[0] for c in CASES], SCHEMA)
    out = risk.apply_rules(df).select("transaction_id", "triggered_rules", "rule_risk_score",
                                      "rule_decision")
    return {r["transaction_id"]: r for r in out.collect()}


@pytest.mark.parametrize("case", CASES, ids=[c[0][0] for c in CASES])
def test_truth_table(ruled, case):
    r = ruled[case[0][0]]
    assert list(r["triggered_rules"]) == case[1]
    assert r["rule_risk_score"] == pytest.approx(case[2])
    assert r["rule_decision"] == case[3]


def test_combined_and_alert_status(spark):
    from riskweave.functions import rules as R
    df = spark.createDataFrame([(0.3, 0.85), (0.6, 0.1), (None, 0.2)], "r double, a double")
    risk_c, dec = R.combined_decision(F.col("r"), F.col("a"))
    got = df.select(risk_c.alias("x"), dec.alias("d"), R.alert_status(risk_c).alias("s")).collect()
    assert [(g.x, g.d, g.s) for g in got] == [
        (0.85, "BLOCKED", "BLOCKED"), (0.6, "PENDING_OTP", "PENDING_OTP"), (0.2, "APPROVED", "PENDING_OTP")]
