"""Report tables on hand-made inputs: calendar gaps, geo names, arg-max ties, KPIs."""

import datetime as dt

from riskweave.operators import reports as RP
from riskweave.sources.dims import geo


def test_daily_trend_fills_empty_days(spark):
    tx = spark.createDataFrame([(dt.datetime(2024, 1, d, 10),) for d in (1, 1, 2, 5)], "ts timestamp_ntz")
    fl = spark.createDataFrame([(dt.datetime(2024, 1, 5, 11),)], "timestamp timestamp_ntz")
    got = [(r.day.day, r.total, r.flagged) for r in RP.daily_trend(tx, fl).orderBy("day").collect()]
    assert got == [(1, 2, 0), (2, 1, 0), (3, 0, 0), (4, 0, 0), (5, 1, 1)]


def test_geo_and_top_value(spark):
    alerts = spark.createDataFrame(
        [("Abuja", 10.0, "WEB"), ("Abuja", 5.0, "POS"), ("London", 1.0, "POS"), ("Lagos", 2.0, "WEB")],
        "location string, amount double, channel string")
    g = {r.location: (r.state, r.incidents) for r in RP.geo_incidents(alerts, geo(spark)).collect()}
    assert g["Abuja"] == ("Abuja (FCT)", 2) and g["London"] == (None, 1) and g["Lagos"] == ("Lagos", 1)
    top = RP.top_value(alerts, "channel").first()
    assert (top.value, top.n) == ("POS", 2)   # POS and WEB tie at 2: alphabetical first


def test_alert_kpis_empty_and_full(spark):
    schema = "amount double, status string, risk_score double"
    empty = RP.alert_kpis(spark.createDataFrame([], schema)).first()
    assert empty.n_alerts == 0 and empty.total_amount_flagged == 0.0 and empty.avg_risk == 0.0
    rows = [(100.0, "BLOCKED", 0.9), (50.5, "PENDING_OTP", 0.6)]
    k = RP.alert_kpis(spark.createDataFrame(rows, schema)).first()
    assert (k.n_alerts, k.total_amount_flagged, k.blocked, k.pending, k.avg_risk, k.high_risk) == \
        (2, 150.5, 1, 1, 0.75, 1)


def test_bank_summary_unknown_code(spark):
    from riskweave.sources.dims import banks
    tx = spark.createDataFrame([("058", "0110000001"), ("058", "0110000002"), ("999", "0000000000")],
                               "bank_code string, account string")
    got = {r.bank_code: (r.bank_name, r.n_transactions, r.n_valid_accounts)
           for r in RP.bank_summary(tx, banks(spark)).collect()}
    assert got["058"] == ("Guaranty Trust Bank (GTBank)", 2, 1)
    assert got["999"][0] == "Unknown Bank"
