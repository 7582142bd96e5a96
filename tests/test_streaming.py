"""Batch = stream; restart from checkpoint adds nothing; stateful velocity is exact."""

import os
import time

from pyspark.sql import functions as F

from riskweave.operators import alerts as A
from riskweave.operators import risk
from riskweave.functions import scoring as S
from riskweave.sources import views as V
from riskweave.sources.tables import EVENT_SCHEMA
from riskweave.streaming import scoring as ST

SF = "/root/testdata/sf0.001"


def _events(spark, scratch):
    tx = V.transactions(spark, SF, with_velocity=True)
    ev = tx.select(*[F.col(f.name).cast(f.dataType) if f.name in tx.columns else
                     F.lit(None).cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA.fields])
    path = os.path.join(scratch, "events")
    # Several files written one after another in event-time order, so the
    # stream sees several batches in order (out-of-order files would make
    # rows late for the watermark and drop them, as designed).
    days = [r.d for r in ev.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()]
    cuts = [days[i * len(days) // 4] for i in range(4)] + [None]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        part = ev.where(F.to_date("ts") >= lo)
        if hi is not None:
            part = part.where(F.to_date("ts") < hi)
        part.coalesce(1).write.mode("append").json(path)
        time.sleep(1.1)
    return tx, path


def test_batch_equals_stream_and_restart(spark, scratch):
    tx, path = _events(spark, scratch)
    out, ck = os.path.join(scratch, "out"), os.path.join(scratch, "ck")
    q = ST.start_scoring(ST.event_stream(spark, path, max_files_per_trigger=1), out, ck,
                         scorer="additive")
    q.awaitTermination(300)
    assert q.exception() is None
    streamed = spark.read.parquet(os.path.join(out, "alerts"))
    # Batch path over the same rows.
    scored = risk.apply_rules(tx)
    contribs = S.logodds_contributions(S.event_feature_map(F.col("amount"), F.col("channel")))
    lo, p, pred = S.logodds_score(contribs)
    batch = A.build_alerts(scored.select("*", lo.alias("log_odds"), p.alias("probability"),
                                         pred.alias("prediction"),
                                         S.contributions_map(contribs).alias("contributions")))
    b = sorted((r.alert_id, r.status, tuple(r.triggered_rules)) for r in batch.collect())
    s = sorted((r.alert_id, r.status, tuple(r.triggered_rules)) for r in streamed.collect())
    assert b == s and len(b) > 0
    # Restart on the same checkpoint: no new batches, no duplicate alerts.
    q2 = ST.start_scoring(ST.event_stream(spark, path), out, ck, scorer="additive")
    q2.awaitTermination(300)
    again = spark.read.parquet(os.path.join(out, "alerts"))
    assert again.count() == len(s)
    assert again.select("alert_id").distinct().count() == len(s)
    outbox = spark.read.parquet(os.path.join(out, "outbox"))
    assert outbox.where(F.col("message").startswith("[riskweave] FRAUD ALERT")).count() == outbox.count()


def test_stream_velocity_matches_batch(spark, scratch):
    tx, path = _events(spark, scratch)
    sink = os.path.join(scratch, "vel")
    ev = ST.event_stream(spark, path)
    q = (ST.stream_velocity(ev).writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", os.path.join(scratch, "vck")).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {r.transaction_id: r.tx_count_last_hour for r in spark.read.parquet(sink).collect()}
    want = {r.transaction_id: r.tx_count_last_hour for r in tx.collect()}
    assert got == want


def test_late_rows_are_scored_and_alert_log(spark, scratch):
    from riskweave.operators.reports import recent
    from riskweave.sources.sinks import append_alert_log
    from riskweave.sources.tables import read_alert_log
    tx, path = _events(spark, scratch)
    out, ck = os.path.join(scratch, "out"), os.path.join(scratch, "ck")
    q = ST.start_scoring(ST.event_stream(spark, path), out, ck, keep=None)
    q.awaitTermination(300)
    n0 = spark.read.parquet(os.path.join(out, "scored")).count()
    a0 = ST.latest_alerts(spark, out).count()
    # An old event arrives long after newer ones, and known ones are delivered again.
    events = spark.read.json(path, schema=EVENT_SCHEMA)
    old = events.orderBy("ts").limit(1).withColumn("transaction_id", F.lit("TXN_LATE"))
    again = events.orderBy(F.desc("ts")).limit(40)
    old.union(again).coalesce(1).write.mode("append").json(path)
    q2 = ST.start_scoring(ST.event_stream(spark, path), out, ck, keep=None)
    q2.awaitTermination(300)
    scored = spark.read.parquet(os.path.join(out, "scored"))
    assert scored.count() == n0 + 41
    assert scored.where(F.col("transaction_id") == "TXN_LATE").count() == 1
    late_alert = spark.read.parquet(os.path.join(out, "alerts")).where(F.col("transaction_id") == "TXN_LATE").count()
    assert ST.latest_alerts(spark, out).count() == a0 + late_alert
    # Alert log sink / source round trip and the recent-alerts view.
    alerts = ST.latest_alerts(spark, out)
    log = os.path.join(scratch, "alert_log")
    append_alert_log(alerts.drop("flagged_reasons"), log)
    back = read_alert_log(spark, log)
    assert back.count() == alerts.count()
    top = recent(back, 100).collect()
    assert len(top) == min(100, alerts.count())
    assert [r.timestamp for r in top] == sorted((r.timestamp for r in top), reverse=True)


def test_stream_daily_ussd_matches_batch(spark, scratch):
    tx, path = _events(spark, scratch)
    q = (ST.stream_ussd_daily(ST.event_stream(spark, path)).writeStream.format("memory")
         .queryName("ussd_daily").outputMode("update").trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.sql("SELECT sender, to_date(day) AS d, max(n) AS n, max(ussd_day_total) AS t "
                    "FROM ussd_daily GROUP BY 1, 2").collect()
    want = (tx.where(F.col("channel") == "USSD")
              .groupBy("sender", F.to_date("ts").alias("d"))
              .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("t")).collect())
    assert sorted((r.sender, r.d, r.n, r.t) for r in got) == sorted((r.sender, r.d, r.n, r.t) for r in want)


def test_text_timestamps(spark):
    rows = [("a", "2024-01-10T23:30:00", 600000.0), ("b", "not a time", 600000.0)]
    df = spark.createDataFrame(rows, "transaction_id string, ts string, amount double")
    out = ST.score_events(df).select("transaction_id", "ts_status", "triggered_rules")
    got = {r.transaction_id: (r.ts_status, list(r.triggered_rules)) for r in out.collect()}
    assert got["a"] == ("OK", ["NIGHT_WINDOW_LARGE_TRANSFER"])
    assert got["b"] == ("BAD_TIMESTAMP", [])


def test_stream_scorers(spark, scratch):
    """No model: the probability is the rule score; with a fitted pipeline the
    stream applies it batch by batch."""
    from riskweave import config as C
    from riskweave.operators import models as MD
    tx = V.transactions(spark, SF)
    rows = ST.score_events(tx.limit(50)).collect()
    assert all(r.probability == r.rule_risk_score and r.prediction == int(r.rule_risk_score >= 0.5)
               and r.contributions == {} for r in rows)
    fm = S.event_feature_map(F.col("amount"), F.col("channel"))
    train = tx.select("transaction_id", "is_fraud", *[fm[f].cast("double").alias(f) for f in C.FEATURES])
    model = MD.fit(train, "lr", params={"maxIter": 10})
    scored = ST.score_events(tx.limit(50), scorer=model).collect()
    assert all(0.0 <= r.probability <= 1.0 for r in scored) and len(scored) == 50
