"""Stream state: redelivery across batches and restarts, history from state = batch, latency and progress tables."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from riskweave.operators import reports, risk
from riskweave.operators.velocity import history_as_of, windowed_count
from riskweave.sources.tables import EVENT_SCHEMA
from riskweave.streaming import scoring as ST

T0 = datetime.datetime(2024, 3, 1, tzinfo=datetime.timezone.utc)


def events(n=260, seed=1):
    """Rows without history; sender 1 has a third of them and some rows lack sender, time or place."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        at = T0 + datetime.timedelta(seconds=rng.randrange(6 * 3600), microseconds=rng.randrange(10**6))
        out.append({"transaction_id": f"T{i}", "sender": 1 if i % 3 == 0 else rng.randint(2, 30),
                    "amount": rng.choice([10.0, 600000.0, 90000.123456789]), "channel": rng.choice(["USSD", "POS", None]),
                    "location": rng.choice(["Lagos", "Abuja", "Kano", None]), "bvn_matched": True,
                    "ts": at.isoformat(), "produce_time": T0.timestamp()})
    out[5]["sender"] = None
    out[6]["ts"] = None
    return out


def put(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f"{name}.json"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows))


def run(spark, folder, out, ck, **kw):
    q = ST.start_scoring(ST.event_stream(spark, folder, max_files_per_trigger=1), out, ck, velocity_threshold=2, **kw)
    assert q.awaitTermination(400) and q.exception() is None
    return spark.read.parquet(os.path.join(out, "scored"))


def decided(df):
    return {r.transaction_id: (r.rule_decision, tuple(r.triggered_rules), r.rule_risk_score) for r in df.collect()}


def test_redelivery_is_scored_and_queued_once(spark, scratch):
    rows = events(60)
    src, out, ck = (os.path.join(scratch, x) for x in ("src", "out", "ck"))
    put(src, "1", rows[:40] + rows[:3])
    assert run(spark, src, out, ck).count() == 40
    queued = spark.read.parquet(os.path.join(out, "outbox")).count()
    alerts = spark.read.parquet(os.path.join(out, "alerts")).count()
    assert queued > 0
    old = {**rows[0], "transaction_id": "LATE", "ts": "2019-01-01T00:00:00Z"}
    none = [{**rows[1], "transaction_id": None, "amount": a} for a in (1.0, 2.0, 1.0)]
    put(src, "2", rows[:40])                                   # all again, after a restart
    put(src, "3", rows[30:] + [old] + none)
    scored = run(spark, src, out, ck)
    assert scored.where("transaction_id IS NOT NULL").count() == 61
    assert scored.where("transaction_id = 'LATE'").count() == 1
    assert scored.groupBy("transaction_id").count().where("count > 1 AND transaction_id IS NOT NULL").count() == 0
    box = spark.read.parquet(os.path.join(out, "outbox"))
    assert box.where("batch = 1").count() == 0 and box.count() == box.select("alert_id").distinct().count() >= queued
    assert spark.read.parquet(os.path.join(out, "alerts")).count() >= alerts
    # progress: one row a batch, its counts those of the scored table
    p = spark.read.parquet(os.path.join(out, "progress"))
    assert p.count() == p.select("batch").distinct().count()
    assert p.agg(F.sum("processed")).first()[0] == scored.count()
    flagged = scored.where(ST.is_flagged()).count()
    assert p.agg(F.sum("anomalies")).first()[0] == flagged and p.where("processed > 0 AND NOT alarm").count() == 0


def batch_version(spark, rows):
    schema = EVENT_SCHEMA
    df = spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    place = F.coalesce("location", F.lit("Lagos"))
    v = windowed_count(df.drop("tx_count_last_hour"), ["sender"], "ts", 3600, "tx_count_last_hour")
    v = history_as_of(v.drop("historical_locations").withColumn("__place", place), "sender", "ts", "__place",
                      "transaction_id", "historical_locations").drop("__place")
    lost = F.col("sender").isNull() | F.col("ts").isNull()
    v = v.withColumn("tx_count_last_hour", F.when(~lost, F.col("tx_count_last_hour")))
    v = v.withColumn("historical_locations", F.when(~lost, F.col("historical_locations")))
    return decided(risk.apply_rules(v, 2))


def test_rules_from_state_equal_batch(spark, scratch):
    """Batches in order of time, the rows of each shuffled; every third row is delivered twice."""
    rows = events()
    want = batch_version(spark, rows)
    assert {r for _, rules, _ in want.values() for r in rules} >= {"HIGH_TRANSACTION_VELOCITY"}
    ordered = sorted(rows, key=lambda r: r["ts"] or "")
    src, out, ck = (os.path.join(scratch, x) for x in ("src", "out", "ck"))
    rng = random.Random(4)
    for k in range(3):
        part = ordered[k * 90:(k + 1) * 90]
        part = part + part[::3]
        rng.shuffle(part)
        put(src, str(k), part)
        got = run(spark, src, out, ck, past=True)              # a restart between all batches
    assert got.count() == len(rows)
    assert decided(got) == want


def test_one_batch_in_any_order(spark, scratch):
    rows = events(120, 8)
    random.Random(2).shuffle(rows)
    src, out, ck = (os.path.join(scratch, x) for x in ("src", "out", "ck"))
    put(src, "1", rows)
    assert decided(run(spark, src, out, ck, past=True)) == batch_version(spark, rows)
    total = ST.latency_over(spark, out).first()
    assert total.n == len(rows) and not total.meets_target
    by = {r.channel: r.n for r in ST.latency_over(spark, out, by="channel").collect()}
    assert sum(by.values()) == len(rows)
    with pytest.raises(ValueError):
        ST.start_scoring(ST.event_stream(spark, src), out, ck, past=True, keep=None)


def test_merged_sketches_are_within_their_error(spark):
    df = spark.range(200_000).selectExpr("id % 50 AS batch", "pow(id % 9973, 1.5) AS ms")
    sketches = reports.latency_sketches(df, "batch", "ms")
    for low, high in ((0, 49), (3, 9)):
        part = df.where(F.col("batch").between(low, high))
        got = reports.merged_latency(sketches.where(F.col("batch").between(low, high))).first()
        assert got.n == part.count() and got.max_ms == part.agg(F.max("ms")).first()[0]
        for p, q in ((0.5, got.p50_ms), (0.95, got.p95_ms)):
            assert abs(part.where(F.col("ms") <= q).count() / got.n - p) < 0.02
    assert reports.merged_latency(sketches.limit(0)).count() == 0
