"""Event log source and sink: offsets, restarts, several readers, commits written once."""

import os

import pytest
from pyspark.sql import functions as F

from riskweave.sources import eventlog as E
from riskweave.sources import views as V
from riskweave.sources.tables import EVENT_SCHEMA
from riskweave.streaming import scoring as ST

SF = "/root/testdata/sf0.001"


def _messages(spark, lo, hi):
    return spark.range(lo, hi).select(F.col("id").cast("string").alias("key"),
                                      F.when(F.col("id") % 7 != 0, F.concat(F.lit("v"), "id")).alias("value"))


def _drain(stream, out, ck):
    q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert q.exception() is None


def _keys(spark, out):
    return sorted(int(r.key) for r in spark.read.parquet(out).select("key").collect())


def test_round_trip_nulls_and_empty(spark, scratch):
    log = os.path.join(scratch, "log")
    assert E.read_log(spark, log).count() == 0
    E.append_log(_messages(spark, 0, 50), log)
    E.append_log(_messages(spark, 0, 0), log)
    E.append_log(_messages(spark, 50, 60), log, producer="other")
    rows = E.read_log(spark, log).collect()
    assert {(r.key, r.value) for r in rows} == {(str(i), f"v{i}" if i % 7 else None) for i in range(60)}
    assert len(rows) == 60
    assert {(r.producer, r.commit) for r in rows} == {("main", 0), ("other", 0)}
    assert E.Log(log).ends() == {"main": 2, "other": 1}
    with pytest.raises(Exception, match="append-only"):
        _messages(spark, 0, 1).write.format(E.FORMAT).mode("overwrite").save(log)


def test_restart_resumes_and_readers_keep_their_own(spark, scratch):
    log = os.path.join(scratch, "log")
    E.append_log(_messages(spark, 0, 20), log)
    a, b = (os.path.join(scratch, n) for n in "ab")
    _drain(E.log_stream(spark, log, "earliest"), a, a + "_ck")
    E.append_log(_messages(spark, 20, 30), log)
    E.append_log(_messages(spark, 30, 40), log, producer="second")     # a producer the first start did not know
    _drain(E.log_stream(spark, log, "earliest"), a, a + "_ck")
    assert _keys(spark, a) == list(range(40))
    # another reader has offsets of its own
    _drain(E.log_stream(spark, log, "earliest"), b, b + "_ck")
    assert _keys(spark, b) == list(range(40))
    # nothing new: nothing is read again
    _drain(E.log_stream(spark, log, "earliest"), a, a + "_ck")
    assert _keys(spark, a) == list(range(40))


def test_latest_counts_for_the_first_start_alone(spark, scratch):
    log, out = os.path.join(scratch, "log"), os.path.join(scratch, "late")
    E.append_log(_messages(spark, 0, 10), log)
    q = (E.log_stream(spark, log, "latest").writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", out + "_ck").trigger(processingTime="200 milliseconds").start())
    q.processAllAvailable()
    E.append_log(_messages(spark, 10, 15), log)
    q.processAllAvailable()
    q.stop()
    E.append_log(_messages(spark, 15, 18), log)
    _drain(E.log_stream(spark, log, "latest"), out, out + "_ck")
    assert _keys(spark, out) == list(range(10, 18))


def test_a_batch_run_again_commits_once(spark, scratch):
    src, log = os.path.join(scratch, "log"), os.path.join(scratch, "copy")
    E.append_log(_messages(spark, 0, 30), src)
    ck = os.path.join(scratch, "ck")
    E.write_log_stream(E.log_stream(spark, src, "earliest"), log, ck, "relay").awaitTermination(120)
    assert E.read_log(spark, log).count() == 30
    # the query died after its commit and before Spark's: the batch is run again from its offsets
    for name in sorted(os.listdir(os.path.join(ck, "commits")), reverse=True):
        if name.strip(".").startswith("0"):
            os.unlink(os.path.join(ck, "commits", name))
    E.write_log_stream(E.log_stream(spark, src, "earliest"), log, ck, "relay").awaitTermination(120)
    assert E.read_log(spark, log).count() == 30
    data = os.listdir(os.path.join(log, "relay", "data"))
    assert len(data) == len(E.Log(log).between({}, E.Log(log).ends()))
    # segments that no commit names are never read
    E.Log(log).write("relay", [E.pa.RecordBatch.from_pydict({"key": ["x"], "value": ["y"]})])
    assert E.read_log(spark, log).count() == 30


def test_events_through_the_log_score_as_the_file_stream(spark, scratch):
    tx = V.transactions(spark, SF, with_velocity=True).limit(300)
    ev = tx.select(*[F.col(f.name).cast(f.dataType) if f.name in tx.columns else
                     F.lit(None).cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA.fields])
    log, out = os.path.join(scratch, "log"), os.path.join(scratch, "out")
    E.append_log(ST.to_kafka_value(ev), log)
    events = E.events_of(E.log_stream(spark, log, "earliest"))
    q = ST.start_scoring(events, out, os.path.join(scratch, "ck"))
    q.awaitTermination(300)
    assert q.exception() is None
    got = {r.transaction_id: r.rule_decision for r in spark.read.parquet(os.path.join(out, "scored")).collect()}
    want = {r.transaction_id: r.rule_decision for r in ST.score_events(ev).collect()}
    assert got == want and len(got) == 300
    # alerts go to a topic of their own
    alerts = spark.read.parquet(os.path.join(out, "alerts"))
    E.append_log(ST.to_kafka_value(alerts.drop("batch"), "alert_id"), os.path.join(scratch, "topic"))
    assert E.read_log(spark, os.path.join(scratch, "topic")).count() == alerts.count() > 0
