"""Structured Streaming scoring.

One streaming query reads transaction events, scores them with the same
rule and score expressions as the batch path, and writes three tables from
one ``foreachBatch``: scored transactions, alerts and the notification
outbox.  Each batch is written to a folder named by its batch id with
overwrite, so a batch replayed after a failure replaces its own output
(idempotent); the checkpoint gives exactly-once progress.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from .. import config as C
from ..functions import scoring as S
from ..functions.core import rnd, to_ts
from ..operators import alerts as A
from ..operators import models as MD
from ..operators import risk
from ..operators.reports import latency_sketches, merged_latency
from ..sources.tables import EVENT_SCHEMA
from . import profile


def event_stream(spark: SparkSession, path: str, fmt: str = "json",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """File stream of transaction events with a fixed schema (G1, S5 in tests)."""
    r = spark.readStream.schema(EVENT_SCHEMA).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def kafka_event_stream(spark: SparkSession, servers: str, topic: str,
                       starting: str = "latest") -> DataFrame:
    """Message-bus source: JSON payloads parsed with the event schema.

    Needs the Kafka connector on the classpath (not installed here)."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribe", topic).option("startingOffsets", starting).load())
    return raw.select(F.from_json(F.col("value").cast("string"), EVENT_SCHEMA).alias("e")).select("e.*")


def to_kafka_value(df: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Message-bus sink shape: key + JSON value."""
    return df.select(F.col(key).cast("string").alias("key"),
                     F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"))


def score_events(events: DataFrame, velocity_threshold: int = C.MAX_TX_PER_HOUR,
                 scorer="rules", explain_model=None) -> DataFrame:
    """Stateless scoring (G2): every event is scored, however late it comes.

    ``start_scoring`` drops transactions that are delivered again (X6); one that
    comes after its ``keep`` gets the same alert id and meets the first in
    ``latest_alerts``.

    ``scorer``: a fitted ``PipelineModel`` over the 13 serving features; or
    "rules" (no model: the probability is the rule score, as the stream does
    without a model); or "additive" (the additive log-odds scorer, with
    per-feature contributions).  ISO-8601 text timestamps are parsed; an
    unparsable one stays NULL, never fires the night rule, and the row is
    tagged ``BAD_TIMESTAMP``.

    Rows scored by a model carry contributions too: those of the additive
    scorer, or of ``explain_model`` (feature columns -> map column)."""
    # Missing event fields become NULL, so the rule defaults apply to them.
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA.fields
               if f.name not in events.columns]
    ev = events.select("*", *missing)
    ev = ev.withColumn("ts_status", F.when(to_ts(F.col("ts")).isNull(), F.lit("BAD_TIMESTAMP"))
                                         .otherwise(F.lit("OK")))
    ev = ev.withColumn("ts", to_ts(F.col("ts")).cast("timestamp"))
    ruled = risk.apply_rules(ev, velocity_threshold)
    fmap = S.event_feature_map(F.col("amount"), F.col("channel"))
    if scorer == "additive":
        contribs = S.logodds_contributions(fmap)
        lo, prob, pred = S.logodds_score(contribs)
        return ruled.select("*", lo.alias("log_odds"), prob.alias("probability"),
                            pred.alias("prediction"),
                            S.contributions_map(contribs).alias("contributions"))
    empty = F.create_map().cast("map<string,double>")
    if scorer == "rules":
        prob = F.col("rule_risk_score")
        return ruled.select("*", prob.alias("probability"),
                            F.when(prob >= 0.5, 1).otherwise(0).alias("prediction"),
                            empty.alias("contributions"))
    # A fitted pyspark.ml pipeline: Spark applies it to every micro-batch.
    # The model's "amount" is the scaled serving feature: keep the raw amount aside.
    safe = {f: f.replace("-", "_") for f in C.FEATURES}
    raw = ruled.withColumnRenamed("amount", "__raw_amount")
    fm = S.event_feature_map(F.col("__raw_amount"), F.col("channel"))
    with_feats = raw.select("*", *[fm[f].cast("double").alias(safe[f]) for f in C.FEATURES])
    out = scorer.transform(with_feats)
    prob = rnd(vector_to_array(F.col("probability"))[1], 4)
    contribs = S.contributions_map(S.logodds_contributions(fm)) if explain_model is None else explain_model(fm)
    keep = [F.col("__raw_amount").alias("amount") if c == "amount" else F.col(f"`{c}`")
            for c in ruled.columns]
    return out.select(*keep, prob.alias("probability"),
                      F.when(prob >= 0.5, 1).otherwise(0).alias("prediction"),
                      contribs.alias("contributions"))


def _write(df: DataFrame, root: str, name: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(os.path.join(root, name, f"batch={batch_id}"))


def batch_writer(out_root: str, notify_at: float = C.NOTIFY_AT, prepare=None):
    """foreachBatch handler: scored, alerts, outbox, latency and progress from one persisted batch.

    ``prepare`` turns the micro-batch into scored rows where that is not done in the stream."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        sink_time = F.unix_micros(F.current_timestamp()) / 1e6
        scored = (prepare(batch) if prepare else batch).withColumn(
            "e2e_latency_ms",
            F.when(F.col("produce_time").isNotNull(), (sink_time - F.col("produce_time")) * 1000.0))
        scored = scored.dropDuplicates(["transaction_id"]).persist()
        try:
            _write(scored.drop("contributions"), out_root, "scored", batch_id)
            alerts = A.build_alerts(scored)
            _write(alerts, out_root, "alerts", batch_id)
            _write(A.outbox(alerts, notify_at), out_root, "outbox", batch_id)
            latency = latency_sketches(scored, "channel", "e2e_latency_ms")
            _write(latency, out_root, "latency", batch_id)
            _write(progress(scored), out_root, "progress", batch_id)
        finally:
            scored.unpersist()
    return handle


def score_published(batch: DataFrame, velocity_threshold: int, published: MD.Published) -> DataFrame:
    """A micro-batch scored by the model in use, with its ``model_version`` (M16); by the rule score before the first."""
    version, model = published.current(batch.sparkSession)
    scored = score_events(batch, velocity_threshold, scorer="rules" if model is None else model)
    return scored.withColumn("model_version", F.lit(version).cast("string"))


def is_flagged():
    return (F.col("prediction") == 1) | F.col("rule_decision").isin(C.BLOCKED, C.PENDING_OTP)


def progress(scored: DataFrame, target: float = C.LATENCY_TARGET_MS) -> DataFrame:
    """One row on a micro-batch: rows, anomalies, latency and whether it missed the target.

    The writer puts it in the folder of the batch's number, so a batch that is
    run again replaces its row."""
    p95 = F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double("e2e_latency_ms"), F.lit(0.95))
    row = scored.agg(F.count(F.lit(1)).alias("processed"), F.count_if(is_flagged()).alias("anomalies"),
                     F.avg("e2e_latency_ms").alias("mean_ms"), F.max("e2e_latency_ms").alias("max_ms"),
                     F.when(F.count("e2e_latency_ms") > 0, p95).alias("p95_ms"))
    return row.withColumn("alarm", F.coalesce((F.col("mean_ms") >= target) | (F.col("p95_ms") >= target), F.lit(False)))


def latency_over(spark: SparkSession, out_root: str, first: int = 0, last: int | None = None,
                 by: str | None = None) -> DataFrame:
    """Latency of a range of micro-batches, merged from their sketches."""
    rows = spark.read.parquet(os.path.join(out_root, "latency")).where(F.col("batch") >= first)
    return merged_latency(rows if last is None else rows.where(F.col("batch") <= last), by)


def latest_alerts(spark: SparkSession, out_root: str) -> DataFrame:
    """One row per alert id over all micro-batches: the one of the first batch that raised it."""
    a = spark.read.parquet(os.path.join(out_root, "alerts"))
    first = a.groupBy("alert_id").agg(F.min("batch").alias("batch"))
    return a.join(first, ["alert_id", "batch"]).drop("batch")


def write_alerts_topic(alerts: DataFrame, servers: str, topic: str) -> None:
    """Alerts topic writer (S6): key and JSON value through the Kafka connector."""
    to_kafka_value(alerts, "alert_id").write.format("kafka").option("kafka.bootstrap.servers", servers) \
        .option("topic", topic).save()


def start_scoring(events: DataFrame, out_root: str, checkpoint: str,
                  available_now: bool = True, interval: str = "5 seconds",
                  velocity_threshold: int = C.MAX_TX_PER_HOUR, scorer="rules",
                  keep: str | None = profile.KEEP, past: bool = False):
    """Start the scoring query: bounded run (availableNow) or daemon.

    A transaction that was delivered within ``keep`` is not scored, raised or
    queued again (X6; None: only within a micro-batch).  With ``past`` the
    velocity and place rules read the sender's history from the stream's state
    instead of from the event (X1, X4); this needs ``keep``.

    ``scorer`` is that of ``score_events``, or a ``models.Published``: then every
    micro-batch is scored by the model that is in use when it starts, without a
    restart, and its rows carry ``model_version`` (M16).  A batch that is run
    again is scored and written as a whole, so no batch mixes versions.

    ``observe`` publishes processed / anomaly counters per batch (G9); the
    ``progress`` table has them for every batch."""
    if past and keep is None:
        raise ValueError("the history counts transactions, so it needs them once: set keep")
    def scored(batch: DataFrame) -> DataFrame:
        if isinstance(scorer, MD.Published):
            return score_published(batch, velocity_threshold, scorer)
        return score_events(batch, velocity_threshold, scorer=scorer)

    if past:
        profile.use_state_store(events.sparkSession)
        rows = profile.with_past(profile.once(events, keep))
        rows = rows.observe("counters", F.count("event").alias("processed"))
        handler = batch_writer(out_root, prepare=lambda b: scored(profile.gathered(b, events.schema)))
    elif isinstance(scorer, MD.Published):
        rows = events if keep is None else profile.once(events, keep).drop("row_id", "arrived")
        rows = rows.observe("counters", F.count(F.lit(1)).alias("processed"))
        handler = batch_writer(out_root, prepare=scored)
    else:
        first = events if keep is None else profile.once(events, keep).drop("row_id", "arrived")
        rows = score_events(first, velocity_threshold, scorer=scorer)
        rows = rows.observe("counters", F.count(F.lit(1)).alias("processed"), F.count_if(is_flagged()).alias("anomalies"))
        handler = batch_writer(out_root)
    w = rows.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


# --- stateful velocity (X1) -------------------------------------------------

VELOCITY_OUT = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("sender", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("tx_count_last_hour", T.IntegerType()),
])
VELOCITY_STATE = T.StructType([T.StructField("times", T.ArrayType(T.LongType()))])


def _velocity_fn(window_us: int):
    def fn(key, pdfs, state):
        if state.hasTimedOut:
            # Nothing arrived for a full window past the watermark: drop the key.
            state.remove()
            return
        new = pd.concat(list(pdfs), ignore_index=True)
        t = (new["ts"].astype("datetime64[us]").astype("int64")).to_numpy()
        old = np.array(state.get[0] if state.exists else [], dtype=np.int64)
        known = np.sort(np.concatenate([old, t]))
        # All rows of the micro-batch count, whatever their order; a row at the same time counts, itself not.
        count = np.searchsorted(known, t, side="right") - np.searchsorted(known, t - window_us, side="left") - 1
        last = int(known[-1])
        # Only one window is kept: state per sender is bounded by its activity in it.
        state.update((known[known >= last - window_us].tolist(),))
        state.setTimeoutTimestamp(last // 1000 + window_us // 1000)
        yield pd.DataFrame({"transaction_id": new["transaction_id"], "sender": new["sender"], "ts": new["ts"],
                            "tx_count_last_hour": pd.Series(count, dtype="int32")})
    return fn


def stream_velocity(events: DataFrame, seconds: int = 3600, watermark: str = "1 hour") -> DataFrame:
    """Exact prior-transaction count per sender over the last ``seconds``.

    Counts what has arrived up to and including the row's micro-batch, in any
    order; state holds the sender's times in the window before its newest.
    Lateness rule: a row that comes after later micro-batches of its sender is
    counted against what is still in the state, and rows behind the watermark
    are not seen by this stateful query (scoring itself sees them all).
    """
    ev = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return ev.select("transaction_id", "sender", "ts").groupBy("sender").applyInPandasWithState(
        _velocity_fn(seconds * 1_000_000), VELOCITY_OUT, VELOCITY_STATE, "append",
        GroupStateTimeout.EventTimeTimeout)


def stream_ussd_daily(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Daily USSD total per sender over a tumbling one-day window."""
    ev = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    g = (ev.where(F.upper("channel") == "USSD")
           .groupBy("sender", F.window("ts", "1 day"))
           .agg(F.sum("amount").alias("ussd_day_total"), F.count(F.lit(1)).alias("n")))
    return g.select("sender", F.col("window.start").alias("day"), "ussd_day_total", "n",
                    (F.col("ussd_day_total") > C.USSD_DAILY_LIMIT).alias("over_daily_cap"))
