"""State of the event stream: each transaction once (X6), and each sender's recent past.

``once`` drops deliveries of a transaction that came before, in any earlier
micro-batch or across a restart.  Its watermark runs over the time of arrival
and not over the event's time, so an event is never too late to be scored, and
an id is forgotten ``keep`` after it came.

``with_past`` feeds the rules that need a sender's history from state instead
of from the producer.  Rows are keyed by (sender, time bucket) for the count
of the last hour, and by (sender, place) for the places used before, so a
sender with a third of all events is spread over its buckets and places, and
no key holds more than its bucket and the one before.  Each key counts all
rows of the micro-batch whatever their order.  ``gathered`` puts the two
results of a row together in the micro-batch.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .. import config as C
from ..functions.core import to_ts
from ..sources.tables import EVENT_SCHEMA

KEEP = "1 day"
#: Times survive the way through JSON to the microsecond.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
OUT = "row_id string, event string, tx_count long, known_place boolean"


def use_state_store(spark: SparkSession) -> None:
    """The state store that list and value state need; call before the query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def row_id(df: DataFrame):
    """The transaction's id, or a hash of the whole row where it has none."""
    return F.coalesce(F.concat(F.lit("id:"), F.col("transaction_id").cast("string")),
                      F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), JSON), 256))


def once(events: DataFrame, keep: str = KEEP) -> DataFrame:
    """The first delivery of every transaction; adds ``row_id`` and ``arrived``."""
    ev = events.withColumn("row_id", row_id(events)).withColumn("arrived", F.current_timestamp())
    return ev.withWatermark("arrived", keep).dropDuplicatesWithinWatermark(["row_id"])


class Past(StatefulProcessor):
    """Count of the last ``span`` microseconds of a (sender, bucket), or first use of a (sender, place)."""

    def __init__(self, span: int, keep_ms: int):
        self.span, self.keep_ms = span, keep_ms

    def init(self, handle):
        self.handle = handle
        self.times = handle.getListState("times", "t long")
        self.first = handle.getValueState("first", "t long")
        self.seen = handle.getValueState("seen", "ms long")

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows), ignore_index=True)
        kind = key[1][0]
        if kind == "b":
            yield self._count(new)
            now = int(new["arrived_ms"].max())
            self.seen.update((max(now, self.seen.get()[0] if self.seen.exists() else 0),))
            self.handle.registerTimer(now + self.keep_ms)
        elif kind == "p":
            t = new["t"].to_numpy(np.int64)
            first = min(int(t.min()), self.first.get()[0] if self.first.exists() else int(t.min()))
            self.first.update((first,))
            yield self._out(new["row_id"], None, None, t > first)
        else:                                   # no sender or no time: nothing is known
            yield self._out(new["row_id"], new["event"], None, None)

    def _count(self, new: pd.DataFrame) -> pd.DataFrame:
        t = new["t"].to_numpy(np.int64)
        known = np.sort(np.concatenate([[r[0] for r in self.times.get()] if self.times.exists() else [], t]).astype(np.int64))
        self.times.put([(int(v),) for v in known])
        own = new["event"].notna().to_numpy()
        count = np.searchsorted(known, t, side="right") - np.searchsorted(known, t - self.span, side="left") - 1
        return self._out(new["row_id"][own], new["event"][own], count[own], None)

    @staticmethod
    def _out(ids, event, count, known) -> pd.DataFrame:
        cols = zip(("row_id", "event", "tx_count", "known_place"), (ids, event, count, known))
        return pd.DataFrame({c: pd.Series([None] * len(ids) if v is None else [x.item() if hasattr(x, "item") else x for x in v],
                                          dtype=object) for c, v in cols})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.seen.exists() or self.seen.get()[0] + self.keep_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.times.clear()
            self.seen.clear()
        return iter([])

    def close(self):
        pass


def with_past(events: DataFrame, seconds: int = 3600, bucket_seconds: int = 3600, keep_seconds: int = 86_400) -> DataFrame:
    """Rows of ``OUT`` from the rows of ``once``: a row with the event and its count, and one on its place.

    A bucket's times are dropped ``keep_seconds`` after its last arrival; first
    uses of places stay (one time per sender and place).
    """
    unit = bucket_seconds * 1_000_000
    known = [c for c in events.columns if c not in ("row_id", "arrived")]
    t = F.unix_micros(to_ts(F.col("ts")).cast("timestamp"))
    bucket = F.floor(F.col("t") / unit)
    ev = events.select("row_id", "arrived", F.col("sender").cast("string").alias("sender"), "location", t.alias("t"),
                       F.to_json(F.struct(*[F.col(f"`{c}`") for c in known]), JSON).alias("event"))
    there = F.col("sender").isNotNull() & F.col("t").isNotNull()
    ahead = [F.struct(F.concat(F.lit("b"), (bucket + k).cast("string")).alias("part"),
                      (F.col("event") if k == 0 else F.lit(None).cast("string")).alias("event"))
             for k in range(max(1, math.ceil(seconds / bucket_seconds)) + 1)]
    place = F.struct(F.concat(F.lit("p"), F.coalesce("location", F.lit(C.DEFAULT_LOCATION))).alias("part"),
                     F.lit(None).cast("string").alias("event"))
    none = F.struct(F.concat(F.lit("n"), F.pmod(F.xxhash64("row_id"), F.lit(64)).cast("string")).alias("part"),
                    F.col("event").alias("event"))
    ev = ev.withColumn("to", F.explode(F.when(there, F.array(*ahead, place)).otherwise(F.array(none))))
    rows = ev.select("row_id", "arrived", F.unix_millis("arrived").alias("arrived_ms"),
                     F.coalesce("sender", F.lit("")).alias("sender"), F.col("to.part").alias("part"), "t",
                     F.col("to.event").alias("event"))
    return rows.groupBy("sender", "part").transformWithStateInPandas(
        Past(seconds * 1_000_000, keep_seconds * 1000), OUT, "append", "EventTime")


def gathered(batch: DataFrame, schema=EVENT_SCHEMA) -> DataFrame:
    """Events of a micro-batch with ``tx_count_last_hour`` and ``historical_locations`` from the state.

    The history holds the event's own place if the sender used it before, else
    nothing: that is all the place rule asks.  Rows without sender or time keep
    what the producer sent.
    """
    one = batch.groupBy("row_id").agg(F.max("event").alias("event"), F.max("tx_count").alias("tx_count"),
                                      F.max("known_place").alias("known_place"))
    ev = one.select(F.from_json("event", schema, JSON).alias("e"), "tx_count", "known_place").select("e.*", "tx_count", "known_place")
    place = F.when(F.col("known_place"), F.array(F.coalesce("location", F.lit(C.DEFAULT_LOCATION)))).otherwise(F.array().cast("array<string>"))
    return (ev.withColumn("tx_count_last_hour", F.coalesce(F.col("tx_count").cast("int"), "tx_count_last_hour"))
            .withColumn("historical_locations", F.when(F.col("known_place").isNotNull(), place)
                        .otherwise(F.col("historical_locations")))
            .drop("tx_count", "known_place"))
