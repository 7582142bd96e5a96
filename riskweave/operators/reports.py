"""Reporting tables over alerts and transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.core import rnd
from .stats import exact_quantile


def alert_kpis(reg: DataFrame) -> DataFrame:
    """Flagged amount, blocked / pending counts, average and high risk."""
    return reg.agg(
        F.count(F.lit(1)).alias("n_alerts"),
        F.coalesce(F.sum(F.col("amount").cast("decimal(20,2)")), F.lit(0)).cast("double")
         .alias("total_amount_flagged"),
        F.count_if(F.col("status") == C.BLOCKED).alias("blocked"),
        F.count_if(F.col("status") == C.PENDING_OTP).alias("pending"),
        rnd(F.coalesce(F.avg("risk_score"), F.lit(0.0)), 6).alias("avg_risk"),
        F.count_if(F.col("risk_score") >= C.HIGH_RISK_AT).alias("high_risk"))


def top_value(df: DataFrame, col: str) -> DataFrame:
    """Most frequent value of ``col``; ties go to the alphabetically first."""
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.min_by(F.struct(F.col(col).alias("value"), F.col("n")),
                          F.struct(-F.col("n"), F.col(col))).alias("t")).select("t.value", "t.n")


def fraud_patterns(alerts: DataFrame) -> DataFrame:
    """Incidents, share of all incidents and average amount per triggered rule."""
    ex = alerts.select(F.explode("triggered_rules").alias("pattern"), "amount")
    g = ex.groupBy("pattern").agg(F.count(F.lit(1)).alias("incidents"),
                                  rnd(F.avg("amount"), 2).alias("avg_amount"))
    # Window over the small per-pattern aggregate only (six rules at most).
    return g.select("pattern", "incidents",
                    rnd(F.col("incidents") * 100.0 / F.sum("incidents").over(Window.partitionBy()), 2)
                    .alias("pct_of_total"), "avg_amount")


def geo_incidents(alerts: DataFrame, geo: DataFrame) -> DataFrame:
    """Incidents and amount by location with coordinates.

    Aggregated first, then joined to the fixed geo table (broadcast; its size
    is the literal list)."""
    g = alerts.groupBy("location").agg(
        F.count(F.lit(1)).alias("incidents"),
        F.sum(F.col("amount").cast("decimal(20,2)")).cast("double").alias("amount_ngn"))
    dim = geo.select(F.regexp_replace("state", r" \(.*\)$", "").alias("city"), "state", "lat", "lon")
    j = g.join(F.broadcast(dim), g.location == dim.city, "left")
    return j.select("location", "state", "lat", "lon", "incidents", "amount_ngn")


def top_counts(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """Top-n keys by flagged count (ties by key) with amount."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("flagged"),
                            F.sum(F.col("amount").cast("decimal(20,2)")).cast("double").alias("amount"))
    return g.orderBy(F.desc("flagged"), F.asc(key)).limit(n)


def daily_trend(tx: DataFrame, flagged: DataFrame) -> DataFrame:
    """Per calendar day: all transactions and flagged ones; empty days are 0."""
    day = F.to_date("ts")
    tot = tx.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("total"))
    fl = flagged.groupBy(F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("flagged"))
    span = tot.agg(F.min("day").alias("d0"), F.max("day").alias("d1"))
    cal = span.select(F.explode(F.sequence("d0", "d1")).alias("day"))
    return (cal.join(tot, "day", "left").join(fl, "day", "left")
               .select("day", F.coalesce("total", F.lit(0)).alias("total"),
                       F.coalesce("flagged", F.lit(0)).alias("flagged")))


def latency_stats(df: DataFrame, col: str = "scoring_latency_ms",
                  target: float = C.LATENCY_TARGET_MS) -> DataFrame:
    """Mean, max, exact p95 (linear interpolation) and pass/fail against target."""
    p95 = exact_quantile(df, col, 0.95)
    agg = df.agg(F.count(col).alias("n"), F.avg(col).alias("mean_ms"), F.max(col).alias("max_ms"))
    p = F.lit(p95).cast("double")
    return agg.select("n", rnd("mean_ms", 6).alias("mean_ms"), rnd("max_ms", 6).alias("max_ms"),
                      rnd(p, 6).alias("p95_ms"),
                      ((F.col("mean_ms") < target) & (p < target)).alias("meets_target"))


def latency_sketches(df: DataFrame, by: str, col: str = "scoring_latency_ms") -> DataFrame:
    """Per ``by``: n, total, max and a KLL sketch of the latencies.

    Rows of different batches, days or partitions merge with ``merged_latency``
    into what one pass over all their rows would give, within the sketch's
    error (about 1.3 % of the rank at Spark's default size)."""
    return (df.where(F.col(col).isNotNull()).groupBy(by)
              .agg(F.count(col).alias("n"), F.sum(col).alias("total_ms"), F.max(col).alias("max_ms"),
                   F.kll_sketch_agg_double(F.col(col).cast("double")).alias("sketch")))


def merged_latency(sketches: DataFrame, by: str | None = None, target: float = C.LATENCY_TARGET_MS) -> DataFrame:
    """n, mean, max, approximate median and p95, and pass/fail against the target, over any rows of sketches."""
    g = sketches.groupBy(*([by] if by else [])).agg(
        F.sum("n").alias("n"), F.sum("total_ms").alias("total"), F.max("max_ms").alias("max_ms"),
        F.kll_merge_agg_double("sketch").alias("sketch")).where(F.col("n") > 0)
    q = {c: F.kll_sketch_get_quantile_double("sketch", F.lit(p)) for c, p in (("p50_ms", 0.5), ("p95_ms", 0.95))}
    mean = F.col("total") / F.col("n")
    return g.select(*([by] if by else []), "n", mean.alias("mean_ms"), "max_ms", *[v.alias(c) for c, v in q.items()],
                    ((mean < target) & (q["p95_ms"] < target)).alias("meets_target"))


def recent(df: DataFrame, n: int = 100, ts: str = "timestamp", key: str = "alert_id") -> DataFrame:
    """Newest n rows (S9, T1); the limit is the feature."""
    return df.orderBy(F.desc(ts), F.asc(key)).limit(n)


def with_share(g: DataFrame, count_col: str, out: str = "pct") -> DataFrame:
    """Percent-of-total over a small aggregate."""
    return g.withColumn(out, rnd(F.col(count_col) * 100.0
                                     / F.sum(count_col).over(Window.partitionBy()), 2))


def bank_summary(tx: DataFrame, banks: DataFrame) -> DataFrame:
    """Per bank code: name (default "Unknown Bank"), transactions and valid
    accounts (V1, V4, J1).  Aggregated first, so the lookup join sees one row
    per bank code; the bank table is the fixed list (broadcast)."""
    from ..functions.identity import nuban_valid
    g = tx.groupBy("bank_code").agg(
        F.count(F.lit(1)).alias("n_transactions"),
        F.sum(F.when(nuban_valid(F.col("account"), F.col("bank_code")), 1).otherwise(0))
         .alias("n_valid_accounts"))
    j = g.join(F.broadcast(banks), g.bank_code == F.col("code"), "left")
    return j.select("bank_code", F.coalesce(F.col("name"), F.lit(C.UNKNOWN_BANK)).alias("bank_name"),
                    "n_transactions", F.col("n_valid_accounts").cast("long").alias("n_valid_accounts"))
