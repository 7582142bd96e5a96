"""Dashboard and report tables: headline KPIs, bands, sampling, paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions.core import key_uniform, rnd
from ..operators import reports as RP
from ..sources import views as V
from . import sqlfrag as Q
from .q_alerts import ALERTS_SQL, REGISTRY_SQL, SCORED_SQL, alerts_df, registry_df, scored_tx
from .registry import register


@register("headline_kpis", f"""
SELECT t.total, a.flagged, round(a.flagged * 100.0 / t.total, 2) AS fraud_rate_pct
FROM (SELECT count(*) AS total FROM ({Q.TX_BASE}) x) t, (SELECT count(*) AS flagged FROM ({ALERTS_SQL}) y) a""")
def headline_kpis(spark, sf):
    """Total, flagged and fraud rate from real counts."""
    flagged = alerts_df(spark, sf).agg(F.count(F.lit(1))).scalar()
    t = V.transactions(spark, sf).agg(F.count(F.lit(1)).alias("total"))
    t = t.select("total", flagged.alias("flagged"))
    return t.select("total", "flagged",
                    rnd(F.col("flagged") * 100.0 / F.col("total"), 2).alias("fraud_rate_pct"))


def _band(col, hi, mid, labels=("HIGH", "MEDIUM", "LOW")):
    return F.when(col >= hi, labels[0]).when(col >= mid, labels[1]).otherwise(labels[2])


@register("risk_bands", f"""
SELECT CASE WHEN risk_score >= 0.85 THEN 'HIGH' WHEN risk_score >= 0.65 THEN 'MEDIUM' ELSE 'LOW' END AS risk_band,
       status, count(*) AS n
FROM ({REGISTRY_SQL}) r GROUP BY ALL""")
def risk_bands(spark, sf):
    """Alert risk bands (P20: >= 0.85 / >= 0.65)."""
    reg = registry_df(spark, sf)
    return reg.groupBy(_band(F.col("risk_score"), 0.85, 0.65).alias("risk_band"), "status") \
              .agg(F.count(F.lit(1)).alias("n"))


_WEIGHTS_SQL = ("(VALUES " + ", ".join(f"({Q.q(n)}, CAST({w} AS DOUBLE))" for n, w in C.RULES)
                + ") AS w(rule, weight)")


@register("rule_severity", f"""
SELECT p.pattern, w.weight,
       CASE WHEN w.weight >= 0.8 THEN 'CRITICAL' WHEN w.weight >= 0.6 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
       p.incidents, p.pct_of_total,
       CASE WHEN p.pct_of_total >= 20 THEN 'HIGH' WHEN p.pct_of_total >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS share_band
FROM (SELECT pattern, incidents, round(incidents * 100.0 / sum(incidents) OVER (), 2) AS pct_of_total
      FROM (SELECT pattern, count(*) AS incidents
            FROM (SELECT unnest(triggered_rules) AS pattern FROM ({ALERTS_SQL}) a) x GROUP BY pattern) g) p
JOIN {_WEIGHTS_SQL} ON p.pattern = w.rule""")
def rule_severity(spark, sf):
    """Rule weight severity (>= 0.8 CRITICAL, >= 0.6 HIGH) and share bands (>= 20 / >= 10 %) (P20)."""
    pat = RP.fraud_patterns(alerts_df(spark, sf))
    w = spark.createDataFrame(C.RULES, "rule string, weight double")
    j = pat.join(F.broadcast(w), pat.pattern == w.rule)
    return j.select("pattern", "weight",
                    _band(F.col("weight"), 0.8, 0.6, ("CRITICAL", "HIGH", "MEDIUM")).alias("severity"),
                    "incidents", "pct_of_total",
                    _band(F.col("pct_of_total"), 20, 10).alias("share_band"))


@register("sampled_transactions", f"""
SELECT * FROM (
  (SELECT 'PaySim' AS source_dataset, CAST(order_key AS VARCHAR) AS record_id, amount, type AS channel, isFraud AS is_fraud
   FROM ({Q.RAW_MONEY}) m ORDER BY order_key LIMIT 12)
  UNION ALL
  (SELECT 'IEEE-CIS' AS source_dataset, TransactionID AS record_id, TransactionAmt AS amount, ProductCD AS channel,
          isFraud AS is_fraud
   FROM ({Q.RAW_CARD}) c ORDER BY TransactionID LIMIT 13)) u
ORDER BY {Q.key_uniform_sql('record_id', "'sample'")}, record_id LIMIT 25""")
def sampled_transactions(spark, sf, n: int = 25):
    """First n/2 rows of one source, filled from the other, shuffled by hash, capped (S3).
    The caps are the feature: this is a demo sampling operator."""
    a = V.raw_money(spark, sf).orderBy("order_key").limit(n // 2).select(
        F.lit("PaySim").alias("source_dataset"), F.col("order_key").cast("string").alias("record_id"),
        "amount", F.col("type").alias("channel"), F.col("isFraud").alias("is_fraud"))
    b = V.raw_card(spark, sf).orderBy("TransactionID").limit(n - n // 2).select(
        F.lit("IEEE-CIS").alias("source_dataset"), F.col("TransactionID").alias("record_id"),
        F.col("TransactionAmt").alias("amount"), F.col("ProductCD").alias("channel"),
        F.col("isFraud").alias("is_fraud"))
    u = a.unionByName(b)
    return u.orderBy(key_uniform(F.col("record_id"), F.lit("sample")), "record_id").limit(n)


@register("importance_sample", f"""
SELECT s.transaction_id, e.feature AS feature, CAST(f.value AS DOUBLE) AS value, e.value AS contribution
FROM (SELECT * FROM ({SCORED_SQL}) x
      ORDER BY {Q.key_uniform_sql('transaction_id', "'plot'")}, transaction_id LIMIT 250) s,
     LATERAL (SELECT unnest(s.entries) AS e) u,
     LATERAL (SELECT CASE e.feature WHEN 'amount' THEN least(coalesce(s.amount, 0.0) / {C.SERVE_AMOUNT_SCALE}, 1.0)
                     {' '.join(f"WHEN 'channel_{c}' THEN CASE WHEN s.mch = '{c}' THEN 1 ELSE 0 END" for c in C.CHANNELS)}
                     WHEN 'source_dataset_IEEE-CIS' THEN 0 ELSE 1 END AS value) f""")
def importance_sample(spark, sf, n: int = 250):
    """Seeded uniform sample of at most n scored rows, long (feature, value, contribution)."""
    from ..functions import scoring as S
    s = scored_tx(spark, sf)
    smp = s.orderBy(key_uniform(F.col("transaction_id"), F.lit("plot")), "transaction_id").limit(n)
    fm = S.event_feature_map(F.col("amount"), F.col("channel"))
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), fm[f].cast("double").alias("value"),
                              F.col("contributions")[f].alias("contribution")) for f in C.FEATURES])
    return smp.select("transaction_id", F.inline(rows))


@register("dependence_pairs", f"""
SELECT transaction_id, least(coalesce(amount, 0.0) / {C.SERVE_AMOUNT_SCALE}, 1.0) AS value, c0 AS contribution
FROM ({SCORED_SQL}) s""")
def dependence_pairs(spark, sf, feature: str = "amount"):
    """Feature value vs its contribution for every scored row."""
    from ..functions import scoring as S
    s = scored_tx(spark, sf)
    fm = S.event_feature_map(F.col("amount"), F.col("channel"))
    return s.select("transaction_id", fm[feature].cast("double").alias("value"),
                    F.col("contributions")[feature].alias("contribution"))


@register("alert_page", f"""
SELECT * FROM ({REGISTRY_SQL}) r ORDER BY risk_score DESC, alert_id LIMIT 5 OFFSET 5""")
def alert_page(spark, sf, page: int = 2, size: int = 5):
    """Registry sorted by risk (T2), one page of five rows."""
    reg = registry_df(spark, sf)
    return reg.orderBy(F.desc("risk_score"), "alert_id").offset((page - 1) * size).limit(size)


@register("mobile_app_limit", f"""
SELECT transaction_id, sender, amount, amount > {C.MOBILE_APP_SINGLE_LIMIT} AS over_app_limit
FROM ({Q.TX_BASE}) t WHERE upper(channel) = 'MOBILEAPP'""")
def mobile_app_limit(spark, sf):
    """Mobile-app single-transaction limit without a token."""
    tx = V.transactions(spark, sf).where(F.upper("channel") == "MOBILEAPP")
    return tx.select("transaction_id", "sender", "amount",
                     (F.col("amount") > C.MOBILE_APP_SINGLE_LIMIT).alias("over_app_limit"))
