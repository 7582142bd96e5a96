"""Alert, explanation and reporting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions.core import rnd
from ..functions import scoring as S
from ..operators import alerts as A
from ..operators import reports as RP
from ..operators import risk
from ..sources import views as V
from ..sources.dims import geo
from . import sqlfrag as Q
from .q_rules import VEL_T, _RULED
from .registry import register


# --------------------------------------------------------------------------
# Spark side
# --------------------------------------------------------------------------

def scored_tx(spark, sf):
    """Transactions with rules, additive score and per-feature contributions."""
    tx = risk.apply_rules(V.transactions(spark, sf, with_velocity=True), VEL_T)
    contribs = S.logodds_contributions(S.event_feature_map(F.col("amount"), F.col("channel")))
    lo, prob, pred = S.logodds_score(contribs)
    return tx.select("*", lo.alias("log_odds"), prob.alias("probability"), pred.alias("prediction"),
                     S.contributions_map(contribs).alias("contributions"))


def alerts_df(spark, sf):
    return A.build_alerts(scored_tx(spark, sf))


def registry_df(spark, sf):
    return A.registry(alerts_df(spark, sf))


# --------------------------------------------------------------------------
# SQL side
# --------------------------------------------------------------------------

_MCH = Q.case(f"upper(coalesce(channel, {Q.q('MOBILEAPP')}))", C.EVENT_CHANNEL_TO_MODEL,
              Q.q(C.EVENT_CHANNEL_DEFAULT_MODEL))
_FLAG_ON = {"channel_CARD_WEB": "mch = 'CARD_WEB'", "channel_CASH_OUT": "mch = 'CASH_OUT'",
            "channel_DEBIT": "mch = 'DEBIT'", "channel_TRANSFER": "mch = 'TRANSFER'",
            "source_dataset_PaySim": "true"}


def _contrib_sql(name: str) -> str:
    if name == "amount":
        return f"round(least(coalesce(amount, 0.0) / {C.SERVE_AMOUNT_SCALE}, 1.0) * {C.LOGODDS_AMOUNT}, 4)"
    for n, on, off in C.LOGODDS_FLAGS:
        if n == name:
            return f"(CASE WHEN {_FLAG_ON[n]} THEN {on} ELSE {off} END)"
    return "0.0"


_CC = {n: f"c{i}" for i, n in enumerate(C.FEATURES)}
_SUM_ORDER = [n for n in C.FEATURES if n == "amount" or n in _FLAG_ON]
_total = _CC[_SUM_ORDER[0]]
for _n in _SUM_ORDER[1:]:
    _total = f"({_total} + {_CC[_n]})"
_ENTRIES = "[" + ", ".join(
    f"{{'neg_abs': -abs(CAST({_CC[n]} AS DOUBLE)), 'idx': {i}, 'feature': {Q.q(n)}, 'value': CAST({_CC[n]} AS DOUBLE)}}"
    for i, n in enumerate(C.FEATURES)) + "]"

SCORED_SQL = f"""
SELECT *, 1.0 / (1.0 + exp(-log_odds)) AS probability
FROM (SELECT *, ({C.LOGODDS_BASE} + {_total}) AS log_odds, list_sort({_ENTRIES}) AS entries
      FROM (SELECT *, {', '.join(f'{_contrib_sql(n)} AS {_CC[n]}' for n in C.FEATURES)}
            FROM (SELECT *, {_MCH} AS mch FROM ({_RULED}) r0) r1) r2) r3
"""

_FLAGGED = "(round(probability, 4) >= 0.5 OR rule_decision IN ('BLOCKED', 'PENDING_OTP'))"
_RISK = "greatest(model_probability, rule_risk_score)"

ALERTS_SQL = f"""
SELECT 'ALT' || upper(sha256(transaction_id)) AS alert_id,
       transaction_id, amount, channel, location, round(probability, 4) AS model_probability,
       rule_risk_score, triggered_rules,
       list_concat(CASE WHEN round(probability, 4) >= 0.5
                        THEN [printf('Model Probability: %.1f%%', round(round(probability, 4) * 100, 1))]
                        ELSE []::VARCHAR[] END,
                   CASE WHEN rule_decision IN ('BLOCKED', 'PENDING_OTP')
                        THEN triggered_rules ELSE []::VARCHAR[] END) AS flagged_reasons,
       scoring_latency_ms, ts AS "timestamp",
       CASE WHEN greatest(round(probability, 4), rule_risk_score) >= {C.ALERT_BLOCK_AT}
            THEN 'BLOCKED' ELSE 'PENDING_OTP' END AS status,
       entries, event_id, beneficiary
FROM ({SCORED_SQL}) s WHERE {_FLAGGED}
"""

REGISTRY_SQL = f"""
SELECT alert_id, transaction_id, amount, channel, location, {_RISK} AS risk_score,
       CASE WHEN {_RISK} >= {C.ALERT_BLOCK_AT} THEN 'BLOCKED' ELSE 'PENDING_OTP' END AS status,
       strftime("timestamp", '%Y-%m-%dT%H:%M:%S') AS "timestamp"
FROM ({ALERTS_SQL}) a
"""

_ALERT_COLS = ("alert_id, transaction_id, amount, channel, location, model_probability, "
               "rule_risk_score, triggered_rules, flagged_reasons, scoring_latency_ms, \"timestamp\", status")


@register("alerts", f"SELECT {_ALERT_COLS} FROM ({ALERTS_SQL}) a")
def alerts(spark, sf):
    return alerts_df(spark, sf).drop("shap_values")


@register("alert_registry", REGISTRY_SQL)
def alert_registry(spark, sf):
    return registry_df(spark, sf)


@register("recent_alerts", f"""
SELECT * FROM ({REGISTRY_SQL}) r ORDER BY "timestamp" DESC, alert_id LIMIT 100""")
def recent_alerts(spark, sf):
    return RP.recent(registry_df(spark, sf), 100)


_ACTIONS_SQL = f"""
SELECT alert_id, 'BLOCKED' AS action, 'analyst_1' AS actor, "timestamp" + INTERVAL 1 HOUR AS acted_at
FROM ({ALERTS_SQL}) a WHERE event_id % 7 = 0
UNION ALL
SELECT alert_id, 'FALSE_POSITIVE' AS action, 'analyst_2' AS actor, "timestamp" + INTERVAL 2 HOUR AS acted_at
FROM ({ALERTS_SQL}) a WHERE event_id % 11 = 0"""


def actions_df(spark, sf):
    """Analyst action log projected from the alert table (append-only)."""
    base = A.build_alerts(scored_tx(spark, sf).withColumn("__eid", F.col("event_id")))
    a1 = base.where(F.pmod("__eid", F.lit(7)) == 0).select(
        "alert_id", F.lit("BLOCKED").alias("action"), F.lit("analyst_1").alias("actor"),
        (F.col("timestamp") + F.expr("INTERVAL 1 HOUR")).alias("acted_at"))
    a2 = base.where(F.pmod("__eid", F.lit(11)) == 0).select(
        "alert_id", F.lit("FALSE_POSITIVE").alias("action"), F.lit("analyst_2").alias("actor"),
        (F.col("timestamp") + F.expr("INTERVAL 2 HOUR")).alias("acted_at"))
    return a1.unionByName(a2)


@register("alert_actions", f"""
SELECT a.alert_id, a.transaction_id, coalesce(l.action, a.status) AS status,
       l.actor AS flagged_by, l.acted_at AS flagged_at
FROM ({ALERTS_SQL}) a
LEFT JOIN (SELECT alert_id, arg_max(action, acted_at) AS action, arg_max(actor, acted_at) AS actor, max(acted_at) AS acted_at
           FROM ({_ACTIONS_SQL}) x GROUP BY alert_id) l ON a.alert_id = l.alert_id""")
def alert_actions(spark, sf):
    return A.apply_actions(alerts_df(spark, sf), actions_df(spark, sf))


_PRETTY = "replace(replace({x}, 'channel_', 'Channel: '), 'source_dataset_', 'Pipeline: ')"


@register("top_reasons", f"""
SELECT alert_id, CAST(i AS INTEGER) AS rank, {_PRETTY.format(x='e.feature')} AS feature, round(e.value, 4) AS shap_value,
       CASE WHEN e.value > 0 THEN 'INCREASES' ELSE 'DECREASES' END AS direction,
       printf('%.2f%%', round(abs(e.value) * 100, 2)) AS impact_pct
FROM (SELECT alert_id, unnest(list_slice(entries, 1, 3)) AS e, unnest(range(1, 4)) AS i
      FROM ({ALERTS_SQL}) a) t""")
def top_reasons(spark, sf):
    return A.top_reasons(alerts_df(spark, sf), 3)


def _line_sql(i: int) -> str:
    e = f"entries[{i}]"
    return (f"printf('  %d. %s (%s%.3f)', {i}, {_PRETTY.format(x=e + '.feature')}, "
            f"CASE WHEN {e}.value > 0 THEN '+' ELSE '-' END, round(abs({e}.value), 3))")


# Every row carries all 13 contributions, so the top three always exist.
_LINES = " || chr(10) || ".join(_line_sql(i) for i in (1, 2, 3))


@register("notification_outbox", f"""
SELECT alert_id, transaction_id, 'sms' AS channel,
       '[{A.BRAND}] FRAUD ALERT' || chr(10) || 'Tx: ' || transaction_id || chr(10)
       || 'Amount: NGN ' || format('{{:,.0f}}', amount) || chr(10)
       || 'Channel: ' || channel || ' | ' || location || chr(10)
       || 'Time: ' || strftime("timestamp", '%Y-%m-%d %H:%M') || chr(10)
       || 'Confidence: ' || printf('%.1f%%', round(greatest(model_probability, rule_risk_score) * 100, 1)) || chr(10)
       || 'Top Risk Factors:' || chr(10) || {_LINES} || chr(10)
       || '-- Auto-blocked by {A.BRAND} --' AS message,
       'QUEUED' AS delivery_status
FROM ({ALERTS_SQL}) a
WHERE greatest(model_probability, rule_risk_score) >= {C.NOTIFY_AT}""")
def notification_outbox(spark, sf):
    return A.outbox(alerts_df(spark, sf))


@register("importance", f"""
SELECT feature, mean_abs, mean_signed,
       CAST(row_number() OVER (ORDER BY mean_abs DESC, feature) AS INTEGER) AS rank
FROM (SELECT e.feature AS feature, round(avg(abs(e.value)), 6) AS mean_abs, round(avg(e.value), 6) AS mean_signed
      FROM (SELECT unnest(entries) AS e FROM ({SCORED_SQL}) s) t GROUP BY e.feature) g""")
def importance(spark, sf):
    return A.importance(scored_tx(spark, sf))


@register("waterfall", f"""
WITH g AS (SELECT alert_id, CASE WHEN i <= 8 THEN i ELSE 9 END AS step,
                  CASE WHEN i <= 8 THEN e.feature ELSE 'OTHER' END AS feature,
                  sum(CAST(e.value AS DECIMAL(18,6))) AS contribution
           FROM (SELECT alert_id, unnest(entries) AS e, unnest(range(1, len(entries) + 1)) AS i
                 FROM ({ALERTS_SQL}) a) t
           GROUP BY ALL),
t AS (SELECT alert_id, CAST({C.LOGODDS_BASE} AS DECIMAL(18,6)) + sum(contribution) AS total FROM g GROUP BY alert_id)
SELECT alert_id, CAST(step AS INTEGER) AS step, feature, CAST(contribution AS DOUBLE) AS contribution,
       CAST(CAST({C.LOGODDS_BASE} AS DECIMAL(18,6))
            + sum(contribution) OVER (PARTITION BY alert_id ORDER BY step
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running_log_odds,
       CAST(NULL AS DOUBLE) AS probability
FROM g
UNION ALL SELECT alert_id, 0, 'BASE', {C.LOGODDS_BASE}, {C.LOGODDS_BASE}, NULL FROM t
UNION ALL SELECT alert_id, 10, 'TOTAL', CAST(total AS DOUBLE), CAST(total AS DOUBLE),
                 round(1.0 / (1.0 + exp(-CAST(total AS DOUBLE))), 6) FROM t""")
def waterfall(spark, sf):
    return A.waterfall(alerts_df(spark, sf))


@register("alert_kpis", f"""
SELECT count(*) AS n_alerts, CAST(coalesce(sum(CAST(amount AS DECIMAL(20,2))), 0) AS DOUBLE) AS total_amount_flagged,
       count(*) FILTER (WHERE status = 'BLOCKED') AS blocked,
       count(*) FILTER (WHERE status = 'PENDING_OTP') AS pending,
       round(coalesce(avg(risk_score), 0.0), 6) AS avg_risk,
       count(*) FILTER (WHERE risk_score >= {C.HIGH_RISK_AT}) AS high_risk
FROM ({REGISTRY_SQL}) r""")
def alert_kpis(spark, sf):
    return RP.alert_kpis(registry_df(spark, sf))


def _top_sql(col: str) -> str:
    return (f"(SELECT '{col}' AS dimension, {col} AS value, count(*) AS n FROM ({REGISTRY_SQL}) r "
            f"GROUP BY {col} ORDER BY n DESC, {col} LIMIT 1)")


@register("top_channel_location", f"{_top_sql('channel')} UNION ALL {_top_sql('location')}")
def top_channel_location(spark, sf):
    reg = registry_df(spark, sf)
    ch = RP.top_value(reg, "channel").select(F.lit("channel").alias("dimension"), "value", "n")
    loc = RP.top_value(reg, "location").select(F.lit("location").alias("dimension"), "value", "n")
    return ch.unionByName(loc)


@register("fraud_patterns", f"""
SELECT pattern, incidents, round(incidents * 100.0 / sum(incidents) OVER (), 2) AS pct_of_total, avg_amount
FROM (SELECT pattern, count(*) AS incidents, round(avg(amount), 2) AS avg_amount
      FROM (SELECT unnest(triggered_rules) AS pattern, amount FROM ({ALERTS_SQL}) a) x
      GROUP BY pattern) g""")
def fraud_patterns(spark, sf):
    return RP.fraud_patterns(alerts_df(spark, sf))


_GEO_SQL = "(VALUES " + ", ".join(f"({Q.q(s)}, {la}, {lo})" for s, la, lo in C.GEO) + ") AS g(state, lat, lon)"


@register("geo_incidents", f"""
SELECT a.location, g.state, g.lat, g.lon, a.incidents, a.amount_ngn
FROM (SELECT location, count(*) AS incidents, CAST(sum(CAST(amount AS DECIMAL(20,2))) AS DOUBLE) AS amount_ngn
      FROM ({ALERTS_SQL}) x GROUP BY location) a
LEFT JOIN (SELECT regexp_replace(state, ' \\(.*\\)$', '') AS city, state, CAST(lat AS DOUBLE) AS lat,
                  CAST(lon AS DOUBLE) AS lon FROM {_GEO_SQL}) g
  ON a.location = g.city""")
def geo_incidents(spark, sf):
    return RP.geo_incidents(alerts_df(spark, sf), geo(spark))


@register("top_beneficiaries", f"""
SELECT beneficiary, count(*) AS flagged, CAST(sum(CAST(amount AS DECIMAL(20,2))) AS DOUBLE) AS amount
FROM ({ALERTS_SQL}) a GROUP BY beneficiary ORDER BY flagged DESC, beneficiary LIMIT 10""")
def top_beneficiaries(spark, sf):
    return RP.top_counts(A.build_alerts(scored_tx(spark, sf), ["beneficiary"]), "beneficiary", 10)


@register("daily_trend", f"""
WITH t AS (SELECT CAST(ts AS DATE) AS day, count(*) AS total FROM ({Q.TX_BASE}) x GROUP BY 1),
f AS (SELECT CAST("timestamp" AS DATE) AS day, count(*) AS flagged FROM ({ALERTS_SQL}) a GROUP BY 1),
cal AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM t)
SELECT cal.day, coalesce(t.total, 0) AS total, coalesce(f.flagged, 0) AS flagged
FROM cal LEFT JOIN t ON cal.day = t.day LEFT JOIN f ON cal.day = f.day""")
def daily_trend(spark, sf):
    s = scored_tx(spark, sf)
    return RP.daily_trend(V.transactions(spark, sf), A.build_alerts(s))


@register("latency_stats", f"""
SELECT count(scoring_latency_ms) AS n, round(avg(scoring_latency_ms), 6) AS mean_ms,
       round(max(scoring_latency_ms), 6) AS max_ms,
       round(quantile_cont(scoring_latency_ms, 0.95), 6) AS p95_ms,
       avg(scoring_latency_ms) < {C.LATENCY_TARGET_MS} AND quantile_cont(scoring_latency_ms, 0.95) < {C.LATENCY_TARGET_MS}
         AS meets_target
FROM ({Q.TX_BASE}) t""")
def latency_stats(spark, sf):
    return RP.latency_stats(V.transactions(spark, sf))
