"""Queries over transactions: rules, decisions, velocity, identifiers, scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.core import rnd
from ..functions import identity as I
from ..functions import rules as R
from ..functions import scoring as S
from ..operators import risk
from ..operators.velocity import windowed_count, history_as_of
from ..sources import views as V
from . import sqlfrag as Q
from .registry import register

# The test tables are sparse (about 150 senders over 30 days), so the
# registered velocity rule uses a threshold of 2 prior transactions in the
# hour to exercise the branch; the library default stays 5.
VEL_T = 2

_RULED = Q.rules_sql(Q.TX_VELOCITY, VEL_T)


def ruled(spark, sf):
    return risk.apply_rules(V.transactions(spark, sf, with_velocity=True), VEL_T)


@register("rule_decisions", f"""
SELECT transaction_id, tx_count_last_hour, triggered_rules, rule_risk_score, rule_decision
FROM ({_RULED}) r""")
def rule_decisions(spark, sf):
    return ruled(spark, sf).select("transaction_id", "tx_count_last_hour", "triggered_rules",
                                   "rule_risk_score", "rule_decision")


@register("rule_flags", f"""
SELECT rule, count(*) AS n_triggered,
       CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount_total
FROM (SELECT unnest(triggered_rules) AS rule, amount FROM ({_RULED}) r) x
GROUP BY rule""")
def rule_flags(spark, sf):
    r = ruled(spark, sf).select(F.explode("triggered_rules").alias("rule"), "amount")
    return r.groupBy("rule").agg(
        F.count(F.lit(1)).alias("n_triggered"),
        F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("amount_total"))


@register("decision_distribution", f"""
SELECT rule_decision, n, round(n * 100.0 / sum(n) OVER (), 2) AS pct
FROM (SELECT rule_decision, count(*) AS n FROM ({_RULED}) r GROUP BY rule_decision) g""")
def decision_distribution(spark, sf):
    g = ruled(spark, sf).groupBy("rule_decision").agg(F.count(F.lit(1)).alias("n"))
    # The window runs over the (at most three-row) aggregate only.
    return g.select("rule_decision", "n",
                    rnd(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 2).alias("pct"))


_ZSTATS = """(SELECT avg(amount) AS m,
        CASE WHEN coalesce(stddev_pop(amount), 0) > 0 THEN stddev_pop(amount) ELSE 1.0 END AS s
 FROM events_tx)"""


def _zsql(src_alias: str) -> str:
    return (f"CAST(CASE WHEN abs({src_alias}.amount - st.m) / st.s > 3.0 THEN 0.85 "
            f"WHEN abs({src_alias}.amount - st.m) / st.s > 2.0 THEN 0.60 ELSE 0.15 END AS DOUBLE)")


@register("zscore_anomaly", f"""
WITH events_tx AS ({Q.TX_BASE})
SELECT t.transaction_id, t.amount, round(st.m, 6) AS train_mean, round(st.s, 6) AS train_std,
       {_zsql('t')} AS anomaly_score
FROM events_tx t, {_ZSTATS} st""")
def zscore_anomaly(spark, sf):
    tx = V.transactions(spark, sf)
    z = risk.zscore_anomaly(tx.select("transaction_id", "amount"), tx)
    return z.select("transaction_id", "amount", rnd("train_mean", 6).alias("train_mean"),
                    rnd("train_std", 6).alias("train_std"), "anomaly_score")


@register("combined_decision", f"""
WITH events_tx AS ({_RULED})
SELECT transaction_id, rule_risk_score, anomaly_score,
       greatest(rule_risk_score, anomaly_score) AS combined_risk,
       CASE WHEN greatest(rule_risk_score, anomaly_score) >= 0.8 THEN 'BLOCKED'
            WHEN greatest(rule_risk_score, anomaly_score) >= 0.5 THEN 'PENDING_OTP'
            ELSE 'APPROVED' END AS combined_decision
FROM (SELECT t.*, {_zsql('t')} AS anomaly_score FROM events_tx t, {_ZSTATS} st) x""")
def combined_decision(spark, sf):
    r = ruled(spark, sf)
    z = risk.zscore_anomaly(r, r)
    risk_c, dec = R.combined_decision(F.col("rule_risk_score"), F.col("anomaly_score"))
    return z.select("transaction_id", "rule_risk_score", "anomaly_score",
                    risk_c.alias("combined_risk"), dec.alias("combined_decision"))


_FEAT_SQL_COLS = (
    f"least(coalesce(amount, 0.0) / {C.SERVE_AMOUNT_SCALE}, 1.0) AS amount, "
    + ", ".join(
        f"CASE WHEN {Q.case('upper(coalesce(channel, ' + Q.q('MOBILEAPP') + '))', C.EVENT_CHANNEL_TO_MODEL, Q.q(C.EVENT_CHANNEL_DEFAULT_MODEL))} = {Q.q(c)} THEN 1 ELSE 0 END AS channel_{c}"
        for c in C.CHANNELS)
    + ', 0 AS "source_dataset_IEEE-CIS", 1 AS "source_dataset_PaySim"')
_FEATURES_SQL = f"SELECT transaction_id, {_FEAT_SQL_COLS} FROM ({Q.TX_BASE}) t"


def event_features(spark, sf):
    tx = V.transactions(spark, sf)
    return tx.select("transaction_id", *S.event_features(F.col("amount"), F.col("channel")))


@register("scaled_features", _FEATURES_SQL)
def scaled_features(spark, sf):
    return event_features(spark, sf)


@register("reverse_one_hot", f"""
SELECT transaction_id,
       coalesce({', '.join(f"CASE WHEN channel_{c} = 1 THEN {Q.q(c)} END" for c in C.CHANNELS)},
                'UNKNOWN') AS model_channel
FROM ({_FEATURES_SQL}) f""")
def reverse_one_hot(spark, sf):
    f = event_features(spark, sf)
    return f.select("transaction_id", S.reverse_one_hot(f.columns).alias("model_channel"))


def _logodds_sql(src: str) -> str:
    amount_c = f"round(amount * {C.LOGODDS_AMOUNT}, 4)"
    flag_terms = [f"CASE WHEN CAST(\"{n}\" AS INTEGER) = 1 THEN {on} ELSE {off} END"
                  for n, on, off in C.LOGODDS_FLAGS]
    # Same summation order as the Spark expression: amount then flags in feature order.
    order = [n for n in C.FEATURES if n == "amount" or n in {x for x, _, _ in C.LOGODDS_FLAGS}]
    terms = {"amount": amount_c, **{n: t for (n, _, _), t in zip(C.LOGODDS_FLAGS, flag_terms)}}
    total = terms[order[0]]
    for n in order[1:]:
        total = f"({total} + {terms[n]})"
    lo = f"({C.LOGODDS_BASE} + {total})"
    return f"SELECT *, {lo} AS log_odds, 1.0 / (1.0 + exp(-{lo})) AS probability FROM ({src}) s"


_LOGODDS = _logodds_sql(_FEATURES_SQL)


@register("logodds_score", f"""
SELECT transaction_id, round(log_odds, 6) AS log_odds, round(probability, 6) AS probability,
       CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS prediction
FROM ({_LOGODDS}) s""")
def logodds_score(spark, sf):
    s = risk.logodds_from_features(event_features(spark, sf), with_map=False)
    return s.select("transaction_id", rnd("log_odds", 6).alias("log_odds"),
                    rnd("probability", 6).alias("probability"), "prediction")


@register("stream_flag_reasons", f"""
WITH s AS ({_LOGODDS}), r AS ({_RULED})
SELECT r.transaction_id, round(s.probability, 4) AS fraud_probability,
       (s.probability >= 0.5 OR r.rule_decision IN ('BLOCKED', 'PENDING_OTP')) AS is_anomaly,
       list_concat(CASE WHEN s.probability >= 0.5
                        THEN [printf('Model Probability: %.1f%%', round(s.probability * 100, 1))]
                        ELSE []::VARCHAR[] END,
                   CASE WHEN r.rule_decision IN ('BLOCKED', 'PENDING_OTP')
                        THEN r.triggered_rules ELSE []::VARCHAR[] END) AS flagged_reasons
FROM r JOIN s ON r.transaction_id = s.transaction_id""")
def stream_flag_reasons(spark, sf):
    tx = V.transactions(spark, sf, with_velocity=True)
    r = risk.apply_rules(tx, VEL_T)
    feats = S.event_features(F.col("amount"), F.col("channel"))
    fdf = r.select("transaction_id", "triggered_rules", "rule_decision", *feats)
    s = risk.logodds_from_features(fdf, with_map=False)
    flag, reasons = R.stream_flag(F.col("prediction"), F.col("probability"),
                                  F.col("rule_decision"), F.col("triggered_rules"))
    return s.select("transaction_id", rnd("probability", 4).alias("fraud_probability"),
                    flag.alias("is_anomaly"), reasons.alias("flagged_reasons"))


@register("anomaly_features", f"""
SELECT transaction_id, coalesce(TRY_CAST(amount AS DOUBLE), 0.0) AS amount,
       CAST(coalesce(hour(ts), 12) AS INTEGER) AS hour,
       {Q.case('upper(channel)', C.ANOMALY_CHANNEL_CODE, str(C.ANOMALY_CHANNEL_DEFAULT))} AS channel_encoded,
       {Q.case('upper(location)', C.ANOMALY_LOCATION_CODE, str(C.ANOMALY_LOCATION_DEFAULT))} AS location_encoded,
       coalesce(tx_count_last_hour, 0) AS tx_count_last_hour
FROM ({Q.TX_VELOCITY}) t""")
def anomaly_features(spark, sf):
    tx = V.transactions(spark, sf, with_velocity=True)
    return tx.select("transaction_id", *S.anomaly_features(
        F.col("amount"), F.col("ts"), F.col("channel"), F.col("location"), F.col("tx_count_last_hour")))


@register("velocity_1h", f"""
SELECT transaction_id, sender, ts, tx_count_last_hour FROM ({Q.TX_VELOCITY}) t""")
def velocity_1h(spark, sf):
    return V.transactions(spark, sf, with_velocity=True).select(
        "transaction_id", "sender", "ts", "tx_count_last_hour")


@register("ussd_daily_cap", f"""
SELECT transaction_id, sender, ussd_day_total, ussd_day_total > {C.USSD_DAILY_LIMIT} AS over_daily_cap
FROM (SELECT transaction_id, sender,
             sum(amount) OVER (PARTITION BY sender, CAST(ts AS DATE) ORDER BY ts
                               RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ussd_day_total
      FROM ({Q.TX_BASE}) t WHERE channel = 'USSD') x""")
def ussd_daily_cap(spark, sf):
    from ..operators.velocity import day_running_sum
    tx = V.transactions(spark, sf).where(F.col("channel") == "USSD")
    d = day_running_sum(tx, ["sender"], "ts", "amount", "ussd_day_total")
    return d.select("transaction_id", "sender", "ussd_day_total",
                    (F.col("ussd_day_total") > C.USSD_DAILY_LIMIT).alias("over_daily_cap"))


@register("same_beneficiary", f"""
SELECT transaction_id, sender, beneficiary, n_same_1h, n_same_1h >= {C.MAX_SAME_BENEFICIARY_PER_HOUR} AS split_flag
FROM (SELECT transaction_id, sender, beneficiary,
             CAST(count(*) OVER (PARTITION BY sender, beneficiary ORDER BY ts
                  RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS INTEGER) AS n_same_1h
      FROM ({Q.TX_BASE}) t) x""")
def same_beneficiary(spark, sf):
    tx = V.transactions(spark, sf).select("transaction_id", "sender", "beneficiary", "ts")
    d = windowed_count(tx, ["sender", "beneficiary"], "ts", 3600, "n_same_1h", include_self=True)
    return d.select("transaction_id", "sender", "beneficiary", "n_same_1h",
                    (F.col("n_same_1h") >= C.MAX_SAME_BENEFICIARY_PER_HOUR).alias("split_flag"))


@register("location_history", f"""
WITH t AS ({Q.TX_BASE})
SELECT t.transaction_id, t.sender, t.location,
       coalesce((SELECT list_sort(list_distinct(list(t2.location))) FROM t t2
                 WHERE t2.sender = t.sender AND t2.ts < t.ts), []::VARCHAR[]) AS prior_locations
FROM t""")
def location_history(spark, sf):
    tx = V.transactions(spark, sf).select("transaction_id", "sender", "location", "ts")
    h = history_as_of(tx, "sender", "ts", "location", "transaction_id", "prior_locations")
    return h.select("transaction_id", "sender", "location", "prior_locations")


def _nuban_sql(acc: str, bank: str) -> str:
    return (f"CASE WHEN coalesce(regexp_full_match({acc}, '[0-9]{{10}}'), false) "
            f"AND coalesce(regexp_full_match({bank}, '[0-9]{{3}}'), false) "
            f"THEN {Q.nuban_digit_sql(bank, f'substr({acc}, 1, 9)')} = CAST(substr({acc}, 10, 1) AS INTEGER) "
            f"ELSE false END")


@register("account_check", f"""
SELECT transaction_id, bank_code, account, {_nuban_sql('account', 'bank_code')} AS account_valid
FROM ({Q.TX_BASE}) t""")
def account_check(spark, sf):
    tx = V.transactions(spark, sf)
    return tx.select("transaction_id", "bank_code", "account",
                     I.nuban_valid(F.col("account"), F.col("bank_code")).alias("account_valid"))


@register("bvn_hash", f"""
SELECT transaction_id, coalesce(regexp_full_match(bvn, '[0-9]{{11}}'), false) AS bvn_valid,
       CASE WHEN coalesce(regexp_full_match(bvn, '[0-9]{{11}}'), false) THEN sha256(bvn) END AS bvn_sha256
FROM ({Q.TX_BASE}) t""")
def bvn_hash(spark, sf):
    tx = V.transactions(spark, sf)
    return tx.select("transaction_id", I.bvn_valid(F.col("bvn")).alias("bvn_valid"),
                     I.bvn_hash(F.col("bvn")).alias("bvn_sha256"))


_BANKS_SQL = "(VALUES " + ", ".join(f"({Q.q(c)}, {Q.q(n)})" for c, n in C.BANKS) + ") AS b(code, name)"


@register("bank_lookup", f"""
SELECT t.bank_code, coalesce(b.name, {Q.q(C.UNKNOWN_BANK)}) AS bank_name, count(*) AS n_transactions,
       CAST(sum(CASE WHEN {_nuban_sql('t.account', 't.bank_code')} THEN 1 ELSE 0 END) AS BIGINT) AS n_valid_accounts
FROM ({Q.TX_BASE}) t LEFT JOIN {_BANKS_SQL} ON t.bank_code = b.code
GROUP BY t.bank_code, coalesce(b.name, {Q.q(C.UNKNOWN_BANK)})""")
def bank_lookup(spark, sf):
    from ..operators.reports import bank_summary
    from ..sources.dims import banks
    return bank_summary(V.transactions(spark, sf), banks(spark))
