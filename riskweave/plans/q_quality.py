"""Queries for source alignment, validation, profiling and feature building."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..operators import quality as QL
from ..sources import views as V
from . import sqlfrag as Q
from .registry import register


def merged(spark, sf):
    return QL.merge_sources(V.raw_money(spark, sf), V.raw_card(spark, sf))


@register("merge_sources", Q.COMMON)
def merge_sources(spark, sf):
    return merged(spark, sf)


@register("fraud_summary", f"""
SELECT source_dataset, legitimate, fraudulent, legitimate + fraudulent AS total,
       round(fraudulent * 100.0 / (legitimate + fraudulent), 2) AS fraud_rate_pct
FROM (SELECT source_dataset, count(*) FILTER (WHERE is_fraud = 0) AS legitimate,
             count(*) FILTER (WHERE is_fraud = 1) AS fraudulent
      FROM ({Q.COMMON}) m GROUP BY source_dataset) g""")
def fraud_summary(spark, sf):
    return QL.fraud_summary(merged(spark, sf))


@register("class_counts", f"""
SELECT count(*) FILTER (WHERE is_fraud = 0) AS legitimate,
       count(*) FILTER (WHERE is_fraud = 1) AS fraudulent, count(*) AS total
FROM ({Q.COMMON}) m""")
def class_counts(spark, sf):
    return QL.class_counts(merged(spark, sf))


_PROFILE_COLS = [("transaction_id", "string"), ("amount", "double"), ("is_fraud", "int"),
                 ("channel", "string"), ("source_dataset", "string")]


@register("null_profile", "WITH m AS (" + Q.COMMON + ")\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, '{t}' AS dtype, count({c}) AS non_null, "
    f"count(*) - count({c}) AS nulls FROM m" for c, t in _PROFILE_COLS))
def null_profile(spark, sf):
    return QL.null_profile(merged(spark, sf))


_MONEY_VIOL = ("list_concat(" + ", ".join(
    f"CASE WHEN coalesce({cond}, false) THEN ['{code}'] ELSE []::VARCHAR[] END" for code, cond in [
        ("step_required", "step IS NULL"), ("type_required", "type IS NULL"),
        ("amount_required", "amount IS NULL"), ("amount_negative", "amount < 0"),
        ("label_range", "NOT coalesce(isFraud IN (0, 1), false)")]) + ")")
_CARD_VIOL = ("list_concat(" + ", ".join(
    f"CASE WHEN coalesce({cond}, false) THEN ['{code}'] ELSE []::VARCHAR[] END" for code, cond in [
        ("id_required", "TransactionID IS NULL"), ("amount_required", "TransactionAmt IS NULL"),
        ("amount_negative", "TransactionAmt < 0"),
        ("label_range", "NOT coalesce(isFraud IN (0, 1), false)"),
        ("product_required", "ProductCD IS NULL")]) + ")")
_VIOLATIONS = f"""
SELECT 'PaySim' AS source_dataset, CAST(order_key AS VARCHAR) AS record_id, {_MONEY_VIOL} AS violations
FROM ({Q.RAW_MONEY}) m
UNION ALL
SELECT 'IEEE-CIS' AS source_dataset, TransactionID AS record_id, {_CARD_VIOL} AS violations
FROM ({Q.RAW_CARD}) c"""


def _violations(spark, sf):
    m = QL.validate(V.raw_money(spark, sf), QL.money_checks()).select(
        F.lit("PaySim").alias("source_dataset"), F.col("order_key").cast("string").alias("record_id"),
        "violations")
    c = QL.validate(V.raw_card(spark, sf), QL.card_checks()).select(
        F.lit("IEEE-CIS").alias("source_dataset"), F.col("TransactionID").alias("record_id"),
        "violations")
    return m.unionByName(c)


@register("schema_violations", f"SELECT * FROM ({_VIOLATIONS}) v WHERE len(violations) > 0")
def schema_violations(spark, sf):
    return _violations(spark, sf).where(F.size("violations") > 0)


@register("validation_summary", f"""
SELECT source_dataset, count(*) AS n_rows, count(*) FILTER (WHERE len(violations) > 0) AS n_invalid,
       count(*) FILTER (WHERE len(violations) > 0) <= {C.MAX_INVALID_ROWS} AS passes
FROM ({_VIOLATIONS}) v GROUP BY source_dataset""")
def validation_summary(spark, sf):
    v = _violations(spark, sf)
    g = v.groupBy("source_dataset").agg(F.count(F.lit(1)).alias("n_rows"),
                                        F.count_if(F.size("violations") > 0).alias("n_invalid"))
    return g.withColumn("passes", F.col("n_invalid") <= C.MAX_INVALID_ROWS)


_IMPUTED = f"""
WITH m AS ({Q.COMMON}),
med AS (SELECT (min(amount) FILTER (WHERE rk = (n - 1) // 2)
               + min(amount) FILTER (WHERE rk = n // 2)) / 2 AS v
        FROM (SELECT amount, row_number() OVER (ORDER BY amount) - 1 AS rk, count(*) OVER () AS n
              FROM m WHERE amount IS NOT NULL) s),
md AS (SELECT channel AS v FROM (SELECT channel, count(*) AS n FROM m WHERE channel IS NOT NULL
                                 GROUP BY channel) g ORDER BY n DESC, channel LIMIT 1)
SELECT transaction_id, coalesce(amount, (SELECT v FROM med)) AS amount, is_fraud,
       coalesce(channel, (SELECT v FROM md)) AS channel, source_dataset
FROM m"""


@register("impute", _IMPUTED)
def impute(spark, sf):
    return QL.impute(merged(spark, sf))


_DEDUP = f"""
SELECT min(transaction_id) AS transaction_id, amount, is_fraud, channel, source_dataset
FROM ({_IMPUTED}) i GROUP BY amount, is_fraud, channel, source_dataset"""


@register("dedup", _DEDUP)
def dedup(spark, sf):
    return QL.dedup(QL.impute(merged(spark, sf)))


_ONE_HOT = f"""
SELECT transaction_id, amount, is_fraud,
       {', '.join(f"CASE WHEN channel = '{c}' THEN 1 ELSE 0 END AS channel_{c}" for c in C.CHANNELS)},
       {', '.join(f'CASE WHEN source_dataset = {Q.q(s)} THEN 1 ELSE 0 END AS "source_dataset_{s}"' for s in C.SOURCES)}
FROM ({_DEDUP}) d"""


@register("one_hot", _ONE_HOT)
def one_hot(spark, sf):
    return QL.encode(QL.dedup(QL.impute(merged(spark, sf))))


_MIN_MAX = f"""
SELECT * REPLACE (CASE WHEN st.hi - st.lo = 0 THEN 0.0 ELSE (amount - st.lo) / (st.hi - st.lo) END AS amount)
FROM ({_ONE_HOT}) o, (SELECT min(amount) AS lo, max(amount) AS hi FROM ({_ONE_HOT}) o2) st"""


@register("min_max", f"SELECT * EXCLUDE (lo, hi) FROM ({_MIN_MAX}) x")
def min_max(spark, sf):
    return QL.feature_table(V.raw_money(spark, sf), V.raw_card(spark, sf))


@register("distinct_channels", f"SELECT DISTINCT channel FROM ({_IMPUTED}) i")
def distinct_channels(spark, sf):
    return QL.distinct_categories(QL.impute(merged(spark, sf)), "channel")
