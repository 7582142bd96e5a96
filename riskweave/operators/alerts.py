"""Alert tables, registry, analyst actions, notification outbox and
contribution-based explanations (P16-P18, J5, U3, G6, T3-T9, M15, A17, A18, W3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.core import rnd
from ..functions import rules as R
from ..functions.scoring import pretty_feature

BRAND = "riskweave"


def alert_id(transaction_id: Column) -> Column:
    """Deterministic alert id (replayed messages map to the same alert); the whole hash, so ids never meet."""
    return F.concat(F.lit("ALT"), F.upper(F.sha2(transaction_id, 256)))


def build_alerts(scored: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Alert rows from scored transactions flagged by R11.

    ``scored`` needs transaction_id, amount, channel, location, ts,
    probability, prediction, rule_risk_score, rule_decision, triggered_rules,
    contributions and (optionally) scoring_latency_ms; ``extra`` columns are
    carried along.  The probability is rounded to four decimals first, and
    flag, risk and status all follow from the rounded value.
    """
    prob = rnd("probability", 4)
    flag, reasons = R.stream_flag(F.col("prediction"), prob, F.col("rule_decision"), F.col("triggered_rules"))
    risk = F.greatest(prob, F.col("rule_risk_score"))
    lat = (F.col("scoring_latency_ms") if "scoring_latency_ms" in scored.columns
           else F.lit(None).cast("double"))
    return scored.where(flag).select(
        alert_id(F.col("transaction_id")).alias("alert_id"),
        "transaction_id", "amount", "channel", "location",
        prob.alias("model_probability"),
        "rule_risk_score", "triggered_rules", reasons.alias("flagged_reasons"),
        lat.alias("scoring_latency_ms"),
        F.col("ts").alias("timestamp"),
        F.col("contributions").alias("shap_values"),
        R.alert_status(risk).alias("status"), *extra)


def registry(alerts: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Normalised alert registry: risk = max(prob, rule), two-tier status,
    timestamp text cut to seconds (P17); historical rows merged once (U3)."""
    risk = F.greatest(F.coalesce("model_probability", F.lit(0.0)),
                      F.coalesce("rule_risk_score", F.lit(0.0)))
    reg = alerts.select(
        "alert_id", "transaction_id", "amount", "channel", "location",
        risk.alias("risk_score"), R.alert_status(risk).alias("status"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))
    if history is not None:
        # Live alerts win over a historical copy of the same id.
        reg = reg.unionByName(history.join(reg.select("alert_id"), "alert_id", "left_anti"))
    return reg


def apply_actions(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Latest analyst action per alert wins (J5); append-only action log.

    ``actions``: alert_id, action (new status), actor, acted_at.  The per-alert
    reduction is ``max_by`` (combinable), so hot alerts cost nothing extra.
    """
    last = actions.groupBy("alert_id").agg(
        F.max_by(F.struct("action", "actor", "acted_at"),
                 F.struct("acted_at", "action", "actor")).alias("a"))
    j = alerts.join(last, "alert_id", "left")
    return j.select("alert_id", "transaction_id",
                    F.coalesce(F.col("a.action"), F.col("status")).alias("status"),
                    F.col("a.actor").alias("flagged_by"), F.col("a.acted_at").alias("flagged_at"))


def _sorted_entries(m: Column) -> Column:
    """Map entries ordered by |value| desc, then feature order, as structs."""
    idx = {n: i for i, n in enumerate(C.FEATURES)}
    order = F.create_map(*[x for n, i in idx.items() for x in (F.lit(n), F.lit(i))])
    ent = F.transform(F.map_entries(m), lambda e: F.struct(
        (-F.abs(e["value"])).alias("neg_abs"), F.coalesce(order[e["key"]], F.lit(99)).alias("idx"),
        e["key"].alias("feature"), e["value"].alias("value")))
    return F.array_sort(ent)


def top_reasons(alerts: DataFrame, n: int = 3) -> DataFrame:
    """Top-n contributions per alert by absolute value with direction and impact."""
    top = F.slice(_sorted_entries(F.col("shap_values")), 1, n)
    ex = alerts.select("alert_id", F.posexplode(top).alias("pos", "e"))
    v = F.col("e.value")
    return ex.select("alert_id", (F.col("pos") + 1).alias("rank"),
                     pretty_feature(F.col("e.feature")).alias("feature"),
                     rnd(v, 4).alias("shap_value"),
                     F.when(v > 0, C.INCREASES).otherwise(C.DECREASES).alias("direction"),
                     F.format_string("%.2f%%", rnd(F.abs(v) * 100, 2)).alias("impact_pct"))


def message_text(alerts: DataFrame) -> Column:
    """Seven-line alert message with the top three reasons."""
    top = F.slice(_sorted_entries(F.col("shap_values")), 1, 3)
    lines = F.transform(top, lambda e, i: F.format_string(
        "  %d. %s (%s%.3f)", i + 1, pretty_feature(e["feature"]),
        F.when(e["value"] > 0, F.lit("+")).otherwise(F.lit("-")), rnd(F.abs(e["value"]), 3)))
    rules3 = F.transform(F.slice(F.col("triggered_rules"), 1, 3),
                         lambda r, i: F.format_string("  %d. %s", i + 1, r))
    reasons = (F.when(F.size(lines) > 0, F.array_join(lines, "\n"))
                .when(F.size(rules3) > 0, F.array_join(rules3, "\n"))
                .otherwise(F.lit("  N/A")))
    conf = rnd(F.greatest(F.col("model_probability"), F.col("rule_risk_score")) * 100, 1)
    return F.concat(
        F.lit(C.MESSAGE_HEADER.format(brand=BRAND) + "\nTx: "), F.col("transaction_id"),
        F.lit("\nAmount: NGN "), F.format_number(F.col("amount"), 0),
        F.lit("\nChannel: "), F.col("channel"), F.lit(" | "), F.col("location"),
        F.lit("\nTime: "), F.date_format("timestamp", "yyyy-MM-dd HH:mm"),
        F.lit("\nConfidence: "), F.format_string("%.1f%%", conf),
        F.lit("\n" + C.MESSAGE_FACTORS + "\n"), reasons,
        F.lit("\n" + C.MESSAGE_FOOTER.format(brand=BRAND)))


def outbox(alerts: DataFrame, threshold: float = C.NOTIFY_AT, channel: str = "sms") -> DataFrame:
    """Notification outbox: alerts at or above the gate, one message each.

    Delivery is a separate consumer of this table; nothing here sends.
    """
    gate = F.greatest(F.col("model_probability"), F.col("rule_risk_score")) >= threshold
    return alerts.where(gate).select(
        "alert_id", "transaction_id", F.lit(channel).alias("channel"),
        message_text(alerts).alias("message"), F.lit("QUEUED").alias("delivery_status"))


def importance(scored: DataFrame, features=C.FEATURES) -> DataFrame:
    """Mean |contribution| (A17) and signed mean (A18) per feature, ranked: one aggregate over the map column."""
    m = F.col("contributions")
    aggs = [x for i, n in enumerate(features) for x in (rnd(F.avg(F.abs(m[n])), 6).alias(f"a{i}"),
                                                        rnd(F.avg(m[n]), 6).alias(f"s{i}"))]
    long = scored.agg(*aggs).select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(f"a{i}").alias("mean_abs"), F.col(f"s{i}").alias("mean_signed"))
        for i, n in enumerate(features)])))
    return long.select("feature", "mean_abs", "mean_signed",
                       F.row_number().over(Window.orderBy(F.desc("mean_abs"), "feature")).alias("rank"))


def waterfall(alerts: DataFrame, base: float = C.LOGODDS_BASE, top_n: int = 8) -> DataFrame:
    """Per alert: base, top-n contributions, OTHER, total with its probability.

    Everything is computed inside the row from the sorted contributions, so
    the only step is one explode: no shuffle.
    """
    zero = F.lit(0).cast("decimal(38,6)")
    dec = lambda c: c.cast("decimal(18,6)").cast("decimal(38,6)")
    total = lambda arr: F.aggregate(arr, zero, lambda acc, e: (acc + dec(e["value"])).cast("decimal(38,6)"))
    ent = F.col("__e")
    rest = F.slice(ent, top_n + 1, F.greatest(F.size(ent) - top_n, F.lit(0)))
    top = F.transform(F.slice(ent, 1, top_n), lambda e, i: F.struct(
        (i + 1).alias("step"), e["feature"].alias("feature"), dec(e["value"]).alias("c"),
        (F.lit(base).cast("decimal(38,6)") + total(F.slice(ent, 1, i + 1))).cast("decimal(38,6)").alias("run")))
    end = (F.lit(base).cast("decimal(38,6)") + total(ent)).cast("decimal(38,6)")
    row = lambda step, name, c, run: F.struct(F.lit(step).alias("step"), F.lit(name).alias("feature"), c.alias("c"), run.alias("run"))
    first = F.array(row(0, "BASE", F.lit(base).cast("decimal(38,6)"), F.lit(base).cast("decimal(38,6)")))
    other = F.when(F.size(ent) > top_n, F.array(row(top_n + 1, "OTHER", total(rest), end))).otherwise(F.array().cast(
        "array<struct<step:int,feature:string,c:decimal(38,6),run:decimal(38,6)>>"))
    last = F.array(row(top_n + 2, "TOTAL", end, end))
    ex = (alerts.withColumn("__e", _sorted_entries(F.col("shap_values")))
          .select("alert_id", F.explode(F.concat(first, top, other, last)).alias("r")))
    run = F.col("r.run").cast("double")
    return ex.select("alert_id", F.col("r.step").alias("step"), F.col("r.feature").alias("feature"),
                     F.col("r.c").cast("double").alias("contribution"), run.alias("running_log_odds"),
                     F.when(F.col("r.feature") == "TOTAL", rnd(1.0 / (1.0 + F.exp(-run)), 6)).alias("probability"))
