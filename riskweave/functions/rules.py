"""Transaction rules R1-R14 as column expressions, shared by batch and stream."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .core import rnd


def with_defaults(amount, channel, location, history, device_new, velocity, bvn_matched):
    """Apply the event defaults (a NULL behaves like a missing field)."""
    return dict(
        amount=F.coalesce(amount.cast("double"), F.lit(0.0)),
        channel=F.upper(F.coalesce(channel, F.lit(C.DEFAULT_CHANNEL))),
        location=F.coalesce(location, F.lit(C.DEFAULT_LOCATION)),
        history=F.coalesce(history, F.array(F.lit(C.DEFAULT_LOCATION))),
        device_new=F.coalesce(device_new, F.lit(False)),
        velocity=F.coalesce(velocity, F.lit(0)),
        bvn_matched=F.coalesce(bvn_matched, F.lit(True)),
    )


def rule_flags(amount: Column, channel: Column, ts: Column, location: Column,
               history: Column, device_new: Column, velocity: Column,
               bvn_matched: Column, velocity_threshold: int = 5) -> list[tuple[str, Column]]:
    """One boolean column per rule, in rule order. NULL timestamps never fire R3."""
    d = with_defaults(amount, channel, location, history, device_new, velocity, bvn_matched)
    hour = F.hour(ts)
    night = (hour >= C.NIGHT_WINDOW_START) | (hour < C.NIGHT_WINDOW_END)
    flags = [
        ~d["bvn_matched"],
        (d["channel"] == "USSD") & (d["amount"] > C.USSD_SINGLE_LIMIT),
        F.coalesce(night, F.lit(False)) & (d["amount"] >= C.NIGHT_LARGE_AMOUNT),
        d["velocity"] >= velocity_threshold,
        ~F.coalesce(F.array_contains(d["history"], d["location"]), F.lit(False)),
        d["device_new"] & (d["amount"] >= C.NEW_DEVICE_AMOUNT),
    ]
    return [(name, f) for (name, _), f in zip(C.RULES, flags)]


def triggered_rules(flags) -> Column:
    """Names of the fired rules, in rule order."""
    return F.array_compact(F.array(*[F.when(f, F.lit(n)) for n, f in flags]))


def rule_score(flags) -> Column:
    """Maximum weight over the fired rules (0 when none), rounded to 2 dp."""
    return rnd(F.greatest(F.lit(0.0), *[F.when(f, F.lit(C.RULE_WEIGHT[n])).otherwise(0.0)
                                            for n, f in flags]), 2)


def decision(score: Column) -> Column:
    """Three-tier transaction decision."""
    return (F.when(score >= C.BLOCK_AT, C.BLOCKED)
             .when(score >= C.OTP_AT, C.PENDING_OTP)
             .otherwise(C.APPROVED))


def combined_decision(rule: Column, anomaly: Column) -> tuple[Column, Column]:
    """Risk = max(rule, anomaly) and its decision tier."""
    risk = F.greatest(F.coalesce(rule, F.lit(0.0)), F.coalesce(anomaly, F.lit(0.0)))
    return risk, decision(risk)


def alert_status(risk: Column) -> Column:
    """Two-tier alert status."""
    return F.when(risk >= C.ALERT_BLOCK_AT, C.BLOCKED).otherwise(C.PENDING_OTP)


def model_reason(probability: Column) -> Column:
    """Label of an alert that a model alone raised (R13): high from 0.85 on, else suspicious."""
    return F.when(probability >= C.MODEL_HIGH_AT, F.lit(C.MODEL_HIGH)).otherwise(F.lit(C.MODEL_SUSPICIOUS))


def stream_flag(prediction: Column, probability: Column, rule_decision: Column,
                rules: Column) -> tuple[Column, Column]:
    """Flag when the model says fraud or the rules block / ask for OTP, with reasons."""
    model_hit = (prediction == 1) | (probability >= 0.5)
    rule_hit = rule_decision.isin(C.BLOCKED, C.PENDING_OTP)
    pct = F.format_string(C.MODEL_REASON_FORMAT, rnd(probability * 100, 1))
    reasons = F.concat(
        F.when(model_hit, F.array(pct)).otherwise(F.array().cast("array<string>")),
        F.when(rule_hit, rules).otherwise(F.array().cast("array<string>")),
    )
    return model_hit | rule_hit, reasons
