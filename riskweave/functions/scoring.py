"""Feature and score expressions: serving features, additive log-odds scorer,
z-score anomaly score, anomaly features (P12-P15, M11, M12)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .core import lookup, rnd


def serve_amount(amount: Column) -> Column:
    """Fixed-range serving scale: min(amount / 2.5M, 1)."""
    return F.least(F.coalesce(amount.cast("double"), F.lit(0.0)) / C.SERVE_AMOUNT_SCALE,
                   F.lit(1.0))


def model_channel(event_channel: Column) -> Column:
    """Event channel -> model channel (USSD/MOBILEAPP -> TRANSFER, ...)."""
    up = F.upper(F.coalesce(event_channel, F.lit("MOBILEAPP")))
    return lookup(up, C.EVENT_CHANNEL_TO_MODEL, C.EVENT_CHANNEL_DEFAULT_MODEL)


def one_hot(channel: Column, source: Column) -> list[Column]:
    """Pinned 12 one-hot flags (ints); unknown categories give all zeros."""
    cols = [F.when(channel == c, 1).otherwise(0).alias(f"channel_{c}") for c in C.CHANNELS]
    cols += [F.when(source == s, 1).otherwise(0).alias(f"source_dataset_{s}") for s in C.SOURCES]
    return cols


def event_feature_map(amount: Column, event_channel: Column) -> dict[str, Column]:
    """Serving features as unaliased expressions keyed by feature name."""
    ch = model_channel(event_channel)
    out = {"amount": serve_amount(amount)}
    out.update({f"channel_{c}": F.when(ch == c, 1).otherwise(0) for c in C.CHANNELS})
    out.update({f"source_dataset_{s}": F.lit(1 if s == "PaySim" else 0) for s in C.SOURCES})
    return out


def event_features(amount: Column, event_channel: Column) -> list[Column]:
    """13-feature serving vector for a live event (mobile-money source)."""
    ch = model_channel(event_channel)
    return [serve_amount(amount).alias("amount")] + one_hot(ch, F.lit("PaySim"))


def logodds_contributions(feat) -> list[tuple[str, Column]]:
    """Per-feature contributions of the additive scorer, in feature order.

    ``feat`` maps feature name -> Column; absent features count as 0.
    """
    def g(name):
        c = feat.get(name)
        return F.lit(0.0) if c is None else F.coalesce(c.cast("double"), F.lit(0.0))

    flag_rule = {n: (on, off) for n, on, off in C.LOGODDS_FLAGS}
    out = []
    for name in C.FEATURES:
        if name == "amount":
            out.append((name, rnd(g("amount") * C.LOGODDS_AMOUNT, 4)))
        elif name in flag_rule:
            on, off = flag_rule[name]
            out.append((name, F.when(g(name).cast("int") == 1, F.lit(on)).otherwise(F.lit(off))))
        else:
            out.append((name, F.lit(0.0)))
    return out


def logodds_score(contribs, cutoff: float = C.DEFAULT_CUTOFF):
    """(log_odds, probability, prediction) from contributions."""
    total = None
    for name, c in contribs:
        if name in ("amount",) or name in {n for n, _, _ in C.LOGODDS_FLAGS}:
            total = c if total is None else total + c
    log_odds = F.lit(C.LOGODDS_BASE) + total
    prob = F.lit(1.0) / (F.lit(1.0) + F.exp(-log_odds))
    pred = F.when(prob >= cutoff, 1).otherwise(0)
    return log_odds, prob, pred


def contributions_map(contribs) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(n) for n, _ in contribs]),
                             F.array(*[c for _, c in contribs]))


def zscore_score(amount: Column, mean: Column, std: Column) -> Column:
    """0.85 beyond 3 sigma, 0.60 beyond 2 sigma, else 0.15."""
    z = F.abs(F.coalesce(amount, F.lit(0.0)) - mean) / std
    hi, mid, lo = C.ZSCORE_SCORES
    return F.when(z > C.ZSCORE_HIGH, hi).when(z > C.ZSCORE_MID, mid).otherwise(lo)


def anomaly_features(amount: Column, ts: Column, channel: Column, location: Column,
                     velocity: Column) -> list[Column]:
    """Five numeric anomaly features with the reference defaults."""
    return [
        F.coalesce(amount.try_cast("double"), F.lit(0.0)).alias("amount"),
        F.coalesce(F.hour(ts), F.lit(C.ANOMALY_HOUR_DEFAULT)).alias("hour"),
        lookup(F.upper(channel), C.ANOMALY_CHANNEL_CODE, C.ANOMALY_CHANNEL_DEFAULT).alias("channel_encoded"),
        lookup(F.upper(location), C.ANOMALY_LOCATION_CODE, C.ANOMALY_LOCATION_DEFAULT).alias("location_encoded"),
        F.coalesce(velocity.try_cast("int"), F.lit(0)).alias("tx_count_last_hour"),
    ]


def reverse_one_hot(df_columns: list[str]) -> Column:
    """First channel flag equal to 1 (feature order), else UNKNOWN."""
    names = [c for c in df_columns if c.startswith("channel_")]
    return F.coalesce(*[F.when(F.col(f"`{n}`") == 1, F.lit(n[len("channel_"):])) for n in names],
                      F.lit(C.UNKNOWN_CHANNEL))


def pretty_feature(name: Column) -> Column:
    """Presentation rename used in messages and reports."""
    out = name
    for prefix, label in C.FEATURE_RENAMES:
        out = F.replace(out, F.lit(prefix), F.lit(label))
    return out
