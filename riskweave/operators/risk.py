"""DataFrame-level rule and score operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import rules as R
from ..functions import scoring as S


def apply_rules(df: DataFrame, velocity_threshold: int = C.MAX_TX_PER_HOUR,
                keep_flags: bool = False) -> DataFrame:
    """Add ``triggered_rules``, ``rule_risk_score`` and ``rule_decision``.

    One projection, no shuffle; the same expressions run on a stream.
    Missing input columns behave like missing fields (defaults apply).
    """
    cols = set(df.columns)

    def c(name, typ):
        return F.col(name) if name in cols else F.lit(None).cast(typ)

    flags = R.rule_flags(c("amount", "double"), c("channel", "string"), c("ts", "timestamp_ntz"),
                         c("location", "string"), c("historical_locations", "array<string>"),
                         c("device_is_new", "boolean"), c("tx_count_last_hour", "int"),
                         c("bvn_matched", "boolean"), velocity_threshold)
    extra = [f.alias(f"flag_{n.lower()}") for n, f in flags] if keep_flags else []
    score = R.rule_score(flags)
    return df.select("*", *extra,
                     R.triggered_rules(flags).alias("triggered_rules"),
                     score.alias("rule_risk_score"),
                     R.decision(score).alias("rule_decision"))


def logodds_from_features(df: DataFrame, cutoff: float = C.DEFAULT_CUTOFF,
                          with_map: bool = True) -> DataFrame:
    """Additive log-odds scorer over a 13-feature table (missing features = 0)."""
    feat = {n: F.col(f"`{n}`") for n in C.FEATURES if n in df.columns}
    contribs = S.logodds_contributions(feat)
    lo, prob, pred = S.logodds_score(contribs, cutoff)
    out = [lo.alias("log_odds"), prob.alias("probability"), pred.alias("prediction")]
    if with_map:
        out.append(S.contributions_map(contribs).alias("contributions"))
    return df.select("*", *out)


def zscore_anomaly(df: DataFrame, train: DataFrame, amount: str = "amount") -> DataFrame:
    """Z-score anomaly score against mean / population std of ``train``.

    The statistics are one global aggregate (partial per partition, merged
    once) planned as a scalar subquery, so scoring stays a narrow map.
    """
    st = train.agg(F.struct(F.avg(amount).alias("m"),
                            F.stddev_pop(amount).alias("s")).alias("st")).scalar()
    # Bind the subquery once; later expressions reference the columns.
    out = df.select("*", st.alias("__st")).select(
        *[F.col(f"`{c}`") for c in df.columns], F.col("__st.m").alias("train_mean"),
        F.col("__st.s").alias("__s"))
    std = F.when(F.coalesce(F.col("__s"), F.lit(0.0)) > 0, F.col("__s")).otherwise(F.lit(1.0))
    out = out.withColumn("train_std", std).drop("__s")
    return out.withColumn("anomaly_score",
                          S.zscore_score(F.col(amount), F.col("train_mean"), F.col("train_std")))
