"""Population Stability Index and drift verdict.

Both sides stay wide: one aggregate gives every feature's joint minimum and
maximum, a second counts the rows of every combination of bins (partial counts
before the shuffle); only that small result is unfolded to one row per feature.  A value
belongs to the bin of the last edge it reaches (edges: minimum + i * width,
the last bin closed).  NaN counts as missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.core import nan_to_null, rnd


def bin_counts(reference: DataFrame, current: DataFrame, features: list[str] | None = None,
               bins: int = C.PSI_BINS) -> DataFrame:
    """Per feature: joint min / max and per-bin counts for both sides.

    A constant feature puts everything in bin 0.  One row per feature."""
    features = features or [f for f in C.FEATURES if f in reference.columns and f in current.columns]
    side = lambda df, name: df.select(F.lit(name).alias("side"), *[
        nan_to_null(F.col(f"`{f}`").cast("double")).alias(f"x{i}") for i, f in enumerate(features)])
    both = side(reference, "ref").unionByName(side(current, "cur"))
    n = range(len(features))
    # One row with the ends of all features; they enter the second pass as literals.
    ends = both.agg(*[e for i in n for e in (F.min(f"x{i}").alias(f"lo{i}"), F.max(f"x{i}").alias(f"hi{i}"))]).first()
    at = []
    for i in n:
        x, lo, hi = F.col(f"x{i}"), ends[f"lo{i}"], ends[f"hi{i}"]
        edges = [lo + float(j) * ((hi - lo) / bins) for j in range(1, bins)] if lo is not None and hi > lo else []
        place = sum(((x >= F.lit(e)).cast("int") for e in edges), F.lit(0))
        at.append(F.when(x.isNotNull(), place).alias(f"b{i}"))
    b = both
    # Rows with the same bins everywhere are counted together before anything is unfolded.
    g = b.select("side", *at).groupBy("side", *[f"b{i}" for i in n]).agg(F.count(F.lit(1)).alias("n"))
    long = g.select("side", "n", F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.lit(i).alias("fidx"), F.col(f"b{i}").alias("bin"))
        for i, f in enumerate(features)])))
    ref, cur, some = F.col("side") == "ref", F.col("side") == "cur", F.col("bin").isNotNull()
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    aggs = [total(ref & some).alias("n_ref"), total(cur & some).alias("n_cur")]
    for j in range(bins):
        aggs += [total(ref & (F.col("bin") == j)).alias(f"r{j}"), total(cur & (F.col("bin") == j)).alias(f"c{j}")]
    low = F.lit(None).cast("double")
    high = low
    for i in n:
        low = F.when(F.col("fidx") == i, F.lit(ends[f"lo{i}"]).cast("double")).otherwise(low)
        high = F.when(F.col("fidx") == i, F.lit(ends[f"hi{i}"]).cast("double")).otherwise(high)
    return long.groupBy("feature", "fidx").agg(*aggs).withColumns({"lo": low, "hi": high})


def psi(reference: DataFrame, current: DataFrame, features: list[str] | None = None,
        bins: int = C.PSI_BINS, eps: float = C.PSI_EPS) -> DataFrame:
    """PSI per feature: eps-smoothed bin shares, 0 when the feature is constant."""
    g = bin_counts(reference, current, features, bins)
    total = None
    for i in range(bins):
        r = (F.col(f"r{i}") + eps) / (F.col("n_ref") + eps * bins)
        c = (F.col(f"c{i}") + eps) / (F.col("n_cur") + eps * bins)
        t = (c - r) * F.ln(c / r)
        total = t if total is None else total + t
    value = F.when(F.col("hi") == F.col("lo"), F.lit(0.0)).otherwise(total)
    return g.select("feature", "fidx", rnd(value, 6).alias("psi"),
                    (value > C.PSI_THRESHOLD).alias("drifted"))


def chi2(reference: DataFrame, current: DataFrame, features: list[str] | None = None,
         bins: int = C.PSI_BINS) -> DataFrame:
    """Pearson chi-square statistic of side x bin per feature, with its degrees
    of freedom (empty bins skipped): the dataset-level drift test (A16)."""
    g = bin_counts(reference, current, features, bins)
    n = F.col("n_ref") + F.col("n_cur")
    stat, dof = None, None
    for i in range(bins):
        col_tot = F.col(f"r{i}") + F.col(f"c{i}")
        er = F.col("n_ref") * col_tot / n
        ec = F.col("n_cur") * col_tot / n
        term = F.when(col_tot > 0, (F.col(f"r{i}") - er) * (F.col(f"r{i}") - er) / er
                      + (F.col(f"c{i}") - ec) * (F.col(f"c{i}") - ec) / ec).otherwise(F.lit(0.0))
        used = F.when(col_tot > 0, 1).otherwise(0)
        stat = term if stat is None else stat + term
        dof = used if dof is None else dof + used
    return g.select("feature", "fidx", rnd(stat, 6).alias("chi2"),
                    F.greatest(dof - 1, F.lit(0)).alias("dof"))


def missing_summary(reference: DataFrame, current: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Missing values (NULL or NaN) per feature on both sides, one aggregate each."""
    features = features or [f for f in C.FEATURES if f in reference.columns and f in current.columns]

    def side(df, name):
        aggs = [F.count_if(nan_to_null(F.col(f"`{f}`").cast("double")).isNull()).alias(f"m{i}") for i, f in enumerate(features)]
        one = df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
        return one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col("rows").alias(f"{name}_rows"),
                                                      F.col(f"m{i}").alias(f"{name}_missing"))
                                             for i, f in enumerate(features)])))
    return side(reference, "reference").join(side(current, "current"), "feature")


def chi2_test(stats: DataFrame, alpha: float = 0.05) -> DataFrame:
    """p-value and verdict of ``chi2`` rows (A16), by the Wilson-Hilferty normal approximation.

    The survival function of the normal is evaluated with a rational
    approximation (absolute error below 1e-7).
    """
    k = F.greatest(F.col("dof"), F.lit(1)).cast("double")
    z = (F.pow(F.col("chi2") / k, F.lit(1.0 / 3)) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k))
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) / 2.5066282746310002 * poly
    p = F.when(F.col("dof") <= 0, F.lit(1.0)).when(z >= 0, upper).otherwise(1 - upper)
    return stats.withColumn("p_value", rnd(p, 6)).withColumn("drifted", p < alpha)


def drift_verdict(psi_df: DataFrame, n_features: int = len(C.FEATURES)) -> DataFrame:
    """Share of drifted features over all listed features; drift when >= 0.30."""
    drifted = F.filter(F.array_sort(F.collect_list(F.struct("fidx", "feature", "drifted"))),
                       lambda s: s["drifted"])
    g = psi_df.agg(F.count_if("drifted").alias("n_drifted"),
                   F.transform(drifted, lambda s: s["feature"]).alias("drifted_features"))
    share = rnd(F.col("n_drifted") / float(max(n_features, 1)), 6)
    return g.select("n_drifted", share.alias("drift_share"),
                    (share >= C.DRIFT_SHARE_THRESHOLD).alias("drift_detected"), "drifted_features")


def retrain_decision(metrics: DataFrame, verdict: DataFrame, force: bool = False) -> DataFrame:
    """Retrain when F1 < 0.85, when drift is detected, or when forced."""
    f1_reason = F.when(F.col("f1_score") < C.F1_THRESHOLD, F.format_string(
        C.F1_REASON_FORMAT, F.col("f1_score"), F.lit(str(C.F1_THRESHOLD))))
    names = F.concat(F.lit("["), F.array_join(
        F.transform("drifted_features", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    drift_reason = F.when(F.col("drift_detected"), F.concat(
        F.lit(C.DRIFT_REASON_PREFIX), F.format_string("%.1f%%", rnd(F.col("drift_share") * 100, 1)),
        F.lit(C.DRIFT_REASON_MIDDLE.format(threshold=C.DRIFT_SHARE_THRESHOLD)), names))
    forced = F.lit(C.FORCED_REASON) if force else F.lit(None).cast("string")
    # Both inputs are one-row aggregates; the F1 value enters as a scalar subquery.
    f1 = metrics.agg(F.first("f1_score")).scalar()
    row = verdict.select(f1.alias("f1_score"), "drift_share", "drift_detected", "drifted_features")
    reasons = F.array_compact(F.array(f1_reason, drift_reason))
    reasons = F.when(F.size(reasons) == 0, F.array_compact(F.array(forced))).otherwise(reasons)
    return row.select("f1_score", "drift_share", "drift_detected",
                      ((F.size(reasons) > 0) | F.lit(force)).alias("retrain"),
                      F.when(F.size(reasons) > 0, F.array_join(reasons, C.REASON_SEPARATOR))
                       .otherwise(F.lit(C.NO_RETRAIN_REASON))
                       .alias("reason"))
