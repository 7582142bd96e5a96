"""Classification metrics over a scored table.

Everything is a combinable aggregate.  Rank-based metrics (AUC, ROC) first
collapse rows to one row per distinct score, then take prefix sums with a
two-level scheme (equal-depth score buckets, per-bucket windows in parallel,
bucket offsets from a bounded table), so no step orders the whole table in
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import rnd, safe_ratio
from .balance import bucket_count


def confusion(df: DataFrame, label: str = "is_fraud", pred: str = "prediction") -> DataFrame:
    """tp / fp / tn / fn counts."""
    y, p = F.col(label), F.col(pred)
    return df.agg(F.count_if((y == 1) & (p == 1)).alias("tp"),
                  F.count_if((y == 0) & (p == 1)).alias("fp"),
                  F.count_if((y == 0) & (p == 0)).alias("tn"),
                  F.count_if((y == 1) & (p == 0)).alias("fn"))


def prf(tp: Column, fp: Column, tn: Column, fn: Column, digits: int = 6) -> list[Column]:
    """accuracy, precision, recall, F1 with 0 for undefined ratios."""
    precision = safe_ratio(tp, tp + fp)
    recall = safe_ratio(tp, tp + fn)
    f1 = safe_ratio(2 * tp, 2 * tp + fp + fn)
    acc = safe_ratio(tp + tn, tp + fp + tn + fn)
    return [rnd(acc, digits).alias("accuracy"), rnd(precision, digits).alias("precision"),
            rnd(recall, digits).alias("recall"), rnd(f1, digits).alias("f1_score")]


def classification_metrics(df: DataFrame, label: str = "is_fraud",
                           pred: str = "prediction") -> DataFrame:
    c = confusion(df, label, pred)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.select(*prf(tp, fp, tn, fn), (tp + fp + tn + fn).alias("support_total"),
                    (tp + fn).alias("support_fraud"))


def class_report(df: DataFrame, label: str = "is_fraud", pred: str = "prediction") -> DataFrame:
    """Per-class precision, recall, F1, support."""
    c = confusion(df, label, pred)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    rows = []
    for cls, (a, b, d) in ((1, (tp, fp, fn)), (0, (tn, fn, fp))):
        rows.append(F.struct(F.lit(cls).alias("class"),
                             rnd(safe_ratio(a, a + b), 6).alias("precision"),
                             rnd(safe_ratio(a, a + d), 6).alias("recall"),
                             rnd(safe_ratio(2 * a, 2 * a + b + d), 6).alias("f1_score"),
                             (a + d).alias("support")))
    return c.select(F.inline(F.array(*rows)))


def score_counts(df: DataFrame, score: str = "probability", label: str = "is_fraud") -> DataFrame:
    """One row per distinct score with positive and negative counts."""
    return df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def prefix_sums(df: DataFrame, order: str, cols: list[str], buckets: int | None = None) -> DataFrame:
    """Add ``<c>_before``: sum of ``c`` over rows with a strictly smaller ``order``.

    ``order`` must be unique per row (e.g. a distinct-score table).  Rows are
    split into equal-depth buckets by approximate quantiles (a bounded array
    from one aggregate, fetched once); each bucket runs its own window, and each bucket's
    offset comes from a table of at most ``buckets + 1`` rows.
    """
    buckets = buckets or bucket_count(df)
    probs = [i / buckets for i in range(1, buckets)]
    # Bucket edges: one aggregate whose result is a bounded array (buckets - 1 values).
    edges = df.agg(F.percentile_approx(order, probs, 10000)).first()[0] or []
    edges = sorted(set(edges))
    bounds = F.array(*[F.lit(e) for e in edges]) if edges else F.array().cast("array<double>")
    b = df.withColumn("__b", F.size(F.filter(bounds, lambda x: x < F.col(order))))
    totals = b.groupBy("__b").agg(*[F.sum(c).alias(f"__t_{c}") for c in cols])
    w_all = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__b", *[F.coalesce(F.sum(f"__t_{c}").over(w_all), F.lit(0))
                                     .alias(f"__o_{c}") for c in cols])
    w = Window.partitionBy("__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = b.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"__i_{c}") for c in cols])
    j = inner.join(F.broadcast(offsets), "__b")
    return j.select(*df.columns, *[(F.col(f"__o_{c}") + F.col(f"__i_{c}")).cast("long")
                                   .alias(f"{c}_before") for c in cols])


def auc(df: DataFrame, score: str = "probability", label: str = "is_fraud") -> DataFrame:
    """Exact ROC-AUC with tied scores counted half (A10).

    AUC = sum_s pos_s * (2 * neg_below_s + neg_s) / (2 * P * N), an integer
    numerator, so the result does not depend on summation order.
    """
    sc = prefix_sums(score_counts(df, score, label), "score", ["pos", "neg"])
    num = F.sum(F.col("pos") * (2 * F.col("neg_before") + F.col("neg")))
    tot = sc.agg(num.alias("num"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return tot.select(rnd(safe_ratio(F.col("num"), 2 * F.col("P") * F.col("N"), 0.0), 6)
                      .alias("auc_roc"), F.col("P").alias("positives"), F.col("N").alias("negatives"))


def roc_curve(df: DataFrame, score: str = "probability", label: str = "is_fraud") -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, scores >= threshold positive."""
    sc = prefix_sums(score_counts(df, score, label), "score", ["pos", "neg"])
    tot = df.agg(F.struct(F.count_if(F.col(label) == 1).alias("P"),
                          F.count_if(F.col(label) != 1).alias("N"))).scalar()
    sc = sc.select("*", tot.alias("__tot"))
    P, N = F.col("__tot.P"), F.col("__tot.N")
    return sc.select(F.col("score").alias("threshold"),
                     rnd(safe_ratio(N - F.col("neg_before"), N), 6).alias("fpr"),
                     rnd(safe_ratio(P - F.col("pos_before"), P), 6).alias("tpr"))


def threshold_sweep(df: DataFrame, thresholds: list[float], score: str = "probability",
                    label: str = "is_fraud") -> DataFrame:
    """Confusion and F1 at each cut-off in one conditional aggregate."""
    y, s = F.col(label), F.col(score)
    aggs = []
    for i, t in enumerate(thresholds):
        aggs += [F.count_if((y == 1) & (s >= t)).alias(f"tp{i}"),
                 F.count_if((y != 1) & (s >= t)).alias(f"fp{i}"),
                 F.count_if((y != 1) & (s < t)).alias(f"tn{i}"),
                 F.count_if((y == 1) & (s < t)).alias(f"fn{i}")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(t).alias("threshold"), *[F.col(f"{k}{i}").alias(k) for k in ("tp", "fp", "tn", "fn")])
            for i, t in enumerate(thresholds)]
    long = one.select(F.inline(F.array(*rows)))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return long.select("threshold", "tp", "fp", "tn", "fn", *prf(tp, fp, tn, fn))
