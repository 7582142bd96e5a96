"""Model-quality and drift queries over additive-scorer outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions.core import rnd
from ..functions import scoring as S
from ..operators import drift as D
from ..operators import drift_tests as DT
from ..operators import metrics as M
from ..operators import reports as R
from ..operators import risk
from ..sources import views as V
from . import sqlfrag as Q
from .q_rules import _FEAT_SQL_COLS, _logodds_sql
from .registry import register

THRESHOLDS = [round(0.05 * i, 2) for i in range(1, 20)]

_SCORED = _logodds_sql(f"SELECT transaction_id, is_fraud, ts, {_FEAT_SQL_COLS} FROM ({Q.TX_BASE}) t")
_PRED = f"SELECT *, CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS prediction FROM ({_SCORED}) s"


def scored(spark, sf):
    tx = V.transactions(spark, sf)
    f = tx.select("transaction_id", "is_fraud", "ts",
                  *S.event_features(F.col("amount"), F.col("channel")))
    return risk.logodds_from_features(f, with_map=False)


_CONF = f"""
SELECT count(*) FILTER (WHERE is_fraud = 1 AND prediction = 1) AS tp,
       count(*) FILTER (WHERE is_fraud = 0 AND prediction = 1) AS fp,
       count(*) FILTER (WHERE is_fraud = 0 AND prediction = 0) AS tn,
       count(*) FILTER (WHERE is_fraud = 1 AND prediction = 0) AS fn
FROM ({_PRED}) p"""


def _ratio(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"


def _prf_sql(tp="tp", fp="fp", tn="tn", fn="fn") -> str:
    return (f"round({_ratio(f'{tp} + {tn}', f'{tp} + {fp} + {tn} + {fn}')}, 6) AS accuracy, "
            f"round({_ratio(tp, f'{tp} + {fp}')}, 6) AS precision, "
            f"round({_ratio(tp, f'{tp} + {fn}')}, 6) AS recall, "
            f"round({_ratio(f'2 * {tp}', f'2 * {tp} + {fp} + {fn}')}, 6) AS f1_score")


@register("confusion", _CONF)
def confusion(spark, sf):
    return M.confusion(scored(spark, sf))


_METRICS = f"""
SELECT {_prf_sql()}, tp + fp + tn + fn AS support_total, tp + fn AS support_fraud
FROM ({_CONF}) c"""


@register("classification_metrics", _METRICS)
def classification_metrics(spark, sf):
    return M.classification_metrics(scored(spark, sf))


@register("class_report", f"""
SELECT 1 AS class, round({_ratio('tp', 'tp + fp')}, 6) AS precision,
       round({_ratio('tp', 'tp + fn')}, 6) AS recall,
       round({_ratio('2 * tp', '2 * tp + fp + fn')}, 6) AS f1_score, tp + fn AS support FROM ({_CONF}) c
UNION ALL
SELECT 0 AS class, round({_ratio('tn', 'tn + fn')}, 6) AS precision,
       round({_ratio('tn', 'tn + fp')}, 6) AS recall,
       round({_ratio('2 * tn', '2 * tn + fn + fp')}, 6) AS f1_score, tn + fp AS support FROM ({_CONF}) c""")
def class_report(spark, sf):
    return M.class_report(scored(spark, sf))


_SCORE_COUNTS = f"""
SELECT score, pos, neg,
       coalesce(sum(pos) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_before,
       coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_before
FROM (SELECT log_odds AS score, count(*) FILTER (WHERE is_fraud = 1) AS pos,
             count(*) FILTER (WHERE is_fraud <> 1) AS neg
      FROM ({_SCORED}) s GROUP BY log_odds) g"""


@register("auc", f"""
SELECT round({_ratio('num', '2 * P * N')}, 6) AS auc_roc, CAST(P AS BIGINT) AS positives,
       CAST(N AS BIGINT) AS negatives
FROM (SELECT sum(pos * (2 * neg_before + neg)) AS num, sum(pos) AS P, sum(neg) AS N
      FROM ({_SCORE_COUNTS}) sc) t""")
def auc(spark, sf):
    # Ranked by log-odds: same order as the probability, and computed by
    # additions only, so ties are identical in every engine.
    return M.auc(scored(spark, sf), score="log_odds")


@register("roc_curve", f"""
SELECT round(1.0 / (1.0 + exp(-score)), 6) AS threshold, round(score, 6) AS threshold_log_odds,
       round({_ratio('N - neg_before', 'N')}, 6) AS fpr,
       round({_ratio('P - pos_before', 'P')}, 6) AS tpr
FROM ({_SCORE_COUNTS}) sc, (SELECT sum(pos) AS P, sum(neg) AS N FROM ({_SCORE_COUNTS}) x) tot""")
def roc_curve(spark, sf):
    r = M.roc_curve(scored(spark, sf), score="log_odds")
    return r.select(rnd(1.0 / (1.0 + F.exp(-F.col("threshold"))), 6).alias("threshold"),
                    rnd("threshold", 6).alias("threshold_log_odds"), "fpr", "tpr")


_T_VALUES = "(VALUES " + ", ".join(f"({t})" for t in THRESHOLDS) + ") AS th(t)"


@register("threshold_sweep", f"""
SELECT threshold, tp, fp, tn, fn, {_prf_sql()}
FROM (SELECT CAST(th.t AS DOUBLE) AS threshold,
             count(*) FILTER (WHERE s.is_fraud = 1 AND s.probability >= th.t) AS tp,
             count(*) FILTER (WHERE s.is_fraud <> 1 AND s.probability >= th.t) AS fp,
             count(*) FILTER (WHERE s.is_fraud <> 1 AND s.probability < th.t) AS tn,
             count(*) FILTER (WHERE s.is_fraud = 1 AND s.probability < th.t) AS fn
      FROM ({_SCORED}) s, {_T_VALUES} GROUP BY th.t) g""")
def threshold_sweep(spark, sf):
    return M.threshold_sweep(scored(spark, sf), THRESHOLDS)


def _psi_sql() -> str:
    long = "\nUNION ALL\n".join(
        f"SELECT CASE WHEN ts < TIMESTAMP '{C.DRIFT_SPLIT_DAY}' THEN 'ref' ELSE 'cur' END AS side, "
        f"'{f}' AS feature, {i} AS fidx, CAST(\"{f}\" AS DOUBLE) AS x FROM ({_SCORED}) s"
        for i, f in enumerate(C.FEATURES))
    bins, eps = C.PSI_BINS, C.PSI_EPS
    counts = ", ".join(
        f"count(*) FILTER (WHERE side = 'ref' AND bin = {i}) AS r{i}, "
        f"count(*) FILTER (WHERE side = 'cur' AND bin = {i}) AS c{i}" for i in range(bins))
    terms = []
    for i in range(bins):
        r = f"((r{i} + {eps}) / (n_ref + {eps * bins}))"
        c = f"((c{i} + {eps}) / (n_cur + {eps * bins}))"
        terms.append(f"(({c} - {r}) * ln({c} / {r}))")
    total = terms[0]
    for t in terms[1:]:
        total = f"({total} + {t})"
    return f"""
WITH l AS ({long}),
rng AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM l GROUP BY feature),
b AS (SELECT l.*, rng.lo, rng.hi,
             CASE WHEN rng.hi - rng.lo > 0
                  THEN {' + '.join(f"CAST(x >= rng.lo + {float(j)} * ((rng.hi - rng.lo) / {bins}) AS INTEGER)" for j in range(1, bins))}
                  ELSE 0 END AS bin
      FROM l JOIN rng USING (feature)),
g AS (SELECT feature, fidx, count(*) FILTER (WHERE side = 'ref') AS n_ref,
             count(*) FILTER (WHERE side = 'cur') AS n_cur, min(lo) AS lo, min(hi) AS hi, {counts}
      FROM b GROUP BY feature, fidx),
v AS (SELECT feature, fidx, CASE WHEN hi = lo THEN 0.0 ELSE {total} END AS value FROM g)
SELECT feature, fidx, round(value, 6) AS psi, value > {C.PSI_THRESHOLD} AS drifted FROM v"""


_PSI = _psi_sql()


def psi_frame(spark, sf):
    s = scored(spark, sf)
    split = F.lit(C.DRIFT_SPLIT_DAY).cast("timestamp_ntz")
    return D.psi(s.where(F.col("ts") < split), s.where(F.col("ts") >= split))


@register("psi", _PSI)
def psi(spark, sf):
    return psi_frame(spark, sf)


_VERDICT = f"""
SELECT n_drifted, round(n_drifted / {float(len(C.FEATURES))}, 6) AS drift_share,
       round(n_drifted / {float(len(C.FEATURES))}, 6) >= {C.DRIFT_SHARE_THRESHOLD} AS drift_detected,
       drifted_features
FROM (SELECT count(*) FILTER (WHERE drifted) AS n_drifted,
             coalesce(list(feature ORDER BY fidx) FILTER (WHERE drifted), []::VARCHAR[]) AS drifted_features
      FROM ({_PSI}) p) x"""


@register("drift_verdict", _VERDICT)
def drift_verdict(spark, sf):
    return D.drift_verdict(psi_frame(spark, sf))


@register("retrain_decision", f"""
WITH m AS ({_METRICS}), v AS ({_VERDICT}),
r AS (SELECT m.f1_score, v.drift_share, v.drift_detected,
             list_concat(
               CASE WHEN m.f1_score < {C.F1_THRESHOLD}
                    THEN [printf('F1-score (%.4f) below threshold ({C.F1_THRESHOLD})', m.f1_score)]
                    ELSE []::VARCHAR[] END,
               CASE WHEN v.drift_detected
                    THEN ['Data drift detected: ' || printf('%.1f%%', round(v.drift_share * 100, 1))
                          || ' of features drifted (threshold={C.DRIFT_SHARE_THRESHOLD:.0%}). Drifted: ['
                          || '''' || array_to_string(v.drifted_features, ''', ''') || '''' || ']']
                    ELSE []::VARCHAR[] END) AS reasons
      FROM m, v)
SELECT f1_score, drift_share, drift_detected, len(reasons) > 0 AS retrain,
       CASE WHEN len(reasons) > 0 THEN array_to_string(reasons, ' | ')
            ELSE 'No drift or performance degradation detected' END AS reason
FROM r""")
def retrain_decision(spark, sf):
    return D.retrain_decision(classification_metrics(spark, sf), drift_verdict(spark, sf))


def _chi2_sql() -> str:
    bins = C.PSI_BINS
    base = _PSI.split("v AS (")[0].rstrip().rstrip(",")
    stat, dof = [], []
    for i in range(bins):
        tot = f"(r{i} + c{i})"
        er = f"(n_ref * {tot} / (n_ref + n_cur))"
        ec = f"(n_cur * {tot} / (n_ref + n_cur))"
        stat.append(f"(CASE WHEN {tot} > 0 THEN (r{i} - {er}) * (r{i} - {er}) / {er} "
                    f"+ (c{i} - {ec}) * (c{i} - {ec}) / {ec} ELSE 0.0 END)")
        dof.append(f"(CASE WHEN {tot} > 0 THEN 1 ELSE 0 END)")
    s_expr = stat[0]
    for t in stat[1:]:
        s_expr = f"({s_expr} + {t})"
    d_expr = " + ".join(dof)
    return (base + f"\nSELECT feature, fidx, round(CAST({s_expr} AS DOUBLE), 6) AS chi2, "
            f"CAST(greatest({d_expr} - 1, 0) AS INTEGER) AS dof FROM g")


@register("drift_chi2", _chi2_sql())
def drift_chi2(spark, sf):
    s = scored(spark, sf)
    split = F.lit(C.DRIFT_SPLIT_DAY).cast("timestamp_ntz")
    return D.chi2(s.where(F.col("ts") < split), s.where(F.col("ts") >= split))


# --- tests and distances by column type (A16) and mergeable latency (A26, G7) ---

_DRIFT_COLUMNS = [("amount", "number"), ("scoring_latency_ms", "number"), ("device_is_new", "flag"), ("is_fraud", "flag"),
                  ("channel", "category"), ("location", "category")]


def _drift_parts(distance: bool) -> str:
    """One SELECT per column over its counts per value; windows give the empirical distributions."""
    tail = ("exp(-z * z / 2) / 2.5066282746310002 * (t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 "
            "+ t * (-1.821255978 + t * 1.330274429)))))")
    out = []
    for c, kind in _DRIFT_COLUMNS:
        x = f'CAST("{c}" AS {"VARCHAR" if kind == "category" else "DOUBLE"})'
        v = f"""WITH k AS (SELECT {x} AS x, CAST(count(*) FILTER (WHERE ts < TIMESTAMP '{C.DRIFT_SPLIT_DAY}') AS DOUBLE) AS r,
  CAST(count(*) FILTER (WHERE ts >= TIMESTAMP '{C.DRIFT_SPLIT_DAY}') AS DOUBLE) AS c
  FROM tx WHERE "{c}" IS NOT NULL GROUP BY 1),
k2 AS (SELECT *, sum(r) OVER () AS n, sum(c) OVER () AS m FROM k),
w AS (SELECT *, sum(r) OVER (ORDER BY x) AS rt, sum(c) OVER (ORDER BY x) AS ct, lag(x) OVER (ORDER BY x) AS px FROM k2)"""
        if distance and kind == "number":
            s = f"""{v} SELECT '{c}' AS feature, 'number' AS kind, 'wasserstein_std' AS measure, d FROM (
SELECT sum(abs((rt - r) / n - (ct - c) / m) * (x - px)) / greatest(sqrt(greatest(sum(r * x * x) / sum(r)
  - (sum(r * x) / sum(r)) * (sum(r * x) / sum(r)), 0)), 0.001) AS d FROM w) y"""
        elif distance:
            s = f"""{v} SELECT '{c}' AS feature, '{kind}' AS kind, 'jensen_shannon' AS measure, sqrt(greatest(sum(
  CASE WHEN r > 0 THEN r / n * log2(r / n / ((r / n + c / m) / 2)) ELSE 0 END
  + CASE WHEN c > 0 THEN c / m * log2(c / m / ((r / n + c / m) / 2)) ELSE 0 END) / 2, 0)) AS d FROM k2"""
        elif kind == "number":
            s = f"""{v} SELECT '{c}' AS feature, 'number' AS kind, 'kolmogorov_smirnov' AS test, s,
  CASE WHEN l < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, list_sum(list_transform(range(1, 101),
    lambda i: CASE WHEN i % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END * exp(-2.0 * i * i * l * l))))) END AS p
  FROM (SELECT s, sqrt(n * m / (n + m)) * s AS l FROM (SELECT max(abs(rt / n - ct / m)) AS s, max(n) AS n, max(m) AS m FROM w))"""
        elif kind == "flag":
            s = f"""{v} SELECT '{c}' AS feature, 'flag' AS kind, 'proportions_z' AS test, s, 2 * {tail} AS p
  FROM (SELECT s, abs(s) AS z, 1 / (1 + 0.2316419 * abs(s)) AS t FROM (
    SELECT (b / m - a / n) / sqrt((a + b) / (n + m) * (1 - (a + b) / (n + m)) * (1 / n + 1 / m)) AS s FROM (
      SELECT sum(r) AS n, sum(c) AS m, sum(CASE WHEN x = 1 THEN r ELSE 0 END) AS a, sum(CASE WHEN x = 1 THEN c ELSE 0 END) AS b FROM k)))"""
        else:
            s = f"""{v} SELECT '{c}' AS feature, 'category' AS kind, 'chi_square' AS test, s,
  round(CASE WHEN dof <= 0 THEN 1.0 WHEN z0 >= 0 THEN {tail} ELSE 1 - {tail} END, 6) AS p
  FROM (SELECT s, dof, z0, abs(z0) AS z, 1 / (1 + 0.2316419 * abs(z0)) AS t FROM (
    SELECT s, dof, (power(s / g, 1.0::DOUBLE / 3) - (1 - 2 / (9 * g))) / sqrt(2 / (9 * g)) AS z0 FROM (
      SELECT s, dof, CAST(greatest(dof, 1) AS DOUBLE) AS g FROM (SELECT count(*) - 1 AS dof, sum(
        (r - n * (r + c) / (n + m)) * (r - n * (r + c) / (n + m)) / (n * (r + c) / (n + m))
        + (c - m * (r + c) / (n + m)) * (c - m * (r + c) / (n + m)) / (m * (r + c) / (n + m))) AS s FROM k2))))"""
        out.append(f"SELECT * FROM ({s}) u{len(out)}")
    return f"WITH tx AS ({Q.TX_BASE}) " + "\nUNION ALL ".join(out)


def _two_windows(spark, sf):
    tx = V.transactions(spark, sf)
    split = F.lit(C.DRIFT_SPLIT_DAY).cast("timestamp_ntz")
    return tx.where(F.col("ts") < split), tx.where(F.col("ts") >= split), [c for c, _ in _DRIFT_COLUMNS]


@register("drift_tests", f"""SELECT feature, kind, test, round(s, 6) AS statistic, round(p, 6) AS p_value, p < 0.05 AS drifted
FROM ({_drift_parts(False)}) d""")
def drift_tests(spark, sf):
    return DT.tests(*_two_windows(spark, sf))


@register("drift_distances", f"""SELECT feature, kind, measure, round(d, 6) AS distance, d >= 0.1 AS drifted
FROM ({_drift_parts(True)}) d""")
def drift_distances(spark, sf):
    return DT.distances(*_two_windows(spark, sf))


@register("latency_sketch_ranks", f"""SELECT channel, count(*) AS n, max(scoring_latency_ms) AS max_ms, TRUE AS within_error
FROM ({Q.TX_BASE}) t WHERE scoring_latency_ms IS NOT NULL GROUP BY channel""")
def latency_sketch_ranks(spark, sf):
    """Per channel: daily KLL sketches merged over all days, and whether the p95 from them has a true rank within 0.02."""
    tx = V.transactions(spark, sf).where(F.col("scoring_latency_ms").isNotNull())
    daily = R.latency_sketches(tx.withColumn("slot", F.concat_ws(" ", F.to_date("ts"), "channel")), "slot")
    merged = R.merged_latency(daily.withColumn("channel", F.expr("substr(slot, 12)")), "channel")
    near = tx.join(F.broadcast(merged.select("channel", "p95_ms")), "channel")          # one row a channel
    g = near.groupBy("channel").agg(F.count_if(F.col("scoring_latency_ms") < F.col("p95_ms")).alias("under"),
                                    F.count_if(F.col("scoring_latency_ms") <= F.col("p95_ms")).alias("upto"))
    n = F.col("n")
    ok = (F.col("under") / n <= 0.97) & (F.col("upto") / n >= 0.93)
    return merged.join(g, "channel").select("channel", "n", "max_ms", ok.alias("within_error"))
