"""Split, folds, SMOTE and model queries over the feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions.core import rnd
from ..operators import balance as B
from ..operators import quality as QL
from ..session import written
from ..sources import views as V
from . import sqlfrag as Q
from .q_quality import _MIN_MAX
from .registry import register

FEATURES_SQL = f"SELECT * EXCLUDE (lo, hi) FROM ({_MIN_MAX}) x"
_U_SPLIT = Q.key_uniform_sql("transaction_id", "'split'")
_SPLIT_SQL = f"SELECT *, {_U_SPLIT} < 0.8 AS is_train FROM ({FEATURES_SQL}) f"
_TRAIN_SQL = f"SELECT * FROM ({_SPLIT_SQL}) s WHERE is_train"
K = 2


def feature_table(spark, sf):
    return QL.feature_table(V.raw_money(spark, sf), V.raw_card(spark, sf))


def split_table(spark, sf):
    return B.split(feature_table(spark, sf))


def train_table(spark, sf):
    """Training rows, written once: ranks, class counts and minority rows each read them again."""
    return written(split_table(spark, sf).where(F.col("is_train")), "train")


@register("split_counts", f"""
SELECT CASE WHEN is_train THEN 'train' ELSE 'test' END AS split, is_fraud, count(*) AS n
FROM ({_SPLIT_SQL}) s GROUP BY ALL""")
def split_counts(spark, sf):
    s = split_table(spark, sf)
    return s.groupBy(F.when(F.col("is_train"), "train").otherwise("test").alias("split"),
                     "is_fraud").agg(F.count(F.lit(1)).alias("n"))


@register("folds", f"""
SELECT transaction_id, is_fraud,
       CAST((row_number() OVER (PARTITION BY is_fraud
             ORDER BY {Q.key_uniform_sql('transaction_id', "'fold'")}, transaction_id) - 1) % 5 AS INTEGER) AS fold
FROM ({_TRAIN_SQL}) t""")
def folds(spark, sf):
    t = written(split_table(spark, sf).where(F.col("is_train")).select("transaction_id", "is_fraud"), "train")
    return B.stratified_folds(t).select("transaction_id", "is_fraud", "fold")


def _cell_sql() -> str:
    return "concat_ws('', " + ", ".join(
        f'CAST(CAST("{f}" AS INTEGER) AS VARCHAR)' for f in C.FEATURES if f != "amount") + ")"


def _dist_sql(a: str, b: str) -> str:
    terms = [f'((CAST({a}."{f}" AS DOUBLE) - CAST({b}."{f}" AS DOUBLE)) * '
             f'(CAST({a}."{f}" AS DOUBLE) - CAST({b}."{f}" AS DOUBLE)))' for f in C.FEATURES]
    total = terms[0]
    for t in terms[1:]:
        total = f"({total} + {t})"
    return f"sqrt({total})"


_MINORITY = f"SELECT * FROM ({_TRAIN_SQL}) t WHERE is_fraud = 1"
_NEIGHBOURS = f"""
SELECT transaction_id, CAST(nbr_rank AS INTEGER) AS nbr_rank, nbr_key, distance
FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY distance, nbr_key) AS nbr_rank
      FROM (SELECT a.transaction_id, b.transaction_id AS nbr_key, {_dist_sql('a', 'b')} AS distance
            FROM ({_MINORITY}) a JOIN ({_MINORITY}) b ON a.transaction_id <> b.transaction_id) p
      WHERE distance > 0) r
WHERE nbr_rank <= {K}"""


@register("smote_neighbours", _NEIGHBOURS)
def smote_neighbours(spark, sf):
    minority = train_table(spark, sf).where(F.col("is_fraud") == 1)
    return B.smote_neighbours(minority, K)


def _smote_rows_sql() -> str:
    fields = ", ".join(f'"{f}" := CAST(n."{f}" AS DOUBLE)' for f in C.FEATURES)
    ratio = Q.key_uniform_sql("g.transaction_id", "j", "'ratio'")
    upick = Q.key_uniform_sql("g.transaction_id", "j", "'nbr'")
    cols = ", ".join(
        f'CAST(g."{f}" AS DOUBLE) + {ratio} * (p."{f}" - CAST(g."{f}" AS DOUBLE)) AS "{f}"'
        for f in C.FEATURES)
    return f"""
WITH tr AS ({_TRAIN_SQL}),
cnt AS (SELECT count(*) FILTER (WHERE is_fraud = 1) AS m, count(*) FILTER (WHERE is_fraud = 0) AS m0 FROM tr),
mi AS (SELECT *, {_cell_sql()} AS cell FROM tr WHERE is_fraud = 1),
gi AS (SELECT mi.*, row_number() OVER (ORDER BY cell, amount, transaction_id) - 1 AS gi FROM mi),
nb AS ({_NEIGHBOURS}),
lists AS (SELECT nb.transaction_id, list(struct_pack({fields}) ORDER BY nb.nbr_rank) AS nbrs
          FROM nb JOIN mi n ON nb.nbr_key = n.transaction_id GROUP BY nb.transaction_id),
alloc AS (SELECT gi.*, (cnt.m0 - cnt.m) // cnt.m
                       + CASE WHEN gi.gi < (cnt.m0 - cnt.m) % cnt.m THEN 1 ELSE 0 END AS n_syn,
                 lists.nbrs
          FROM gi CROSS JOIN cnt LEFT JOIN lists ON gi.transaction_id = lists.transaction_id),
syn AS (SELECT *, unnest(range(n_syn)) AS j FROM alloc WHERE n_syn > 0),
g AS (SELECT syn.*, nbrs[CAST(floor({upick.replace('g.transaction_id', 'syn.transaction_id')} * len(nbrs)) AS BIGINT) + 1] AS p
      FROM syn)
SELECT 'SYN_' || g.transaction_id || '_' || CAST(j AS VARCHAR) AS transaction_id, {cols}, 1 AS is_fraud
FROM g"""


@register("smote_rows", _smote_rows_sql())
def smote_rows(spark, sf):
    return B.smote_rows(train_table(spark, sf), k_max=K)


@register("resampled_counts", f"""
SELECT is_fraud, count(*) AS n FROM (
  SELECT is_fraud FROM ({_TRAIN_SQL}) t
  UNION ALL
  SELECT is_fraud FROM ({_smote_rows_sql()}) s) u GROUP BY is_fraud""")
def resampled_counts(spark, sf):
    r = B.resample(train_table(spark, sf))
    return r.groupBy("is_fraud").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------
# Models (rows-only checks: a learner's output has no SQL equivalent)
# --------------------------------------------------------------------------

def _cut_split(spark, sf):
    """Split feature table written to the shared checkpoint folder: every
    learner re-reads it many times, so its lineage is cut once."""
    return written(split_table(spark, sf), "split")


def _stored_resample(train):
    """Resampled features and label, written once (no ids: the learners need none)."""
    return written(B.resample(train).drop("transaction_id"), "resampled")


def _scores(spark, sf, kind: str, params: dict | None = None):
    from ..operators import models as MD
    s = _cut_split(spark, sf)
    model = MD.fit(B.resample(s.where(F.col("is_train"))), kind, params=params)
    test = s.where(~F.col("is_train"))
    return MD.score(model, test)


def _rounded(df):
    return df.select("transaction_id", "is_fraud", rnd("probability", 6).alias("probability"),
                     "prediction")


@register("lr_scores")
def lr_scores(spark, sf):
    return _rounded(_scores(spark, sf, "lr"))


@register("rf_scores")
def rf_scores(spark, sf):
    return _rounded(_scores(spark, sf, "rf"))


@register("gbt_scores")
def gbt_scores(spark, sf):
    return _rounded(_scores(spark, sf, "gbt"))


def _hist_boost(spark, sf, params):
    from ..operators import boosting as HB
    s = _cut_split(spark, sf)
    train = _stored_resample(s.where(F.col("is_train")))
    model = HB.fit(train, params=params)
    return _rounded(HB.score(model, s.where(~F.col("is_train"))))


@register("hist_boost_scores")
def hist_boost_scores(spark, sf):
    """Histogram boosting, best-first trees, default growth (M7)."""
    from ..operators import boosting as HB
    return _hist_boost(spark, sf, HB.BY_LEAF)


@register("hist_boost_tuned_scores")
def hist_boost_tuned_scores(spark, sf):
    """Histogram boosting with the saved parameters of the best-first library (M7)."""
    from ..operators import boosting as HB
    return _hist_boost(spark, sf, HB.tuned("second"))


@register("gbt_tuned_scores")
def gbt_tuned_scores(spark, sf):
    """Histogram boosting by depth with the saved parameters of the first library (M6)."""
    from ..operators import boosting as HB
    return _hist_boost(spark, sf, HB.tuned("first"))


@register("model_comparison")
def model_comparison(spark, sf):
    from ..operators import models as MD
    s = _cut_split(spark, sf)
    train = _stored_resample(s.where(F.col("is_train")))
    test = s.where(~F.col("is_train"))
    out = None
    for name, kind in (("logistic_regression", "lr"), ("random_forest", "rf"),
                       ("boosted_trees", "gbt")):
        row = MD.evaluate(MD.score(MD.fit(train, kind, stored=True), test), name)
        out = row if out is None else out.unionByName(row)
    return out


@register("cv_f1")
def cv_f1(spark, sf, k: int = 5):
    """Mean F1 over stratified folds, SMOTE applied inside each training fold."""
    from ..operators import metrics as MT
    from ..operators import models as MD
    f = written(B.stratified_folds(_cut_split(spark, sf).where(F.col("is_train")), k=k), "folds")
    rows = None
    for i in range(k):
        tr = B.resample(f.where(F.col("fold") != i).drop("fold", "is_train"))
        model = MD.fit(tr, "lr", params={"maxIter": 100})
        m = MT.classification_metrics(MD.score(model, f.where(F.col("fold") == i)))
        r = m.select(F.lit(i).alias("fold"), "f1_score")
        rows = r if rows is None else rows.unionByName(r)
    return rows.agg(rnd(F.avg("f1_score"), 6).alias("mean_f1"), F.count(F.lit(1)).alias("folds"))


@register("isolation_scores")
def isolation_scores(spark, sf):
    from ..functions import scoring as S
    from ..operators.anomaly import isolation_scores as iso
    tx = V.transactions(spark, sf, with_velocity=True)
    feats = tx.select("transaction_id", *S.anomaly_features(
        F.col("amount"), F.col("ts"), F.col("channel"), F.col("location"), F.col("tx_count_last_hour")))
    out = iso(feats, feats, "transaction_id")
    return out.select("transaction_id", rnd("iso_score", 6).alias("iso_score"),
                      rnd("anomaly_risk", 6).alias("anomaly_risk"))


SEARCH_SPACE = {
    "maxIter": ("int", 10, 40),
    "maxDepth": ("int", 2, 6),
    "stepSize": ("log", 0.01, 0.3),
    "subsamplingRate": ("float", 0.6, 1.0),
}


@register("param_search")
def param_search(spark, sf, trials: int = 3, k: int = 3):
    """Random search over boosted-tree parameters, mean F1 over stratified
    folds with SMOTE inside each training fold (M8); the best trial first."""
    from ..operators import models as MD
    f = written(B.stratified_folds(_cut_split(spark, sf).where(F.col("is_train")), k=k).drop("is_train"), "folds")
    res = MD.random_search(f, "gbt", SEARCH_SPACE, trials, k, resample_fn=B.resample)
    return res.orderBy(F.desc("mean_f1"), "trial")


@register("gbt_contributions")
def gbt_contributions(spark, sf):
    """Exact per-row TreeSHAP contributions of the boosted-tree model on the test
    split, in log-odds units; base + contributions = the model's log-odds (M14)."""
    from ..operators import explain as X
    from ..operators import models as MD
    s = _cut_split(spark, sf)
    train = _stored_resample(s.where(F.col("is_train")))
    model = MD.fit(train, "gbt", stored=True)
    test, cols = MD.tree_inputs(model, s.where(~F.col("is_train")))
    ex = X.explain(test, model.stages[-1], cols, C.FEATURES, "transaction_id")
    return ex.select("transaction_id", rnd("base_value", 6).alias("base_value"),
                     "contributions", rnd("raw_log_odds", 6).alias("raw_log_odds"))
