"""Model training, scoring, comparison and tuning with ``pyspark.ml``.

Training inputs are written to the shared folder before fitting: iterative
learners re-scan their input many times, and a long resampling lineage would
otherwise be recomputed on every pass.

Tree learners see a feature only through its bins (32 by default), so ``fit``
cuts the features at quantiles of all rows, counts equal rows of bins and
label, and trains on these with their counts as weights: every row counts,
and the table that is scanned once per tree level holds at most the bin
patterns that occur.  Where a learner draws rows (bootstrap, subsampling), a
pattern is spread over blocks of equal rows that are drawn one by one.
"""

from __future__ import annotations

import math
import os
import time
import uuid
from concurrent.futures import ThreadPoolExecutor, as_completed

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..session import cut_lineage, path_exists, written
from . import metrics as M


def _safe_cols(features):
    return [f.replace("-", "_") for f in features]


def prepare(df: DataFrame, features=C.FEATURES) -> DataFrame:
    """Rename features to ML-safe names (the assembler rejects '-')."""
    return df.select("*", *[F.col(f"`{f}`").cast("double").alias(s)
                            for f, s in zip(features, _safe_cols(features)) if f != s])


def estimator(kind: str, label: str = "is_fraud", params: dict | None = None, seed: int = 42):
    p = dict(params or {})
    common = dict(featuresCol="features", labelCol=label)
    if kind == "lr":
        return LogisticRegression(maxIter=p.pop("maxIter", 1000), **common, **p)
    if kind == "rf":
        return RandomForestClassifier(numTrees=p.pop("numTrees", 100), seed=seed, **common, **p)
    if kind == "gbt":
        return GBTClassifier(seed=seed, **common, **p)
    raise ValueError(kind)


def tuned_gbt_params(which: str = "first") -> dict:
    """Map a saved boosted-tree parameter set onto ``GBTClassifier`` params.

    Column sampling becomes ``featureSubsetStrategy``; the positive-class
    weight is applied through ``weightCol`` by ``fit`` (only without SMOTE).
    """
    t = C.TUNED_PARAMS[which]
    return {
        "maxIter": int(t["n_estimators"]),
        "maxDepth": int(t["max_depth"]),
        "stepSize": float(t["learning_rate"]),
        "subsamplingRate": float(t["subsample"]),
        "featureSubsetStrategy": f"{float(t['colsample_bytree']):.4f}",
        "minInstancesPerNode": int(t.get("min_child_samples", t.get("min_child_weight", 1))),
    }


def fit(train: DataFrame, kind: str, label: str = "is_fraud", features=C.FEATURES,
        params: dict | None = None, pos_weight: float | None = None, stored: bool = False) -> PipelineModel:
    """Fitted pipeline (assembler and learner; for trees a bucketizer before them).

    ``stored``: ``train`` is a table read from files, so it is not written again."""
    cols = [F.col(f"`{f}`").cast("double").alias(s) for f, s in zip(features, _safe_cols(features))]
    data = train.select(*cols, F.col(label).cast("double").alias(label))
    if not stored:
        data = written(data, "fit")
    est = estimator(kind, label, params)
    if kind in ("rf", "gbt") and (pos_weight is None or est.getMinInstancesPerNode() == 1):
        return _fit_trees(data, est, label, _safe_cols(features), pos_weight)
    if pos_weight is not None:
        data = data.withColumn("__w", F.when(F.col(label) == 1, F.lit(pos_weight)).otherwise(1.0))
        est.setWeightCol("__w")
    return Pipeline(stages=[_assembler(_safe_cols(features)), est]).fit(data)


def _assembler(cols: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep")


def tree_bins(data: DataFrame, cols: list[str], bins: int) -> Bucketizer:
    """Cuts at the least value and the quantiles of every column, from one aggregate over all rows.

    A row lies left of a cut if its value is not above it; NULL and NaN are the last bin."""
    probs = [i / (bins - 1) for i in range(bins - 1)]
    row = data.agg(*[F.percentile_approx(F.when(~F.isnan(c), F.col(c)), F.lit(probs), F.lit(10_000)).alias(c)
                     for c in cols]).first()
    splits = [[-math.inf, *sorted({math.nextafter(v, math.inf) for v in row[c] or [0.0] if v < math.inf} or {0.0}), math.inf]
              for c in cols]
    return Bucketizer(inputCols=cols, outputCols=[f"{c}__bin" for c in cols], splitsArray=splits, handleInvalid="keep")


def _fit_trees(data: DataFrame, est, label: str, cols: list[str], pos_weight: float | None) -> PipelineModel:
    bucket = tree_bins(data, cols, est.getMaxBins())
    bins = bucket.getOutputCols()
    # Without the bucketizer's column metadata: bins are ordered numbers, not categories.
    plain = bucket.transform(_null_as_nan(data, cols)).select(*[F.col(c).alias(c, metadata={}) for c in bins], label)
    rows = cut_lineage(plain.groupBy(*bins, label).agg(F.count(F.lit(1)).alias("__n")))
    total = rows.agg(F.sum("__n")).first()[0] or 0
    if isinstance(est, RandomForestClassifier) or est.getSubsamplingRate() < 1.0:
        rows = drawn_blocks(rows, total)
    # The learner's least rows per node, in weights: its own count would count patterns.
    least = est.getMinInstancesPerNode()
    if least > 1 and total > 2 * least:
        est.setMinInstancesPerNode(1).setMinWeightFractionPerNode((least - 0.5) / total)
    weight = F.col("__n").cast("double")
    if pos_weight is not None:
        weight = weight * F.when(F.col(label) == 1, F.lit(pos_weight)).otherwise(1.0)
    est.setWeightCol("__w").setMaxBins(est.getMaxBins() + 2)          # the last bin's pattern, and NULL
    model = Pipeline(stages=[_assembler(bins), est]).fit(cut_lineage(rows.withColumn("__w", weight)))
    return PipelineModel([bucket, *model.stages])


def drawn_blocks(rows: DataFrame, total: int) -> DataFrame:
    """Patterns with a count, as blocks of equal rows that can be drawn one by one: ``__n`` rows each.

    A pattern of up to 64 rows gives a block per row; larger ones at least 64
    blocks, and blocks of at most ``total / tree_blocks`` rows."""
    each = max(1, -(-total // C.TUNABLES.tree_blocks))
    n = F.col("__n")
    blocks = F.greatest(F.least(n, F.lit(64)), F.ceil(n / each))
    out = rows.withColumn("__of", blocks).withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__of") - 1)))
    out = out.withColumn("__n", F.floor(n / F.col("__of")) + F.when(F.col("__i") < n % F.col("__of"), 1).otherwise(0))
    keys = [c for c in rows.columns if c != "__n"] + ["__i"]          # a fixed order, so that draws are repeatable
    return out.repartition(rows.sparkSession.sparkContext.defaultParallelism, *keys).sortWithinPartitions(*keys) \
              .select(*rows.columns)


def tree_inputs(model: PipelineModel, df: DataFrame, features=C.FEATURES) -> tuple[DataFrame, list[str]]:
    """``df`` with the columns that the model's trees split on, and their names in feature order."""
    out, cols, bucket = prepare(df, features), _safe_cols(features), model.stages[0]
    if not isinstance(bucket, Bucketizer):
        return out, cols
    return bucket.transform(_null_as_nan(out, cols)), bucket.getOutputCols()


def _null_as_nan(df: DataFrame, cols: list[str]) -> DataFrame:
    """The bucketizer has a bin for NaN and leaves NULL, which the assembler of a scoring pipeline turns into NaN."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(math.nan)) for c in cols})


def score(model: PipelineModel, df: DataFrame, key: str = "transaction_id",
          label: str = "is_fraud", features=C.FEATURES, cutoff: float = C.DEFAULT_CUTOFF) -> DataFrame:
    """Probability of class 1 and the label at ``cutoff`` (M9)."""
    out = model.transform(prepare(df, features))
    p = vector_to_array(F.col("probability"))[1]
    return out.select(key, F.col(label).cast("int").alias(label), p.alias("probability"),
                      F.when(p >= cutoff, 1).otherwise(0).alias("prediction"))


def evaluate(scored: DataFrame, name: str) -> DataFrame:
    """One row of model metrics: accuracy, precision, recall, F1, AUC."""
    m = M.classification_metrics(scored)
    a = M.auc(scored)
    auc_v = a.select("auc_roc").scalar()
    return m.select(F.lit(name).alias("model"), "accuracy", "precision", "recall", "f1_score",
                    auc_v.alias("auc_roc"), "support_total", "support_fraud")


def save(model: PipelineModel, root: str, name: str) -> str:
    """Versioned save: every model goes to a folder of its own, by time and then a random name."""
    path = os.path.join(root, name, f"{time.strftime('%Y%m%dT%H%M%S')}-{uuid.uuid4().hex[:12]}")
    model.write().save(path)
    return path


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def _pointers(root: str) -> str:
    return f"{root.rstrip('/')}/published"


def publish(spark: SparkSession, root: str, path: str) -> str:
    """Make a saved model the one in use (M16): appends a pointer row, the newest of which counts; returns its version."""
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:12]}"
    spark.createDataFrame([(version, path)], "version string, path string").write.mode("append").parquet(_pointers(root))
    return version


class Published:
    """The model in use below ``root``, for scorers that go on while it changes.

    ``current`` reads the newest pointer row and loads a version once; before
    the first ``publish`` it gives (None, None).  A version that cannot be
    loaded (half copied, removed) leaves the one before in use, if there is
    one, and is tried again with the next call.
    """

    def __init__(self, root: str):
        self.root = root
        self.version: str | None = None
        self.model: PipelineModel | None = None
        self.error: str | None = None

    def current(self, spark: SparkSession) -> tuple[str | None, PipelineModel | None]:
        if not path_exists(spark, _pointers(self.root)):
            return self.version, self.model
        newest = (spark.read.schema("version string, path string").parquet(_pointers(self.root))
                  .agg(F.max(F.struct("version", "path")).alias("p")).first()["p"])
        if newest is not None and newest["version"] != self.version:
            try:
                self.version, self.model, self.error = newest["version"], load(newest["path"]), None
            except Exception as e:  # noqa: BLE001 - scoring goes on with the version before
                if self.model is None:
                    raise
                self.error = f"{newest['version']}: {e}"
        return self.version, self.model


def sample_params(space: dict, trials: int, seed: int = 42) -> list[dict]:
    """Random-search parameter maps (M8).  ``space`` maps a parameter to
    ("int", lo, hi), ("float", lo, hi), ("log", lo, hi) or ("choice", [values])."""
    import math
    import random
    rng = random.Random(seed)
    out = []
    for _ in range(trials):
        p = {}
        for name, spec in space.items():
            kind = spec[0]
            if kind == "int":
                p[name] = rng.randint(spec[1], spec[2])
            elif kind == "float":
                p[name] = rng.uniform(spec[1], spec[2])
            elif kind == "log":
                p[name] = math.exp(rng.uniform(math.log(spec[1]), math.log(spec[2])))
            else:
                p[name] = rng.choice(spec[1])
        out.append(p)
    return out


SEARCH_ROW = "trial int, params string, mean_f1 double"


def random_search(folds: DataFrame, kind: str, space: dict, trials: int, k: int,
                  resample_fn=None, label: str = "is_fraud", seed: int = 42,
                  results: str | None = None, parallel: int = 1) -> DataFrame:
    """Mean F1 over k folds per sampled parameter map.

    Re-balancing runs inside each training fold (``resample_fn``); it does not
    depend on the trial, so each fold's training set is built and written to
    the shared checkpoint folder once and reused by every trial.

    ``parallel`` trials run their Spark jobs at the same time.  With ``results``
    (a folder for one search: the same data, kind and folds) every finished
    trial is appended to a table there, and a search that is started again
    runs only the trials whose number and parameters it does not hold.
    """
    spark = folds.sparkSession
    sampled = [(t, params, json_params(params)) for t, params in enumerate(sample_params(space, trials, seed))]
    rows = {}
    if results is not None and path_exists(spark, results):
        rows = {(r.trial, r.params): r.mean_f1 for r in spark.read.schema(SEARCH_ROW).parquet(results).collect()}
    todo = [(t, params, text) for t, params, text in sampled if (t, text) not in rows]
    fold_data = []
    for i in range(k if todo else 0):
        tr = folds.where(F.col("fold") != i).drop("fold")
        if resample_fn is not None:
            tr = resample_fn(tr)
        fold_data.append((written(tr, "fold"), folds.where(F.col("fold") == i)))

    def trial(t: int, params: dict, text: str) -> tuple:
        f1s = []
        for tr, va in fold_data:
            model = fit(tr, kind, label, params=params, stored=True)
            f1s.append(M.classification_metrics(score(model, va, label=label)).first()["f1_score"])
        return t, text, float(sum(f1s) / len(f1s))

    with ThreadPoolExecutor(parallel) as pool:
        for done in as_completed([pool.submit(trial, *x) for x in todo]):
            t, text, f1 = done.result()
            rows[t, text] = f1
            if results is not None:      # here, one after another: appends to one folder must not overlap
                spark.createDataFrame([(t, text, f1)], SEARCH_ROW).coalesce(1).write.mode("append").parquet(results)
    return spark.createDataFrame([(t, text, rows[t, text]) for t, _, text in sampled], SEARCH_ROW)


def json_params(p: dict) -> str:
    import json
    return json.dumps({k: (round(v, 6) if isinstance(v, float) else v) for k, v in sorted(p.items())})
