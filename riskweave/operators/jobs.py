"""Batch jobs composed from the operators: retrain (M16) and drift check.

Both are plain Spark batch jobs meant to be launched by any external
scheduler; every run leaves an audit row, also when it fails.
"""

from __future__ import annotations

import datetime as dt
import time
import traceback

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..session import cut_lineage
from . import audit, balance, drift, metrics, models

# Weekly cadence of the external scheduler, recorded as the next run.
CHECK_INTERVAL_DAYS = 7


def retrain(data: DataFrame, model_root: str, audit_root: str, reason: str,
            check_id: str | None = None, metrics_before: dict | None = None,
            use_smote: bool = True, params: dict | None = None, data_path: str | None = None,
            publish: bool = True) -> dict:
    """Split -> (SMOTE) -> fit tuned boosted trees -> evaluate -> versioned save -> publish -> audit.

    With ``publish`` running streams that score with ``models.Published(model_root)``
    take the new model with their next micro-batch."""
    spark = data.sparkSession
    t0 = time.time()
    row = {"check_id": check_id, "reason": reason, "data_path": data_path,
           "resampled": use_smote, "metrics_before": metrics_before or {}}
    try:
        s = balance.stratified_split(data)
        train = s.where(F.col("is_train"))
        test = s.where(~F.col("is_train"))
        row["rows_before"] = train.count()
        p = models.tuned_gbt_params("first")
        p.update(params or {})
        if use_smote:
            train = cut_lineage(balance.resample(train))
            model = models.fit(train, "gbt", params=p)
        else:
            # Saved positive-class weight applies only without re-balancing.
            model = models.fit(train, "gbt", params=p,
                               pos_weight=C.TUNED_PARAMS["first"]["scale_pos_weight"])
        row["rows_after"] = train.count()
        after = models.evaluate(models.score(model, test), "retrained").first().asDict()
        row.update(f1_after=after["f1_score"], accuracy_after=after["accuracy"], auc_after=after["auc_roc"],
                   f1_before=(metrics_before or {}).get("f1_score"))
        row["metrics_after"] = {k: after[k] for k in ("accuracy", "precision", "recall",
                                                      "f1_score", "auc_roc")}
        path = models.save(model, model_root, "boosted_trees")
        if publish:
            row["version"] = models.publish(spark, model_root, path)
        row.update(model_path=path, backup_path=path, success=True)
    except Exception as e:  # noqa: BLE001 - the audit row records the failure
        row.update(success=False, error=f"{e}\n{traceback.format_exc()}")
    row["duration_sec"] = round(time.time() - t0, 3)
    row["id"] = audit.append(spark, audit_root, "retrain_events", row)
    return row


def drift_check(scored_current: DataFrame, reference: DataFrame, current: DataFrame,
                audit_root: str, model_root: str | None = None,
                training_data: DataFrame | None = None, force: bool = False,
                retrain_params: dict | None = None, check_type: str = "scheduled",
                reference_name: str = "reference", current_name: str = "current") -> dict:
    """Evaluate -> PSI drift -> retrain decision -> audit -> optional retrain -> summary.

    ``scored_current`` holds is_fraud, probability, prediction for labelled
    current data; ``reference`` / ``current`` hold the feature columns.
    ``check_type``: scheduled, manual or forced_retrain (the latter when
    ``force`` is set).  A failing step leaves an audit row with its error and
    is raised again.
    """
    spark = scored_current.sparkSession
    check_type = "forced_retrain" if force else check_type
    named = {"check_type": check_type, "datasets": f"{reference_name}|{current_name}",
             "reference_dataset": reference_name, "current_dataset": current_name}
    audit.append(spark, audit_root, "scheduler_log", {"event": "CHECK_STARTED", "message": "drift check"})
    try:
        check = {**named, **_checked(scored_current, reference, current, force)}
    except Exception as e:
        audit.append(spark, audit_root, "drift_checks", {**named, "error": f"{e}\n{traceback.format_exc()}"})
        audit.append(spark, audit_root, "scheduler_log", {"event": "CHECK_FAILED", "message": str(e)})
        raise
    check_id = audit.append(spark, audit_root, "drift_checks", check)
    summary = {"check_id": check_id, **check, "retrain": None}
    if check["retrain_triggered"] and training_data is not None and model_root is not None:
        summary["retrain"] = retrain(training_data, model_root, audit_root, check["retrain_reason"],
                                     check_id, {k: check[k] for k in ("f1_score", "auc_roc")},
                                     params=retrain_params)
        audit.prune_backups(spark, audit_root, C.MAX_BACKUPS)
    next_run = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) + dt.timedelta(days=CHECK_INTERVAL_DAYS)
    audit.append(spark, audit_root, "scheduler_log",
                 {"event": "CHECK_DONE", "message": check["retrain_reason"], "next_run": next_run})
    return summary


def _checked(scored_current: DataFrame, reference: DataFrame, current: DataFrame, force: bool) -> dict:
    """Metrics, drift and decision; each input is evaluated once, the decision works on their one-row results."""
    spark = scored_current.sparkSession
    perf = metrics.classification_metrics(scored_current).first().asDict()
    area = metrics.auc(scored_current).first()
    verdict = drift.drift_verdict(drift.psi(reference, current))
    v = verdict.first()
    m1 = spark.createDataFrame([(perf["f1_score"],)], "f1_score double")
    v1 = spark.createDataFrame([v], verdict.schema)
    decision = drift.retrain_decision(m1, v1, force).first()
    return {
        "f1_score": perf["f1_score"], "accuracy": perf["accuracy"], "precision": perf["precision"],
        "recall": perf["recall"], "auc_roc": area["auc_roc"], "fraud_rows": area["positives"],
        "legit_rows": area["negatives"], "f1_threshold": C.F1_THRESHOLD,
        "f1_passed": perf["f1_score"] >= C.F1_THRESHOLD, "drift_detected": v["drift_detected"],
        "drift_share": v["drift_share"], "drifted_features": list(v["drifted_features"]),
        "drift_threshold": C.DRIFT_SHARE_THRESHOLD, "retrain_triggered": decision["retrain"],
        "retrain_reason": decision["reason"],
    }
