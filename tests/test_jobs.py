"""Audit tables, retrain and drift-check jobs, seeding and sinks."""

import os

from pyspark.sql import functions as F

from riskweave.operators import audit, balance, jobs
from riskweave.sources.sinks import first_existing, seed_if_empty, write_csv
from riskweave.sources.tables import read_csv

SF = "/root/testdata/sf0.001"


def _features(spark):
    from riskweave.plans import registry
    registry.load_all()
    from riskweave.plans.q_models import feature_table
    return feature_table(spark, SF)


def test_audit_roundtrip(spark, scratch):
    a = audit.append(spark, scratch, "drift_checks", {"f1_score": 0.5, "drift_share": 0.1})
    b = audit.append(spark, scratch, "drift_checks", {"f1_score": None})
    assert audit.recent(spark, scratch, "drift_checks", 1).first().id == b
    assert audit.last_f1(spark, scratch).first().last_f1 is None
    r = audit.append(spark, scratch, "retrain_events", {"check_id": a, "success": True,
                                                        "backup_path": "/x", "metrics_after": {"f1": 1}})
    rep = audit.retrain_report(spark, scratch).first()
    assert rep.retrain_id == r and rep.check_id == a and rep.f1_score == 0.5
    assert audit.backups_to_keep(spark, scratch, 1).first().keep


def test_drift_check_and_retrain(spark, scratch):
    feats = _features(spark)
    from riskweave.operators import risk
    scored = risk.logodds_from_features(feats, with_map=False)
    shifted = feats.withColumn("amount", F.col("amount") * 1.6)
    summary = jobs.drift_check(scored, feats, shifted, os.path.join(scratch, "audit"),
                               os.path.join(scratch, "models"), training_data=feats, force=True,
                               retrain_params={"maxIter": 5, "maxDepth": 3})
    assert summary["retrain_triggered"] is True
    rt = summary["retrain"]
    assert rt["success"], rt.get("error")
    assert os.path.exists(rt["model_path"])
    rows = audit.read(spark, os.path.join(scratch, "audit"), "retrain_events").collect()
    assert len(rows) == 1 and rows[0].check_id == summary["check_id"]
    log = audit.read(spark, os.path.join(scratch, "audit"), "scheduler_log").collect()
    assert sorted(r.event for r in log) == ["CHECK_DONE", "CHECK_STARTED"]


def test_retrain_failure_is_audited(spark, scratch):
    feats = _features(spark).drop("amount")
    row = jobs.retrain(feats, os.path.join(scratch, "m"), os.path.join(scratch, "a"), "test")
    assert row["success"] is False and row["error"]
    assert audit.read(spark, os.path.join(scratch, "a"), "retrain_events").count() == 1


def test_smote_invariants(spark):
    feats = _features(spark)
    train = balance.split(feats).where("is_train")
    res = balance.resample(train)
    counts = {r.is_fraud: r.n for r in res.groupBy("is_fraud").agg(F.count("*").alias("n")).collect()}
    assert counts[0] == counts[1]
    syn = balance.smote_rows(train)
    # Synthetic rows keep their cell (flags are 0/1) and stay in the amount range.
    assert syn.where((F.col("amount") < 0) | (F.col("amount") > 1)).count() == 0
    assert syn.count() == syn.select("transaction_id").distinct().count()
    # Re-runs are identical.
    assert sorted(syn.collect()) == sorted(balance.smote_rows(train).collect())


def test_seed_and_sinks(spark, scratch):
    a = spark.createDataFrame([(1,)], "x int")
    empty = a.where("x > 5")
    assert seed_if_empty(empty, a).count() == 1
    assert seed_if_empty(a, spark.createDataFrame([(2,)], "x int")).collect()[0].x == 1
    p = os.path.join(scratch, "csv")
    write_csv(a, p)
    assert read_csv(spark, first_existing("/nonexistent", p), a.schema).first().x == 1


def test_prune_backups(spark, scratch):
    import time
    paths = []
    for i in range(3):
        p = os.path.join(scratch, "models", f"b{i}")
        os.makedirs(p)
        paths.append(p)
        audit.append(spark, scratch, "retrain_events", {"backup_path": p, "success": True})
        time.sleep(0.01)
    deleted = audit.prune_backups(spark, scratch, keep=1)
    assert sorted(deleted) == sorted(paths[:2])
    assert os.path.exists(paths[2]) and not os.path.exists(paths[0])
