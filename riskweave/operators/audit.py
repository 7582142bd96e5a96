"""Append-only audit tables.

Each table is a Parquet folder under a root path, partitioned by day, with
a fixed schema.  Rows carry a uuid id and a timestamp instead of an
auto-increment counter, so concurrent writers never collide.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import path_exists

DRIFT_CHECKS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("check_type", T.StringType(), True),
    T.StructField("datasets", T.StringType(), True),
    T.StructField("reference_dataset", T.StringType(), True),
    T.StructField("current_dataset", T.StringType(), True),
    T.StructField("fraud_rows", T.LongType(), True),
    T.StructField("legit_rows", T.LongType(), True),
    T.StructField("f1_score", T.DoubleType(), True),
    T.StructField("accuracy", T.DoubleType(), True),
    T.StructField("precision", T.DoubleType(), True),
    T.StructField("recall", T.DoubleType(), True),
    T.StructField("auc_roc", T.DoubleType(), True),
    T.StructField("f1_threshold", T.DoubleType(), True),
    T.StructField("f1_passed", T.BooleanType(), True),
    T.StructField("drift_detected", T.BooleanType(), True),
    T.StructField("drift_share", T.DoubleType(), True),
    T.StructField("drifted_features", T.ArrayType(T.StringType()), True),
    T.StructField("drift_threshold", T.DoubleType(), True),
    T.StructField("retrain_triggered", T.BooleanType(), True),
    T.StructField("retrain_reason", T.StringType(), True),
    T.StructField("report_path", T.StringType(), True),
    T.StructField("error", T.StringType(), True),
])

RETRAIN_EVENTS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("check_id", T.StringType(), True),
    T.StructField("reason", T.StringType(), True),
    T.StructField("data_path", T.StringType(), True),
    T.StructField("rows_before", T.LongType(), True),
    T.StructField("rows_after", T.LongType(), True),
    T.StructField("resampled", T.BooleanType(), True),
    T.StructField("model_path", T.StringType(), True),
    T.StructField("backup_path", T.StringType(), True),
    T.StructField("metrics_before", T.StringType(), True),
    T.StructField("metrics_after", T.StringType(), True),
    T.StructField("f1_before", T.DoubleType(), True),
    T.StructField("f1_after", T.DoubleType(), True),
    T.StructField("accuracy_after", T.DoubleType(), True),
    T.StructField("auc_after", T.DoubleType(), True),
    T.StructField("success", T.BooleanType(), True),
    T.StructField("error", T.StringType(), True),
    T.StructField("duration_sec", T.DoubleType(), True),
])

SCHEDULER_LOG = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("event", T.StringType(), True),
    T.StructField("message", T.StringType(), True),
    T.StructField("next_run", T.TimestampType(), True),
])

SCHEMAS = {"drift_checks": DRIFT_CHECKS, "retrain_events": RETRAIN_EVENTS,
           "scheduler_log": SCHEDULER_LOG}


def _path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table}"


def append(spark: SparkSession, root: str, table: str, row: dict) -> str:
    """Append one audit row (S12); returns its id."""
    schema = SCHEMAS[table]
    row = dict(row)
    row.setdefault("id", uuid.uuid4().hex)
    row.setdefault("timestamp", dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
    for k in ("metrics_before", "metrics_after"):
        if isinstance(row.get(k), dict):
            row[k] = json.dumps(row[k], sort_keys=True)
    values = tuple(row.get(f.name) for f in schema.fields)
    df = spark.createDataFrame([values], schema)
    df.withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("day") \
      .parquet(_path(root, table))
    return row["id"]


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    p = _path(root, table)
    schema = T.StructType(SCHEMAS[table].fields + [T.StructField("day", T.DateType())])
    if not path_exists(spark, p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(p)


def recent(spark: SparkSession, root: str, table: str, n: int = 10) -> DataFrame:
    """Newest n rows."""
    return read(spark, root, table).orderBy(F.desc("timestamp"), F.desc("id")).limit(n)


def last_f1(spark: SparkSession, root: str) -> DataFrame:
    """Most recent recorded F1 (S14); a NULL F1 stays NULL."""
    return read(spark, root, "drift_checks").agg(
        F.max_by("f1_score", F.struct("timestamp", "id")).alias("last_f1"))


def retrain_report(spark: SparkSession, root: str) -> DataFrame:
    """Retrain events with the check that triggered them."""
    ev = read(spark, root, "retrain_events").alias("e")
    ck = read(spark, root, "drift_checks").alias("c")
    return ev.join(ck, F.col("e.check_id") == F.col("c.id"), "left").select(
        F.col("e.id").alias("retrain_id"), F.col("e.timestamp").alias("retrained_at"),
        F.col("e.success"), F.col("e.reason"), F.col("c.id").alias("check_id"),
        F.col("c.f1_score"), F.col("c.drift_share"), F.col("c.retrain_reason"))


def backups_to_keep(spark: SparkSession, root: str, keep: int) -> DataFrame:
    """Backup pointers with a keep flag: only the newest ``keep`` survive."""
    ev = read(spark, root, "retrain_events").where(F.col("backup_path").isNotNull())
    w = Window.orderBy(F.desc("timestamp"), F.desc("id"))
    return ev.select("backup_path", "timestamp",
                     (F.row_number().over(w) <= keep).alias("keep"))


def prune_backups(spark: SparkSession, root: str, keep: int) -> list[str]:
    """Delete model backups beyond the newest ``keep`` (S16) through the Hadoop
    file system of each path (works for HDFS / object stores alike)."""
    old = [r.backup_path for r in backups_to_keep(spark, root, keep).where(~F.col("keep")).collect()]
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    deleted = []
    for p in old:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if fs.exists(path) and fs.delete(path, True):
            deleted.append(p)
    return deleted
