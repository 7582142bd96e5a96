"""Readers for the driver's Parquet tables and the canonical file formats.

Explicit schemas for CSV / JSON (no inference on a cluster); Parquet keeps
its footer schema so Catalyst can push filters and prune columns into the scan.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(table_path(sf_dir, name))


# Raw mobile-money table (fixture 1).
MONEY_SCHEMA = T.StructType([
    T.StructField("step", T.LongType(), False),
    T.StructField("type", T.StringType(), True),
    T.StructField("amount", T.DoubleType(), True),
    T.StructField("nameOrig", T.StringType(), True),
    T.StructField("oldbalanceOrg", T.DoubleType(), True),
    T.StructField("newbalanceOrig", T.DoubleType(), True),
    T.StructField("nameDest", T.StringType(), True),
    T.StructField("oldbalanceDest", T.DoubleType(), True),
    T.StructField("newbalanceDest", T.DoubleType(), True),
    T.StructField("isFraud", T.IntegerType(), True),
    T.StructField("isFlaggedFraud", T.IntegerType(), True),
])

# Raw card table (fixture 2).
CARD_SCHEMA = T.StructType([
    T.StructField("TransactionID", T.StringType(), False),
    T.StructField("isFraud", T.IntegerType(), True),
    T.StructField("TransactionDT", T.LongType(), True),
    T.StructField("TransactionAmt", T.DoubleType(), True),
    T.StructField("ProductCD", T.StringType(), True),
    T.StructField("card1", T.DoubleType(), True),
    T.StructField("card2", T.DoubleType(), True),
    T.StructField("addr1", T.DoubleType(), True),
    T.StructField("P_emaildomain", T.StringType(), True),
])

# Common transaction table (fixture 3).
COMMON_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("amount", T.DoubleType(), True),
    T.StructField("is_fraud", T.IntegerType(), True),
    T.StructField("channel", T.StringType(), True),
    T.StructField("source_dataset", T.StringType(), True),
])

# Transaction event (fixture 5), as carried on a stream.
EVENT_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType(), True),
    T.StructField("sender", T.LongType(), True),
    T.StructField("amount", T.DoubleType(), True),
    T.StructField("channel", T.StringType(), True),
    T.StructField("location", T.StringType(), True),
    T.StructField("historical_locations", T.ArrayType(T.StringType()), True),
    T.StructField("device_is_new", T.BooleanType(), True),
    T.StructField("tx_count_last_hour", T.IntegerType(), True),
    T.StructField("bvn_matched", T.BooleanType(), True),
    T.StructField("ts", T.TimestampType(), True),
    T.StructField("bank_code", T.StringType(), True),
    T.StructField("account", T.StringType(), True),
    T.StructField("beneficiary", T.LongType(), True),
    T.StructField("is_fraud", T.IntegerType(), True),
    T.StructField("produce_time", T.DoubleType(), True),
])

# Alert record (fixture 7).
ALERT_SCHEMA = T.StructType([
    T.StructField("alert_id", T.StringType(), False),
    T.StructField("transaction_id", T.StringType(), True),
    T.StructField("amount", T.DoubleType(), True),
    T.StructField("channel", T.StringType(), True),
    T.StructField("location", T.StringType(), True),
    T.StructField("model_probability", T.DoubleType(), True),
    T.StructField("rule_risk_score", T.DoubleType(), True),
    T.StructField("triggered_rules", T.ArrayType(T.StringType()), True),
    T.StructField("scoring_latency_ms", T.DoubleType(), True),
    T.StructField("timestamp", T.TimestampType(), True),
    T.StructField("shap_values", T.MapType(T.StringType(), T.DoubleType()), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("flagged_by", T.StringType(), True),
    T.StructField("flagged_at", T.TimestampType(), True),
])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Header CSV scan (S1). Without a schema every column is a string."""
    r = spark.read.option("header", True)
    return r.schema(schema).csv(path) if schema is not None else r.csv(path)


def read_alert_log(spark: SparkSession, path: str, array_files: bool = False) -> DataFrame:
    """Alert log source (S8): JSON lines (our sink), or one JSON array per file
    (``array_files``, the reference's log format)."""
    return spark.read.schema(ALERT_SCHEMA).option("multiLine", array_files).json(path)
