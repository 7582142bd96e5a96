"""Canonical fraud-domain tables projected from the driver's tables.

All projections use integer arithmetic and fixed lookups only, so another
SQL engine reproduces them exactly (the oracle SQL in ``plans.oracle``
carries the same definitions).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.core import lookup
from ..functions.identity import nuban_check_digit
from ..operators.velocity import windowed_count
from .tables import read_table


def _city(idx):
    return lookup(idx, list(enumerate(C.CITIES)))


def transactions(spark: SparkSession, sf_dir: str, with_velocity: bool = False) -> DataFrame:
    """``events`` as card/mobile transactions (one row per event).

    ``with_velocity`` adds ``tx_count_last_hour`` (X1): the sender's other
    transactions in the hour before (and at) this one.
    """
    ev = read_table(spark, sf_dir, "events")
    uid, eid = F.col("user_id"), F.col("event_id")
    home1 = _city(F.pmod(uid, F.lit(7)))
    home2 = _city(F.pmod(uid + 1, F.lit(7)))
    bank = lookup(F.pmod(uid, F.lit(7)), list(enumerate(C.USER_BANKS)))
    serial = F.lpad(F.pmod(eid, F.lit(1_000_000_000)).cast("string"), 9, "0")
    check = F.pmod(nuban_check_digit(bank, serial) + F.pmod(eid, F.lit(2)), F.lit(10))
    df = ev.select(
        F.concat(F.lit("TXN"), eid.cast("string")).alias("transaction_id"),
        eid.alias("event_id"),
        uid.alias("sender"),
        (F.round(F.col("value") * 100) * 50).cast("double").alias("amount"),
        lookup(F.col("event_type"), C.EVENT_CHANNEL).alias("channel"),
        F.when(F.pmod(eid, F.lit(29)) == 0, F.lit(C.FOREIGN_CITY)).otherwise(home1).alias("location"),
        F.array(home1, home2).alias("historical_locations"),
        (F.pmod(eid, F.lit(41)) == 0).alias("device_is_new"),
        (F.pmod(eid, F.lit(53)) != 0).alias("bvn_matched"),
        F.col("ts"),
        bank.alias("bank_code"),
        F.concat(serial, check.cast("string")).alias("account"),
        F.when(F.pmod(eid, F.lit(37)) == 0, F.concat(F.lit("BVN"), uid.cast("string")))
         .otherwise(F.lpad(F.pmod(uid, F.lit(100_000_000_000)).cast("string"), 11, "2"))
         .alias("bvn"),
        F.pmod(eid * 7919, F.lit(200)).alias("beneficiary"),
        F.when(F.pmod(eid, F.lit(20)) == 0, 1).otherwise(0).alias("is_fraud"),
        F.get_json_object(F.col("props"), "$.k").try_cast("double").alias("scoring_latency_ms"),
    )
    if with_velocity:
        df = windowed_count(df, ["sender"], "ts", 3600, "tx_count_last_hour",
                            bucket_seconds=C.TUNABLES.velocity_bucket_seconds)
    return df


def raw_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as the raw mobile-money table (fixture 1) plus its natural key."""
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("order_key"),
        (F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01")).cast("long") * 24).alias("step"),
        F.when(F.pmod(k, F.lit(89)) == 0, F.lit(None).cast("string"))
         .otherwise(lookup(F.col("o_orderpriority"), C.PRIORITY_TYPE)).alias("type"),
        F.when(F.pmod(k, F.lit(97)) == 0, F.lit(None).cast("double"))
         .otherwise(F.col("o_totalprice")).alias("amount"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("nameOrig"),
        F.col("o_totalprice").alias("oldbalanceOrg"),
        F.lit(0.0).alias("newbalanceOrig"),
        F.concat(F.lit("M"), F.pmod(k * 31, F.lit(10007)).cast("string")).alias("nameDest"),
        F.lit(0.0).alias("oldbalanceDest"),
        F.col("o_totalprice").alias("newbalanceDest"),
        F.when(F.pmod(k, F.lit(20)) == 0, 1).otherwise(0).alias("isFraud"),
        F.lit(0).alias("isFlaggedFraud"),
    )


def raw_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as the raw card table (fixture 2)."""
    li = read_table(spark, sf_dir, "lineitem")
    ship = F.to_date("l_shipdate")
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"),
                      F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string"),
                      F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"),
                      ship.cast("string"))
    flag = F.concat(F.col("l_returnflag"), F.col("l_linestatus"))
    return li.select(
        key.alias("TransactionID"),
        F.when(F.pmod(F.col("l_partkey"), F.lit(20)) == 0, 1).otherwise(0).alias("isFraud"),
        (F.datediff(ship, F.lit("1992-01-01")).cast("long") * 86400).alias("TransactionDT"),
        F.col("l_extendedprice").alias("TransactionAmt"),
        lookup(flag, C.FLAG_PRODUCT, C.UNMAPPED_PRODUCT).alias("ProductCD"),
        F.col("l_partkey").cast("double").alias("card1"),
        F.when(F.pmod(F.col("l_partkey"), F.lit(10)) == 0, F.lit(None).cast("double"))
         .otherwise(F.col("l_suppkey").cast("double")).alias("card2"),
        F.pmod(F.col("l_orderkey"), F.lit(500)).cast("double").alias("addr1"),
        F.when(F.pmod(F.col("l_orderkey"), F.lit(3)) == 0, F.lit(None).cast("string"))
         .otherwise(F.lit("mail.example")).alias("P_emaildomain"),
    )
