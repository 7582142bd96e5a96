"""Small fixed dimension tables built from ``config`` literals.

Their size is fixed by the literal lists (tens of rows), which is the proven
bound that makes broadcasting them safe at any data scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import config as C


def banks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.BANKS, "code string, name string")


def geo(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.GEO, "state string, lat double, lon double")
