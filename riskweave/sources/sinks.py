"""Writers and path helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import path_exists


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV sink (S4); one folder of part files, written in parallel."""
    df.write.mode(mode).option("header", True).csv(path)


def append_alert_log(alerts: DataFrame, path: str) -> None:
    """Alert log sink (S7): append-only JSON lines, O(batch) per write."""
    alerts.write.mode("append").json(path)


def first_existing(*paths: str) -> str:
    """Preferred path, else the fallback (S11); asked of each path's own file system."""
    spark = SparkSession.builder.getOrCreate()
    for p in paths:
        if p and path_exists(spark, p):
            return p
    raise FileNotFoundError(f"none of {paths} exists")


def seed_if_empty(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Primary rows, or the secondary rows when the primary is empty.

    One EXISTS subquery decides; no join and no count on the driver."""
    return primary.unionByName(secondary.where(~primary.exists()))
