"""Tables written to the cluster's shared folder, and deterministic id helpers."""

from __future__ import annotations

import gc
import os
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage and survives the loss of any executor, as the files lie
    in the folder that ``spark.checkpoint.dir`` names.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Delete the files of a table that ``written`` made and nothing will read any more."""
    spark = table.sparkSession
    for file in table.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file)).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to any more.

    The cleaner acts when the driver's objects are collected; a long job asks
    for that after a phase whose result has been written.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows up to which a written table of a few short columns is broadcast in a join (some tens of MB).
SMALL_ROWS = 500_000


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A written table, marked for broadcast if it has few rows; beyond that the join shuffles both sides."""
    return F.broadcast(df) if df.limit((rows or SMALL_ROWS) + 1).count() <= (rows or SMALL_ROWS) else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of the id's decimal text (a null id counts as an empty text: 0)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")))


# ---------------------------------------------------------------- files that tasks write themselves
def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder, and the folder's path in it (also inside tasks)."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def put(uri: str, name: str, data) -> None:
    """Write one file so that it appears whole; a repeated task writes the same content again."""
    store, path = file_system(uri)
    store.create_dir(path, recursive=True)
    tmp = f"{path}/.{name}.{os.getpid()}.{os.urandom(4).hex()}"
    with store.open_output_stream(tmp) as f:
        f.write(data)
    store.move(tmp, f"{path}/{name}")
