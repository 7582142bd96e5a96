"""Per-key sliding-window counts and sums (X1-X4) that stay balanced under skew.

A plain ``Window.partitionBy(sender).orderBy(ts).rangeBetween(-1h, 0)`` sends
every row of one sender to one task; a sender holding a third of the table
would then run on a single core.  Here the window key is (sender, time
bucket) instead: each row is scored inside its own bucket, and a slim copy
(key and time only) of every row is also placed in the following bucket(s)
so a window that reaches back across a bucket edge still sees it.  Partition
size is then bounded by what one sender does in ``window + bucket`` seconds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_OWN = "__own"
_BKT = "__bucket"
_T = "__t_us"


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def windowed_count(df: DataFrame, keys: list[str], ts_col: str, seconds: int,
                   out: str, *, where: Column | None = None, value: str | None = None,
                   bucket_seconds: int = 3600, include_self: bool = False) -> DataFrame:
    """Add ``out`` = count (or sum of ``value``) of rows with the same ``keys`` and
    ``ts`` in ``[ts - seconds, ts]``.  ``where`` restricts which rows are counted
    (every row still gets an output).  The row itself is excluded unless
    ``include_self``.
    """
    lag_buckets = max(1, math.ceil(seconds / bucket_seconds))
    span = seconds * 1_000_000
    t = _micros(F.col(ts_col))
    bucket = F.floor(t / (bucket_seconds * 1_000_000))
    counted = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    measure = F.lit(1) if value is None else F.col(value)

    own = (df.withColumn(_T, t).withColumn(_BKT, bucket)
             .withColumn(_OWN, F.lit(True))
             .withColumn("__m", F.when(counted, measure)))
    ctx = (df.where(counted)
             .select(*keys, t.alias(_T), measure.alias("__m"),
                     F.explode(F.sequence(F.lit(1), F.lit(lag_buckets))).alias("__off"))
             .withColumn(_BKT, F.floor(F.col(_T) / (bucket_seconds * 1_000_000)) + F.col("__off"))
             .drop("__off")
             .withColumn(_OWN, F.lit(False)))
    w = Window.partitionBy(*keys, _BKT).orderBy(_T)
    both = own.unionByName(ctx, allowMissingColumns=True)
    if value is None:
        # Rows up to this time minus rows before the window: both are running counts over one sort, so the
        # cost is linear in the bucket's rows (a sliding frame would be recounted for every row).
        reach = F.count("__m").over(w.rangeBetween(Window.unboundedPreceding, 0))
        before = F.count("__m").over(w.rangeBetween(Window.unboundedPreceding, -span - 1))
        res = both.withColumn(out, reach - before).where(F.col(_OWN))
    else:
        res = both.withColumn(out, F.sum("__m").over(w.rangeBetween(-span, 0))).where(F.col(_OWN))
    if not include_self:
        res = res.withColumn(out, F.col(out) - F.when(counted, measure).otherwise(0))
    if value is None:
        res = res.withColumn(out, F.col(out).cast("int"))
    return res.drop(_OWN, _BKT, _T, "__m")


def day_running_sum(df: DataFrame, keys: list[str], ts_col: str, value: str, out: str,
                    where: Column | None = None) -> DataFrame:
    """Running total of ``value`` per key and calendar day, up to and including
    the row (rows with the same time included).

    Two levels, so one key-day never lands in one task: a running sum inside
    each (key, day, hour), plus the hour's offset taken from a table of at
    most 24 rows per key-day (its window is tiny), joined back on the fine key.
    """
    counted = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    t = _micros(F.col(ts_col))
    d = (df.withColumn("__day", F.to_date(F.col(ts_col)))
           .withColumn("__hr", F.hour(F.col(ts_col).cast("timestamp_ntz")))
           .withColumn("__t", t)
           .withColumn("__v", F.when(counted, F.col(value)).otherwise(F.lit(0.0))))
    inner_w = (Window.partitionBy(*keys, "__day", "__hr").orderBy("__t")
               .rangeBetween(Window.unboundedPreceding, 0))
    inner = d.withColumn("__in", F.sum("__v").over(inner_w))
    hours = d.groupBy(*keys, "__day", "__hr").agg(F.sum("__v").alias("__h"))
    off_w = Window.partitionBy(*keys, "__day").orderBy("__hr").rowsBetween(Window.unboundedPreceding, -1)
    offsets = hours.select(*keys, "__day", "__hr",
                           F.coalesce(F.sum("__h").over(off_w), F.lit(0.0)).alias("__off"))
    res = inner.join(offsets, [*keys, "__day", "__hr"])
    return res.withColumn(out, F.col("__off") + F.col("__in")).drop("__day", "__hr", "__t", "__v",
                                                                     "__in", "__off")


def history_as_of(df: DataFrame, key: str, ts_col: str, item: str, id_col: str,
                  out: str) -> DataFrame:
    """For every row, the sorted distinct ``item`` values its key used strictly
    before ``ts`` (X4).

    First-use per (key, item) is a combinable aggregate; the join back is an
    equi-join on the key with a time condition, so a hot key is split by AQE's
    skew-join handling instead of landing in one window partition.
    """
    first = (df.groupBy(key, item).agg(F.min(ts_col).alias("__first"))
               .withColumnRenamed(key, "__k").withColumnRenamed(item, "__item"))
    base = df.select(id_col, key, ts_col)
    pairs = base.join(first, (base[key] == first["__k"]) & (first["__first"] < base[ts_col]), "left")
    hist = pairs.groupBy(id_col).agg(
        F.sort_array(F.collect_set("__item")).alias(out))
    return df.join(hist, id_col, "left")
