"""Global statistics that stay distributed: exact median, mode, min/max.

``percentile``/``median`` aggregates merge every distinct value of a group
into one task's buffer.  ``exact_median`` instead narrows a value bracket
with a few bounded histogram aggregates (at most ``buckets`` rows each come
back to the driver) and only collects the final bracket once it holds at
most ``collect_limit`` values.  The result equals the textbook median:
the middle value, or the mean of the two middle values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.core import nan_to_null


def _non_null(df: DataFrame, col: str) -> DataFrame:
    return df.select(F.col(col).cast("double").alias("x")).where(
        F.col("x").isNotNull() & ~F.isnan("x"))


def _value_at_rank(x: DataFrame, st, k: int, collect_limit: int, buckets: int) -> float:
    """Value at 0-based rank ``k`` of the sorted column ``x``.

    Infinite values are counted apart.  Each pass cuts the bracket to the one
    histogram bucket that holds the rank, with the smallest and largest value
    in it as new ends; both ends lie in different buckets as long as they
    differ, so the bracket shrinks until it is one value or small enough.
    """
    if k < st["neg"]:
        return -math.inf
    if k >= st["n"] - st["pos"]:
        return math.inf
    lo, hi, below, inside = st["lo"], st["hi"], st["neg"], st["n"] - st["neg"] - st["pos"]
    while lo < hi and inside > collect_limit:
        cur = x.where((F.col("x") >= lo) & (F.col("x") <= hi))
        part = (F.col("x") / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2)
        b = F.greatest(F.lit(0), F.least(F.floor(part * buckets), F.lit(buckets - 1)))
        # the ends keep buckets of their own even if rounding puts them together
        b = F.when(F.col("x") == hi, F.lit(buckets)).when(F.col("x") == lo, F.lit(-1)).otherwise(b)
        hist = sorted(cur.groupBy(b.alias("b")).agg(F.count("x").alias("c"), F.min("x").alias("mn"),
                                                    F.max("x").alias("mx")).collect(), key=lambda r: r["b"])
        for r in hist:
            if below + r["c"] > k:
                lo, hi, inside = r["mn"], r["mx"], r["c"]
                break
            below += r["c"]
    if lo == hi:
        return float(lo)
    vals = sorted(r[0] for r in x.where((F.col("x") >= lo) & (F.col("x") <= hi)).collect())
    return vals[k - below]


def _values_at_ranks(x: DataFrame, st, k1: int, k2: int, collect_limit: int,
                     buckets: int) -> tuple[float, float]:
    """Values at 0-based ranks k1 <= k2, searched one by one (they may lie far apart)."""
    a = _value_at_rank(x, st, k1, collect_limit, buckets)
    return a, a if k1 == k2 else _value_at_rank(x, st, k2, collect_limit, buckets)


def _stats(x: DataFrame):
    inf = F.lit(math.inf)
    fin = F.when(F.abs("x") < inf, F.col("x"))
    return x.agg(F.count("x").alias("n"), F.min(fin).alias("lo"), F.max(fin).alias("hi"),
                 F.count_if(F.col("x") == -inf).alias("neg"), F.count_if(F.col("x") == inf).alias("pos")).first()


def exact_quantile(df: DataFrame, col: str, q: float, collect_limit: int | None = None,
                   buckets: int | None = None) -> float | None:
    """Exact quantile, linear interpolation at position ``(n - 1) * q``."""
    x = _non_null(df, col)
    st = _stats(x)
    n = st["n"]
    if not n:
        return None
    h = (n - 1) * q
    k1 = int(h)
    k2 = min(k1 + 1, n - 1)
    a, b = _values_at_ranks(x, st, k1, k2, collect_limit or C.TUNABLES.quantile_collect_limit,
                            buckets or C.TUNABLES.quantile_buckets)
    return a if a == b else a + (b - a) * (h - k1)


def exact_median(df: DataFrame, col: str, collect_limit: int | None = None,
                 buckets: int | None = None) -> float | None:
    """Middle value, or the mean of the two middle values."""
    x = _non_null(df, col)
    st = _stats(x)
    n = st["n"]
    if not n:
        return None
    a, b = _values_at_ranks(x, st, (n - 1) // 2, n // 2,
                            collect_limit or C.TUNABLES.quantile_collect_limit,
                            buckets or C.TUNABLES.quantile_buckets)
    return a if a == b else a / 2.0 + b / 2.0


def mode_value(df: DataFrame, col: str) -> Column:
    """Most frequent non-null value, smallest on ties, as a lazy scalar subquery.

    The count per value is a combinable aggregate (map-side partial counts),
    so a value holding a third of all rows costs no more than any other.
    """
    g = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("__n"))
    return g.agg(F.min_by(F.col(col), F.struct(-F.col("__n"), F.col(col)))).scalar()


def _nan_as_null(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, nan_to_null(F.col(f"`{col}`"))) if dict(df.dtypes)[col] in ("float", "double") else df


def min_max_scale(df: DataFrame, col: str, out: str | None = None, over: DataFrame | None = None) -> DataFrame:
    """(x - min) / (max - min); a constant column becomes 0.0.

    ``over``: a cheaper table with the same least and greatest value (rows
    before a de-duplication, which drops repeats only).
    """
    out = out or col
    df = _nan_as_null(df, col)
    st = (df if over is None else _nan_as_null(over, col)).agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi"))).scalar()
    # Bind the subquery once; the scaling expression references the columns.
    b = df.select("*", st.alias("__st")).select(
        *[F.col(f"`{c}`") for c in df.columns], F.col("__st.lo").alias("__lo"),
        F.col("__st.hi").alias("__hi"))
    lo, hi = F.col("__lo"), F.col("__hi")
    scaled = F.when(hi - lo == 0, F.lit(0.0)).otherwise((F.col(col) - lo) / (hi - lo))
    return b.withColumn(out, scaled).drop("__lo", "__hi")
