"""Two-sample drift tests and distances, chosen by a column's type.

* number: Kolmogorov-Smirnov test; Wasserstein distance in standard deviations of the reference;
* flag (boolean, or a number that is only ever 0 or 1): test of two proportions; Jensen-Shannon distance;
* category (text): chi-square test of side x value; Jensen-Shannon distance.

Rows are counted per distinct value before anything else (a map-side combine),
so a value that holds a third of the rows is one row here.  Empirical
distributions run over value ranges of about equal depth, each with its own
window, after the totals of the ranges before it: exact, and no task sees all
values.  NULL and NaN take no part.  A column without values on a side has no
statistic (NULL) and no drift.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import nan_to_null, rnd
from .balance import bucket_count
from .drift import chi2_test

NUMBER, FLAG, CATEGORY = "number", "flag", "category"
ALPHA, FAR = 0.05, 0.1
KS_TERMS = 100
LEAST_STD = 0.001       # a constant reference is scaled by this


def kinds(reference: DataFrame, current: DataFrame, columns: list[str]) -> dict[str, str]:
    """Kind of every column; one aggregate finds the numbers that are only 0 or 1."""
    types = {f.name: f.dataType for f in reference.schema.fields}
    numbers = [c for c in columns if isinstance(types[c], T.NumericType)]
    other = lambda c: F.count_if(~F.col(c).cast("double").isin(0.0, 1.0))
    both = reference.select(*[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(numbers)]).unionByName(
        current.select(*[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(numbers)]))
    row = both.agg(F.count(F.lit(1)), *[other(f"x{i}") for i in range(len(numbers))]).first()
    flags = {c for i, c in enumerate(numbers) if not row[i + 1]}
    return {c: FLAG if c in flags or isinstance(types[c], T.BooleanType) else NUMBER if c in numbers else CATEGORY
            for c in columns}


def value_counts(reference: DataFrame, current: DataFrame, column: str, kind: str) -> DataFrame:
    """x, ref, cur: rows of both sides per distinct value."""
    x = F.col(f"`{column}`")
    x = x.cast("string") if kind == CATEGORY else nan_to_null(x.cast("double"))
    both = reference.select(x.alias("x"), F.lit(1).alias("ref"), F.lit(0).alias("cur")).unionByName(
        current.select(x.alias("x"), F.lit(0).alias("ref"), F.lit(1).alias("cur")))
    return both.where(F.col("x").isNotNull()).groupBy("x").agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))


def distribution(counts: DataFrame, buckets: int | None = None) -> DataFrame:
    """x, ref, cur with ``below`` (x of the next smaller value) and the rows of both sides below x."""
    buckets = buckets or bucket_count(counts)
    edges = counts.agg(F.percentile_approx("x", [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    bounds = F.array(*[F.lit(e) for e in sorted(set(edges))]).cast("array<double>")
    b = counts.withColumn("b", F.size(F.filter(bounds, lambda e: e < F.col("x"))))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)      # at most ``buckets`` + 1 rows
    ahead = (b.groupBy("b").agg(F.sum("ref").alias("r"), F.sum("cur").alias("c"), F.max("x").alias("x"))
             .select("b", F.sum("r").over(before).alias("r"), F.sum("c").over(before).alias("c"), F.max("x").over(before).alias("m")))
    own = Window.partitionBy("b").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    inner = b.select("*", F.sum("ref").over(own).alias("ir"), F.sum("cur").over(own).alias("ic"), F.max("x").over(own).alias("im"))
    zero = F.lit(0)
    return inner.join(F.broadcast(ahead), "b").select(
        "x", "ref", "cur", F.coalesce("im", "m").alias("below"),
        (F.coalesce("r", zero) + F.coalesce("ir", zero)).alias("ref_below"),
        (F.coalesce("c", zero) + F.coalesce("ic", zero)).alias("cur_below"))


def _with_totals(counts: DataFrame, rows: DataFrame) -> DataFrame:
    # a side without rows has NULL, and so has all that is divided by it
    total = counts.agg(*[F.nullif(F.sum(c).cast("double"), F.lit(0.0)).alias(a) for c, a in (("ref", "n"), ("cur", "m"))])
    return rows.crossJoin(F.broadcast(total))                                    # one row


def ks_p_value(ks: Column, n: Column, m: Column) -> Column:
    """Asymptotic p-value of the two-sample statistic."""
    lam = F.sqrt(n * m / (n + m)) * ks
    terms = F.transform(F.sequence(F.lit(1), F.lit(KS_TERMS)), lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0)
                        * F.exp(-2.0 * k * k * lam * lam))
    total = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
    return F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def upper_tail(z: Column) -> Column:
    """Share of the normal distribution above ``z`` >= 0 (rational approximation, error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / 2.5066282746310002 * poly


def _test(counts: DataFrame, kind: str) -> DataFrame:
    """statistic, p_value of one column."""
    if kind == NUMBER:
        d = _with_totals(counts, distribution(counts))
        gap = F.abs((F.col("ref_below") + F.col("ref")) / F.col("n") - (F.col("cur_below") + F.col("cur")) / F.col("m"))
        g = d.agg(F.max(gap).alias("s"), F.max("n").alias("n"), F.max("m").alias("m"))
        return g.select(F.col("s").alias("statistic"), ks_p_value(F.col("s"), F.col("n"), F.col("m")).alias("p_value"))
    if kind == FLAG:
        one = F.col("x") == 1.0
        g = counts.agg(*[F.nullif(F.sum(c).cast("double"), F.lit(0.0)).alias(a) for c, a in (("ref", "n"), ("cur", "m"))],
                       *[F.coalesce(F.sum(F.when(one, F.col(c))), F.lit(0)).cast("double").alias(a)
                         for c, a in (("ref", "a"), ("cur", "b"))])
        pool = (F.col("a") + F.col("b")) / (F.col("n") + F.col("m"))
        spread = F.sqrt(pool * (1 - pool) * (1 / F.col("n") + 1 / F.col("m")))
        z = F.when((F.col("n") > 0) & (F.col("m") > 0),
                   F.when(spread > 0, (F.col("b") / F.col("m") - F.col("a") / F.col("n")) / spread).otherwise(0.0))
        return g.select(z.alias("statistic"), F.when(z.isNotNull(), 2 * upper_tail(F.abs(z))).alias("p_value"))
    d = _with_totals(counts, counts)
    share = (F.col("ref") + F.col("cur")) / (F.col("n") + F.col("m"))
    er, ec = F.col("n") * share, F.col("m") * share
    term = (F.col("ref") - er) * (F.col("ref") - er) / er + (F.col("cur") - ec) * (F.col("cur") - ec) / ec
    g = d.where((F.col("n") > 0) & (F.col("m") > 0)).agg(F.sum(term).alias("chi2"), F.greatest(F.count("x") - 1, F.lit(0)).alias("dof"))
    return chi2_test(g).select(F.col("chi2").alias("statistic"), F.when(F.col("chi2").isNotNull(), F.col("p_value")).alias("p_value"))


def tests(reference: DataFrame, current: DataFrame, columns: list[str], alpha: float = ALPHA) -> DataFrame:
    """feature, kind, test, statistic, p_value, drifted for every column."""
    names = {NUMBER: "kolmogorov_smirnov", FLAG: "proportions_z", CATEGORY: "chi_square"}
    out = []
    for c, kind in kinds(reference, current, columns).items():
        t = _test(value_counts(reference, current, c, kind), kind)
        out.append(t.select(F.lit(c).alias("feature"), F.lit(kind).alias("kind"), F.lit(names[kind]).alias("test"),
                            rnd("statistic", 6).alias("statistic"), rnd("p_value", 6).alias("p_value"),
                            F.coalesce(F.col("p_value") < alpha, F.lit(False)).alias("drifted")))
    return reduce(DataFrame.unionByName, out)


def _distance(counts: DataFrame, kind: str) -> DataFrame:
    if kind == NUMBER:
        d = _with_totals(counts, distribution(counts))
        n = F.col("ref").cast("double")
        rows = F.nullif(F.sum(n), F.lit(0.0))
        mean = F.sum(n * F.col("x")) / rows
        std = F.sqrt(F.greatest(F.sum(n * F.col("x") * F.col("x")) / rows - mean * mean, F.lit(0.0)))
        area = F.sum(F.abs(F.col("ref_below") / F.col("n") - F.col("cur_below") / F.col("m"))
                     * (F.col("x") - F.col("below")))
        g = d.agg(F.coalesce(area, F.lit(0.0)).alias("area"), std.alias("std"), F.max("n").alias("n"), F.max("m").alias("m"))
        return g.select(F.when((F.col("n") > 0) & (F.col("m") > 0),
                               F.col("area") / F.greatest(F.col("std"), F.lit(LEAST_STD))).alias("distance"))
    d = _with_totals(counts, counts)
    p, q = F.col("ref") / F.col("n"), F.col("cur") / F.col("m")
    mid = (p + q) / 2
    part = lambda s: F.when(s > 0, s * F.log2(s / mid)).otherwise(0.0)
    g = d.where((F.col("n") > 0) & (F.col("m") > 0)).agg(F.sum(part(p) + part(q)).alias("s"))
    return g.select(F.when(F.col("s").isNotNull(), F.sqrt(F.greatest(F.col("s") / 2, F.lit(0.0)))).alias("distance"))


def distances(reference: DataFrame, current: DataFrame, columns: list[str], far: float = FAR) -> DataFrame:
    """feature, kind, measure, distance, drifted for every column."""
    out = []
    for c, kind in kinds(reference, current, columns).items():
        d = _distance(value_counts(reference, current, c, kind), kind)
        measure = "wasserstein_std" if kind == NUMBER else "jensen_shannon"
        out.append(d.select(F.lit(c).alias("feature"), F.lit(kind).alias("kind"), F.lit(measure).alias("measure"),
                            rnd("distance", 6).alias("distance"),
                            F.coalesce(F.col("distance") >= far, F.lit(False)).alias("drifted")))
    return reduce(DataFrame.unionByName, out)
