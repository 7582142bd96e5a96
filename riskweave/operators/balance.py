"""Train/test split, stratified folds and SMOTE over-sampling.

Two building blocks keep every step shuffle-only and skew-safe:

* ``rank_within`` gives the exact 0-based rank of each row inside a group
  without putting a whole group into one task: rows are sorted over range
  partitions, numbered there, and shifted by the number of the group's rows in
  the partitions before (one row per group and partition).
* SMOTE neighbours inside a one-hot cell differ only in ``amount``, so the k
  nearest are held by the k distinct points on either side in rank order:
  a window over blocks of ranks, each with the k points beside it.  A point is
  also probed into the rankings of the cells that are no farther than its
  k-th neighbour inside its own cell.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.core import key_uniform
from ..session import cut_lineage, written


def split(df: DataFrame, key: str = "transaction_id", train_frac: float = 0.8,
          seed: str = "split") -> DataFrame:
    """Deterministic 80/20 split by key hash (M1, W5): adds ``is_train``.
    The test side is the complement by construction (J3/U5, no anti-join)."""
    return df.withColumn("is_train", key_uniform(F.col(key), F.lit(seed)) < train_frac)


def bucket_count(df: DataFrame) -> int:
    """Equal-depth buckets for exact ranks: one per ``rank_rows`` rows, at least 64 (edges stay a bounded array)."""
    return min(10_000, max(64, -(-df.count() // C.TUNABLES.rank_rows)))


def stratified_split(df: DataFrame, label: str = "is_fraud", key: str = "transaction_id",
                     train_frac: float = 0.8, seed: str = "split") -> DataFrame:
    """80/20 split inside each class (M1): the first 80 % of a class by key hash are ``is_train``."""
    r = rank_within(df.withColumn("__u", key_uniform(F.col(key), F.lit(seed))), [label], "__u", key, "__rk")
    size = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    out = r.join(F.broadcast(size), label)          # one row per class
    return out.withColumn("is_train", F.col("__rk") < F.round(F.col("__n") * train_frac)) \
              .select(*df.columns, "is_train")


def rank_within(df: DataFrame, groups: list[str], order: str, tie: str, out: str = "rk") -> DataFrame:
    """Exact 0-based rank by (order, tie) inside each group (see module doc).

    ``df`` is read twice (range bounds, then rows); the sorted rows are
    written to the shared folder, so that their numbers stay as they are.
    """
    by = list(dict.fromkeys([*groups, order, tie]))
    s = written(df.repartitionByRange(*by).sortWithinPartitions(*by)
                  .withColumn("__m", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__m", 33)                  # the partition; the rest numbers its rows
    runs = s.groupBy(*groups, part.alias("__p")).agg(F.min("__m").alias("__first"), F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(*groups).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    # One row per group and partition that holds some of it: bounded by the groups plus the partitions.
    shift = runs.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], "__p",
                        (F.coalesce(F.sum("__c").over(before), F.lit(0)) - F.col("__first")).alias("__o"))
    on = part == F.col("__p")
    for i, g in enumerate(groups):
        on = on & s[g].eqNullSafe(F.col(f"__g{i}"))
    return s.join(F.broadcast(shift), on).select(*df.columns, (F.col("__m") + F.col("__o")).cast("long").alias(out))


def stratified_folds(df: DataFrame, label: str = "is_fraud", key: str = "transaction_id",
                     k: int = 5, seed: str = "fold") -> DataFrame:
    """Fold = (rank of the row inside its class by key hash) mod k."""
    d = df.withColumn("__u", key_uniform(F.col(key), F.lit(seed)))
    r = rank_within(d, [label], "__u", key, "__rk")
    return r.withColumn("fold", (F.col("__rk") % k).cast("int")).drop("__u", "__rk")


def cell_key(features=C.FEATURES) -> F.Column:
    """Values of a feature row besides the amount; any numeric flags do, as long as few patterns occur."""
    return F.concat_ws("|", *[F.col(f"`{f}`").cast("double").cast("string") for f in features if f != "amount"])


def ranked_minority(minority: DataFrame, key: str = "transaction_id",
                    features=C.FEATURES) -> DataFrame:
    """Minority rows with their one-hot cell and exact rank by amount inside it."""
    m = _minority(minority, key, features).withColumn("cell", cell_key(features))
    return rank_within(m, ["cell"], "amount", key, "rk")


def _points(r: DataFrame, k: int, key: str, salt: int = 64) -> DataFrame:
    """Distinct (cell, amount) points with their k smallest row keys, ranked.

    Identical rows are never each other's neighbours, so the search runs over
    distinct points.  A point repeated a billion times keeps only k keys: a
    salted partial top-k, then the final top-k over (salt x k) rows."""
    s1 = r.select("cell", "amount", F.col(key).alias("__k"),
                  F.pmod(F.xxhash64(key), F.lit(salt)).alias("__s"))
    w1 = Window.partitionBy("cell", "amount", "__s").orderBy("__k")
    p1 = s1.withColumn("__r", F.row_number().over(w1)).where(F.col("__r") <= k)
    w2 = Window.partitionBy("cell", "amount").orderBy("__k")
    p2 = p1.withColumn("__r", F.row_number().over(w2)).where(F.col("__r") <= k)
    pts = p2.groupBy("cell", "amount").agg(F.sort_array(F.collect_list("__k")).alias("__keys"))
    return rank_within(written(pts, "distinct-points"), ["cell"], "amount", "amount", "__prk")


def _in_cell(pts: DataFrame, k: int) -> DataFrame:
    """(cell, amount, nbrs): every point with its k nearest other rows inside the cell.

    Blocks of consecutive ranks are windows of their own; the k points next to
    a block are copied into it, so no cell has to fit a task."""
    size = max(C.TUNABLES.neighbour_block, k)
    at, blk = F.col("__prk") % size, F.floor(F.col("__prk") / size)
    into = F.array_compact(F.array(blk, F.when(at < k, blk - 1), F.when(at >= size - k, blk + 1)))
    b = pts.withColumn("__home", blk).withColumn("__blk", F.explode(into))
    w = Window.partitionBy("cell", "__blk").orderBy("__prk")
    point = F.struct("amount", "__keys")
    beside = [f(point, d).over(w) for d in range(1, k + 1) for f in (F.lag, F.lead)]
    near = F.flatten(F.transform(F.array_compact(F.col("__near")), lambda p: F.transform(p["__keys"], lambda x: F.struct(
        F.sqrt((F.col("amount") - p["amount"]) * (F.col("amount") - p["amount"])).alias("distance"),
        x.alias("nbr_key"), F.col("cell").alias("nbr_cell"), p["amount"].alias("nbr_amount")))))
    return (b.withColumn("__near", F.array(*beside)).where(F.col("__blk") == F.col("__home"))
             .select("cell", "amount", _nearest(near, k).alias("nbrs")))


def _nearest(candidates, k: int):
    """The first k of (distance, nbr_key, ...) structs; identical rows (distance 0) are no neighbours."""
    return F.slice(F.sort_array(F.filter(candidates, lambda c: c["distance"] > 0)), 1, k)


def _cross_cell(probes: DataFrame, pts: DataFrame, k: int, features=C.FEATURES) -> DataFrame:
    """(cell, amount, far): candidates in other cells for the points that may have a nearer one there.

    ``probes``: (cell, amount, other, flags, nbr_flags).  A point's place
    among the other cell's points by amount is the number of points below it
    (bucketed running counts), and the k points on either side hold the k
    nearest, since inside one cell the distance only grows with the amount gap.
    """
    ask = probes.select(F.struct("cell", "amount", "flags", "nbr_flags").alias("__from"), F.col("other").alias("cell"),
                        "amount", F.lit(0).alias("__real"))
    probed = pts.join(F.broadcast(ask.select("cell").distinct()), "cell", "left_semi")
    real = probed.select(F.lit(None).cast(ask.schema["__from"].dataType).alias("__from"), "cell", "amount",
                         F.lit(1).alias("__real"))
    u = real.unionByName(ask)
    buckets = bucket_count(pts)
    edges = probed.groupBy("cell").agg(F.percentile_approx("amount", [i / buckets for i in range(1, buckets)], 10000)
                                       .alias("__edges"))
    u = u.join(F.broadcast(edges), "cell").withColumn(       # one row per cell
        "__b", F.size(F.filter("__edges", lambda e: e < F.col("amount")))).drop("__edges")
    count = u.groupBy("cell", "__b").agg(F.sum("__real").alias("__c"))
    wo = Window.partitionBy("cell").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offset = count.select("cell", "__b", F.coalesce(F.sum("__c").over(wo), F.lit(0)).alias("__o"))
    w = Window.partitionBy("cell", "__b").orderBy("amount", "__real").rowsBetween(Window.unboundedPreceding, 0)
    at = (u.withColumn("__in", F.sum("__real").over(w)).where("__real = 0").join(F.broadcast(offset), ["cell", "__b"])
           .select("__from", "cell", F.explode(F.sequence(F.lit(-k), F.lit(k - 1))).alias("__d"),
                   (F.col("__in") + F.col("__o")).alias("__p"))
           .select("__from", "cell", (F.col("__p") + F.col("__d")).alias("__prk")))
    found = at.join(pts.select("cell", "__prk", "__keys", F.col("amount").alias("__to")), ["cell", "__prk"]) \
              .withColumnRenamed("cell", "__in")
    total, i = None, 0
    for f in features:
        if f == "amount":
            d = F.col("__from.amount") - F.col("__to")
        else:
            d, i = F.col("__from.flags")[i] - F.col("__from.nbr_flags")[i], i + 1
        total = d * d if total is None else total + d * d
    return (found.select("__from.cell", "__from.amount", F.transform("__keys", lambda x: F.struct(
                F.sqrt(total).alias("distance"), x.alias("nbr_key"), F.col("__in").alias("nbr_cell"),
                F.col("__to").alias("nbr_amount"))).alias("__c"))
            .groupBy("cell", "amount").agg(F.flatten(F.collect_list("__c")).alias("far")))


def cell_flags(r: DataFrame, features=C.FEATURES) -> DataFrame:
    """(cell, flags): the values besides the amount of every cell, in feature order.

    The cells are the one-hot patterns that occur, a list that the features bound."""
    flags = [f for f in features if f != "amount"]
    return r.groupBy("cell").agg(F.min(F.array(*[F.col(f"`{f}`") for f in flags])).alias("flags"))


def neighbour_lists(r: DataFrame, k: int, key: str = "transaction_id", features=C.FEATURES, salt: int = 64) -> DataFrame:
    """(cell, amount, nbrs): per distinct point its k nearest other minority rows, nearest first.

    ``r``: ranked minority rows, written.  ``nbrs`` holds (distance, nbr_key, nbr_cell, nbr_amount)."""
    pts = written(_points(r, k, key, salt), "points")
    near = written(_in_cell(pts, k), "near")
    cells = cut_lineage(cell_flags(r, features))
    pairs = cells.crossJoin(cells.select(F.col("cell").alias("other"), F.col("flags").alias("nbr_flags"))) \
                 .where(F.col("cell") != F.col("other")) \
                 .withColumn("base", F.sqrt(F.aggregate(F.zip_with("flags", "nbr_flags", lambda a, b: (a - b) * (a - b)),
                                                        F.lit(0.0), lambda s, x: s + x)))
    # The distance of two cells' flags is the least distance of their rows; a point needs the cells
    # that are not farther than its k-th neighbour (all cells, if it has fewer).
    kth = F.coalesce(F.get(F.col("nbrs"), F.lit(k - 1))["distance"], F.lit(math.inf))
    probes = written(near.join(F.broadcast(pairs), "cell").where(F.col("base") <= kth)
                     .select("cell", "amount", "other", "flags", "nbr_flags"), "probes")
    if probes.isEmpty():
        return near
    far = _cross_cell(probes, pts, k, features)
    return near.join(far, ["cell", "amount"], "left").select(
        "cell", "amount", F.when(F.col("far").isNull(), F.col("nbrs"))
                           .otherwise(_nearest(F.concat("nbrs", "far"), k)).alias("nbrs"))


def smote_neighbours(minority: DataFrame | None, k: int, key: str = "transaction_id",
                     features=C.FEATURES, salt: int = 64,
                     ranked: DataFrame | None = None) -> DataFrame:
    """k nearest other minority rows per row: (key, nbr_rank, nbr_key, distance).

    Rows identical to the sample are skipped, as in the reference."""
    r = ranked if ranked is not None else ranked_minority(written(_minority(minority, key, features), "minority"), key, features)
    lists = neighbour_lists(r, k, key, features, salt)
    return (r.select(key, "cell", "amount").join(lists, ["cell", "amount"])
             .select(key, F.posexplode("nbrs").alias("__i", "__n"))
             .select(key, (F.col("__i") + 1).cast("int").alias("nbr_rank"), "__n.nbr_key", "__n.distance"))


def _minority(rows: DataFrame, key: str, features) -> DataFrame:
    return rows.select(key, *[F.col(f"`{f}`").cast("double").alias(f) for f in features])


def smote_rows(train: DataFrame, label: str = "is_fraud", key: str = "transaction_id",
               features=C.FEATURES, k_max: int = 2) -> DataFrame:
    """Synthetic minority rows until the classes are level (M2).

    Each minority row receives ``need // M`` synthetic rows, the first
    ``need % M`` rows (by cell, amount, key) one more; neighbour choice and
    interpolation ratio come from key hashes, so the output is reproducible.
    """
    # Class counts (one aggregate), then the minority rows are written to the
    # shared folder.  (An ``Observation`` would save the aggregate
    # pass, but on Spark 4.1 it leaves the session unserializable for ML
    # models fitted afterwards.)
    counts = train.agg(F.count_if(F.col(label) == 1).alias("m"),
                       F.count_if(F.col(label) == 0).alias("M0")).first()
    minority = written(_minority(train.where(F.col(label) == 1), key, features), "minority")
    n_min, n_maj = counts["m"], counts["M0"]
    need = n_maj - n_min
    schema_cols = [key, *features]
    if need <= 0 or n_min == 0:
        return minority.select(*[F.col(f"`{c}`") for c in schema_cols]) \
                       .limit(0).withColumn(label, F.lit(1))
    k = max(min(k_max, n_min - 1), 0)
    # The ranked minority feeds the neighbour search, the cell sizes, the
    # allocation and the generation step: written by the ranking, read four times.
    r = ranked_minority(minority, key, features)
    sizes = r.groupBy("cell").agg(F.count(F.lit(1)).alias("__n"))
    wo = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    # One row per cell: the un-partitioned window runs over that small table only.
    cell_off = sizes.select("cell", F.coalesce(F.sum("__n").over(wo), F.lit(0)).alias("__off"))
    g = r.join(F.broadcast(cell_off), "cell").withColumn("gi", F.col("__off") + F.col("rk"))
    base, extra = need // n_min, need % n_min
    g = g.withColumn("n_syn", F.lit(base) + F.when(F.col("gi") < extra, 1).otherwise(0))
    if k > 0:
        g = g.join(neighbour_lists(r, k, key, features), ["cell", "amount"], "left")
    else:
        g = g.withColumn("nbrs", F.lit(None).cast("array<struct<nbr_cell:string,nbr_amount:double>>"))
    # Few minority rows make many synthetic ones: spread them so that a task makes about ``synthetic_rows``.
    tasks = max(g.sparkSession.sparkContext.defaultParallelism, -(-need // C.TUNABLES.synthetic_rows))
    syn = g.where(F.col("n_syn") > 0).repartition(tasks, key).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("n_syn") - 1)).alias("j"))
    n_nbrs = F.greatest(F.coalesce(F.size("nbrs"), F.lit(0)), F.lit(0))
    u_pick = key_uniform(F.col(key), F.col("j"), F.lit("nbr"))
    ratio = key_uniform(F.col(key), F.col("j"), F.lit("ratio"))
    pick = F.when(n_nbrs > 0, F.element_at("nbrs", (F.floor(u_pick * n_nbrs) + 1).cast("int")))
    # A neighbour's features are its amount and its cell's flags (one row per cell).
    flags = cell_flags(r, features).select(F.col("cell").alias("__nc"), F.col("flags").alias("__nf"))
    syn = syn.withColumn("__p", pick).withColumn("__any", n_nbrs > 0).withColumn("__ratio", ratio)
    syn = syn.join(F.broadcast(flags), syn["__p.nbr_cell"] == F.col("__nc"), "left")
    out, i = [], 0
    for f in features:
        s = F.col(f"`{f}`")
        if f == "amount":
            n = F.col("__p.nbr_amount")
        else:
            n, i = F.col("__nf")[i], i + 1
        interp = s + F.col("__ratio") * (n - s)
        jitter = s + (key_uniform(F.col(key), F.col("j"), F.lit(f)) * 0.02 - 0.01)
        out.append(F.when(F.col("__any"), interp).otherwise(jitter).alias(f))
    return syn.select(F.concat(F.lit("SYN_"), F.col(key), F.lit("_"), F.col("j").cast("string")).alias(key),
                      *out, F.lit(1).alias(label))


def resample(train: DataFrame, label: str = "is_fraud", key: str = "transaction_id",
             features=C.FEATURES) -> DataFrame:
    """Training rows plus synthetic minority rows."""
    syn = smote_rows(train, label, key, features)
    base = train.select(key, *[F.col(f"`{f}`").cast("double").alias(f) for f in features],
                        F.col(label).cast("int").alias(label))
    return base.unionByName(syn.select(key, *features, F.col(label).cast("int").alias(label)),
                            allowMissingColumns=True)
