"""Links among members of shared buckets, and connected components, in DataFrame operations.

``linked`` finds the components that all verified links would give, without
emitting all pairs of a bucket: in every round each unresolved bucket's
leaders (of the members marked ``lead`` the one that shares most buckets and
two by hash) are verified against its members of other components; members
that became connected need no further test.  A bucket is done when all its
members are in one component or every pair across components with a lead has
been tested, so no link between different components can be missed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import release, small, written


#: Pairs across components, per bucket row, that are verified one by one instead of by leaders.
PAIRS = 32


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every end of ``edges`` (a, b); component: its smallest node.

    Contraction: every node points to its smallest neighbour, pointers are
    followed to their roots by doubling, edges are mapped to the roots; each
    round at least halves the nodes that still have edges.  Loops and repeated
    edges are harmless; an empty table has no components.
    """
    e = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(),
                "edges")
    label = None
    while not e.isEmpty():
        both = e.select(F.col("a").alias("node"), F.col("b").alias("near")).union(e.select("b", "a"))
        root = written(both.groupBy("node").agg(F.least("node", F.min("near")).alias("root")), "roots")
        while True:
            up = root.select(F.col("node").alias("root"), F.col("root").alias("top"))
            root = written(root.join(up, "root").select("node", F.col("top").alias("root"),
                                                        (F.col("top") < F.col("root")).alias("moved")), "roots")
            if root.where("moved").isEmpty():
                break
            root = root.drop("moved")
        root = root.select("node", "root")
        if label is None:
            label = root.select("node", F.col("root").alias("component"))
        else:
            step = root.select(F.col("node").alias("component"), "root")
            label = written(label.join(step, "component", "left").select(
                "node", F.coalesce("root", "component").alias("component")), "labels")
        ra, rb = (root.select(F.col("node").alias(c), F.col("root").alias("r" + c)) for c in "ab")
        e = written(e.join(ra, "a").join(rb, "b").where("ra <> rb")
                    .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if label is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return label


def shared_buckets(buckets: DataFrame) -> DataFrame:
    """The distinct rows (sig, node, lead) of buckets that hold more than one node, written to the shared folder.

    ``lead`` (true where the column is absent) says that the node is to be
    compared with every member of the bucket; members without it need no
    comparison with one another, so buckets without a lead are dropped.  Of
    buckets with the same members only one is kept (members are compared by
    their number and two 64-bit combined hashes; the rows are made distinct
    first, as a member that stands on two rows would cancel itself in these).
    """
    if "lead" not in buckets.columns:
        buckets = buckets.withColumn("lead", F.lit(True))
    many = (buckets.groupBy("sig").agg(F.count("*").alias("n"), F.bool_or("lead").alias("any"))
            .where("n > 1 and any").select("sig"))
    many = written(many, "shared")
    release(buckets.sparkSession)
    shared = written(buckets.join(small(many), "sig").groupBy("sig", "node").agg(F.bool_or("lead").alias("lead")), "buckets")
    members = shared.groupBy("sig").agg(F.count("*").alias("n"), *[
        F.bit_xor(F.xxhash64(F.lit(i), "node", "lead")).alias(f"x{i}") for i in (1, 2)]).where("n > 1")
    one = written(members.groupBy("n", "x1", "x2").agg(F.min("sig").alias("sig")).select("sig"), "sigs")
    return written(shared.join(one, "sig"), "buckets")


def linked(shared: DataFrame, verify: Callable[[DataFrame], DataFrame], links: DataFrame | None = None,
           leader_rounds: int = 1) -> DataFrame:
    """(node, component) of the nodes that have a link; shared: from ``shared_buckets``.

    ``verify`` keeps the linked pairs of a table (a, b); ``links`` are links
    known beforehand.  Leader rounds go on until the pairs that are left
    across components are at most ``PAIRS`` times the bucket rows (and at least
    ``leader_rounds`` times); these are then verified one by one, once each.
    """
    b = shared
    budget = PAIRS * b.count()
    nodes = b.groupBy("node").agg((-F.count("*")).alias("rank"))
    b = written(b.join(nodes, "node").select("sig", "node", "lead", "rank", F.col("node").alias("comp")), "buckets")
    edges, done = links, 0
    while not b.isEmpty():
        n, m = F.col("n"), F.col("m")                           # members, and those that only leads are compared with
        left = (b.groupBy("sig", "comp").agg(F.count("*").alias("n"), F.count_if(~F.col("lead")).alias("m"))
                .groupBy("sig").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum(n * n - m * m).alias("same"))
                .agg(F.sum((n * n - m * m - F.col("same")) / 2)).first()[0])
        last = done >= leader_rounds and left <= budget
        if last:
            low = b.where("lead").groupBy("node").agg(F.min("sig").alias("low"))
            low = written(b.join(low, "node", "left").select("sig", "node", "lead", "comp", "low"), "buckets")
            x = low.where("lead").select("sig", F.col("node").alias("a"), F.col("comp").alias("ca"), F.col("low").alias("la"))
            y = low.select("sig", F.col("node").alias("b"), F.col("comp").alias("cb"), F.col("low").alias("lb"),
                           F.col("lead").alias("too"))
            # nodes whose first bucket as a lead is the same meet there and need not meet in their other ones
            pairs = (x.join(y, "sig").where("ca <> cb and (not too or a < b) and (not (la <=> lb) or sig = la)")
                     .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        else:
            lead = b.where("lead").groupBy("sig").agg(F.min(F.struct("rank", "node"))["node"].alias("l0"), *[
                F.min(F.struct(F.xxhash64(F.lit(2 * done + i), "node").alias("h"), "node"))["node"].alias(f"l{i}")
                for i in (1, 2)])
            lead = written(lead.select("sig", F.explode(F.array_distinct(F.array("l0", "l1", "l2"))).alias("head")), "leaders")
            heads = lead.join(b.select("sig", F.col("node").alias("head"), F.col("comp").alias("top")), ["sig", "head"])
            heads = written(heads, "leaders")
            pairs = (b.join(heads, "sig").where("comp <> top")
                     .select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct())
        good = verify(written(pairs, "pairs")).select("a", "b")
        edges = written(good if edges is None else edges.union(good), "links")
        if last:
            break
        label = components(edges)
        rest = b.join(lead.select("sig", F.col("head").alias("node")), ["sig", "node"], "left_anti").drop("comp")
        rest = written(rest.join(label, "node", "left").select(
            "sig", "node", "lead", "rank", F.coalesce("component", "node").alias("comp")), "buckets")
        open_ = (rest.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bool_or("lead").alias("any"))
                 .where("lo < hi and any").select("sig"))
        b = written(rest.join(open_, "sig"), "buckets")
        done += 1
        release(b.sparkSession)
    return components(edges if edges is not None else b.select(F.col("node").alias("a"), F.col("node").alias("b")))
