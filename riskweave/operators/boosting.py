"""Second-order histogram gradient boosting on DataFrames (M6, M7).

Features are cut into quantile bins once, and equal rows of bins and label
become one row with a count (a map-side combine; rows of a hot value weigh no
more than others).  Each round of a tree is one Spark job: every task routes
its rows through the tree so far and adds up gradient, hessian and count per
(open node, feature, bin); Spark sums these cells, and the driver, which sees
at most open nodes x features x bins numbers, picks splits by the Newton gain.
Rows stay where they are; their margin is kept with them, and every
``CUT_EACH`` trees the table is checkpointed, so a lost executor costs at most
those trees.  Where the counted table has no more than ``DRIVER_ROWS`` rows
(some 60 bytes each), the same rounds run on it in the driver instead: every
row of the input is in its counts, and a round costs no Spark job.

Gradients and hessians are summed as integers (a 2**24th of a row), so a model
does not depend on partitions or on the order of sums.

Growth: by depth, or best first up to a number of leaves.  Best first needs a
round per level, not per leaf: each round the splits are chosen from the gains
known so far, and all chosen leaves without a histogram get one together; when
none is left the choice is exactly the best-first one.

Rows without a label are left out of the training; NaN and NULL features have
a bin of their own, and each split learns which side it goes to.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..session import cut_lineage

UNIT = 1 << 24
CUT_EACH = 10
DRIVER_ROWS = 1 << 18
MISSING = 0          # bin of NaN and NULL


@dataclass(frozen=True)
class Params:
    trees: int = 100
    rate: float = 0.3
    depth: int | None = 6           # None: no limit
    leaves: int | None = None       # a number: best-first growth
    l2: float = 1.0
    min_hessian: float = 1.0
    min_rows: int = 1
    min_gain: float = 0.0
    rows: float = 1.0               # share of rows per tree
    columns: float = 1.0            # share of features per tree
    pos_weight: float = 1.0
    bins: int = 256
    from_average: bool = False      # start from the log-odds of the mean label, else from 0
    seed: int = 42


#: Defaults of the two libraries: by depth, and best first.
BY_DEPTH = Params()
BY_LEAF = Params(rate=0.1, depth=None, leaves=31, l2=0.0, min_hessian=1e-3, min_rows=20, from_average=True)


def tuned(which: str) -> Params:
    """The saved parameter sets as Params: "first" grows by depth, "second" best first."""
    t = C.TUNED_PARAMS[which]
    base = BY_DEPTH if which == "first" else BY_LEAF
    return replace(base, trees=int(t["n_estimators"]), rate=float(t["learning_rate"]), depth=int(t["max_depth"]),
                   leaves=int(t["num_leaves"]) if "num_leaves" in t else base.leaves,
                   rows=float(t["subsample"]), columns=float(t["colsample_bytree"]),
                   min_hessian=float(t.get("min_child_weight", base.min_hessian)),
                   min_rows=int(t.get("min_child_samples", base.min_rows)), pos_weight=float(t["scale_pos_weight"]))


@dataclass
class Tree:
    """Arrays by node; node 0 is the root, ``feature`` -1 marks a leaf."""

    feature: np.ndarray
    upto: np.ndarray                # last bin of the left side
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        at = np.arange(len(bins))
        while len(at):
            here = node[at]
            inner = self.feature[here] >= 0
            at, here = at[inner], here[inner]
            b = bins[at, self.feature[here]]
            go_left = np.where(b == MISSING, self.missing_left[here], b <= self.upto[here])
            node[at] = np.where(go_left, self.left[here], self.right[here])
        return node


@dataclass
class Model:
    features: list[str]
    cuts: list[np.ndarray]          # per feature, ascending: bin 1 ends at the first cut
    base: float
    trees: list[Tree] = field(default_factory=list)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for t in self.trees:
            out += t.value[t.leaf_of(bins)]
        return out


# ---------------------------------------------------------------- bins
def cut_points(df: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Distinct quantiles of every feature: at most ``bins`` - 2 numbers each, from one aggregate."""
    probs = [i / (bins - 1) for i in range(1, bins - 1)]
    cols = [F.percentile_approx(F.when(~F.isnan(F.col(f"`{f}`").cast("double")), F.col(f"`{f}`").cast("double")),
                                F.lit(probs), F.lit(100_000)).alias(f"c{i}") for i, f in enumerate(features)]
    row = df.agg(*cols).first()
    return [np.unique(np.array(c if c is not None else [], float)) for c in row]


def bin_rows(columns: list[np.ndarray], cuts: list[np.ndarray]) -> np.ndarray:
    out = np.empty((len(columns[0]) if columns else 0, len(cuts)), np.uint16)
    for j, (x, c) in enumerate(zip(columns, cuts)):
        out[:, j] = np.where(np.isnan(x), MISSING, np.searchsorted(c, x, side="left") + 1)
    return out


def _numbers(rb: pa.RecordBatch, name: str) -> np.ndarray:
    return rb.column(name).cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)


def _matrix(rb: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(rb.column("bins").to_pylist()), "<u2").reshape(-1, width)


def binned(df: DataFrame, features: list[str], cuts: list[np.ndarray], label: str) -> DataFrame:
    """bins, y, n: the distinct rows of bins and label with their counts."""
    names = [f"x{i}" for i in range(len(features))]

    def run(batches):
        for rb in batches:
            b = bin_rows([_numbers(rb, x) for x in names], cuts).astype("<u2")
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in b], pa.binary()), rb.column("y")],
                                             names=["bins", "y"])
    given = df.where(F.col(label).isNotNull()).select(
        *[F.col(f"`{f}`").cast("double").alias(x) for f, x in zip(features, names)], F.col(label).cast("int").alias("y"))
    return given.mapInArrow(run, "bins binary, y int").groupBy("bins", "y").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- one round: cells of the open nodes
def gradients(y: np.ndarray, margin: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of the logistic loss for one row each, in units."""
    prob = 1.0 / (1.0 + np.exp(-margin))
    w = np.where(y == 1, p.pos_weight, 1.0) * UNIT
    return np.rint((prob - y) * w).astype(np.int64), np.rint(prob * (1.0 - prob) * w).astype(np.int64)


def drawn(bins: np.ndarray, y: np.ndarray, n: np.ndarray, tree: int, p: Params) -> np.ndarray:
    """Rows that take part in a tree: each group of equal rows gives its share, rounded by a hash of the group."""
    if p.rows >= 1.0:
        return n
    with np.errstate(over="ignore"):
        h = np.full(len(n), (p.seed * 1_000_003 + tree) & (2**64 - 1), np.uint64)
        for col in (y, *bins.T):
            h = (h ^ col.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    want = n * p.rows
    low = np.floor(want)
    return (low + ((h >> np.uint64(11)) / 2.0**53 < want - low)).astype(np.int64)


def cells(bins, y, n, margin, tree: Tree, number: int, wanted: list[int], columns: list[int], width: int, p: Params):
    """Sums per (wanted node, column, bin): an array [node, column, bin, (gradient, hessian, rows)]."""
    out = np.zeros((len(wanted), len(columns), width, 3), np.int64)
    slot = np.full(len(tree.feature), -1)
    slot[wanted] = np.arange(len(wanted))
    at = slot[tree.leaf_of(bins)]
    take = drawn(bins, y, n, number, p)
    use = (at >= 0) & (take > 0)
    at, take = at[use], take[use]
    g, h = gradients(y[use], margin[use], p)
    sums = (g * take, h * take, take)
    flat = out.reshape(-1, 3)
    first = at * (len(columns) * width)
    for k, j in enumerate(columns):
        key = first + (k * width + bins[use, j])
        for m, v in enumerate(sums):
            np.add.at(flat[:, m], key, v)
    return out


def histograms(rows: DataFrame, tree: Tree, number: int, wanted: list[int], columns: list[int], features: int,
               width: int, p: Params) -> np.ndarray:
    """``cells`` over all rows: added up per task, then by Spark; at most nodes x columns x bins rows come back."""
    shape = (len(wanted), len(columns), width, 3)

    def run(batches):
        total = np.zeros(shape, np.int64)
        for rb in batches:
            total += cells(_matrix(rb, features), rb.column("y").to_numpy(), rb.column("n").to_numpy(),
                           rb.column("margin").to_numpy(), tree, number, wanted, columns, width, p)
        flat = total.reshape(-1, 3)
        at = np.flatnonzero(flat[:, 2])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(flat[at, m]) for m in range(3))],
                                         names=["cell", "g", "h", "n"])
    got = (rows.mapInArrow(run, "cell long, g long, h long, n long").groupBy("cell")
           .agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow())
    out = np.zeros((np.prod(shape[:3]), 3), np.int64)
    out[got.column("cell").to_numpy()] = np.column_stack([got.column(c).to_numpy() for c in ("g", "h", "n")])
    return out.reshape(shape)


# ---------------------------------------------------------------- splits
@dataclass
class Split:
    gain: float
    column: int                     # position among the tree's columns
    upto: int
    missing_left: bool
    left: tuple[int, int, int]      # sums of the left side


def best_split(hist: np.ndarray, p: Params) -> Split | None:
    """Best Newton gain of one node; ties go to the smaller feature, bin, and to missing on the right."""
    total = hist[0].sum(axis=0)
    upto = np.cumsum(hist[:, 1:], axis=1)[:, :-1]                   # [column, last left bin, sums]
    left = np.stack([upto, upto + hist[:, MISSING][:, None, :]], axis=2)
    right = total - left

    def part(s):
        h = s[..., 1] / UNIT + p.l2
        return np.square(s[..., 0] / UNIT) / np.where(h > 0, h, np.inf)
    gain = 0.5 * (part(left) + part(right) - part(total))
    fits = [(s[..., 1] >= p.min_hessian * UNIT) & (s[..., 2] >= max(1, p.min_rows)) for s in (left, right)]
    gain = np.where(fits[0] & fits[1], gain, -np.inf)
    if not gain.size:
        return None
    at = np.unravel_index(np.argmax(gain), gain.shape)
    if not gain[at] > p.min_gain:
        return None
    return Split(float(gain[at]), int(at[0]), int(at[1]) + 1, bool(at[2]), tuple(int(v) for v in left[at]))


@dataclass
class Node:
    sums: tuple[int, int, int] | None
    depth: int
    split: Split | None = None
    asked: bool = False             # its histogram has been taken
    children: tuple[int, int] | None = None


def _can_split(node: Node, p: Params) -> bool:
    if p.depth is not None and node.depth >= p.depth:
        return False
    return node.sums is None or (node.sums[1] >= 2 * p.min_hessian * UNIT and node.sums[2] >= 2 * max(1, p.min_rows))


def choose(nodes: list[Node], p: Params) -> tuple[list[int], list[int]]:
    """(inner nodes, leaves) of the tree under the gains known so far; makes the children of inner nodes."""
    inner, leaves, heap = [], [], []

    def offer(i: int):
        if nodes[i].split is None:
            leaves.append(i)
        else:
            heapq.heappush(heap, (-nodes[i].split.gain, i))
    offer(0)
    while heap:
        if p.leaves is not None and len(leaves) + len(heap) >= p.leaves:
            break
        i = heapq.heappop(heap)[1]
        node = nodes[i]
        if node.children is None:
            left = node.split.left
            right = tuple(a - b for a, b in zip(node.sums, left))
            node.children = (len(nodes), len(nodes) + 1)
            nodes += [Node(left, node.depth + 1), Node(right, node.depth + 1)]
        inner.append(i)
        for c in node.children:
            offer(c)
    return inner, leaves + [i for _, i in heap]


def as_tree(nodes: list[Node], inner: list[int], columns: list[int], p: Params) -> Tree:
    n = len(nodes)
    t = Tree(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64),
             np.zeros(n))
    for i in inner:
        s = nodes[i].split
        t.feature[i], t.upto[i], t.missing_left[i] = columns[s.column], s.upto, s.missing_left
        t.left[i], t.right[i] = nodes[i].children
    for i, node in enumerate(nodes):
        if node.sums and node.sums[1] / UNIT + p.l2 > 0:
            t.value[i] = -p.rate * (node.sums[0] / UNIT) / (node.sums[1] / UNIT + p.l2)
    return t


def grow(histogram, columns: list[int], p: Params) -> Tree:
    """One tree; ``histogram(tree, nodes)`` gives the cells of open nodes."""
    nodes = [Node(None, 0)]
    while True:
        inner, leaves = choose(nodes, p)
        wanted = [i for i in leaves if not nodes[i].asked and _can_split(nodes[i], p)]
        tree = as_tree(nodes, inner, columns, p)
        if not wanted:
            return tree
        for i, hist in zip(wanted, histogram(tree, wanted)):
            if nodes[i].sums is None:
                nodes[i].sums = tuple(int(v) for v in hist[0].sum(axis=0))
            nodes[i].asked = True
            nodes[i].split = best_split(hist, p) if _can_split(nodes[i], p) else None


def columns_of(tree: int, features: int, p: Params) -> list[int]:
    """The features that a tree may use."""
    if p.columns >= 1.0:
        return list(range(features))
    k = max(1, int(features * p.columns))
    return sorted(np.random.default_rng([p.seed, tree]).choice(features, k, replace=False).tolist())


# ---------------------------------------------------------------- training and scoring
def fit(train: DataFrame, features: list[str] = C.FEATURES, label: str = "is_fraud", params: Params = BY_DEPTH) -> Model:
    """Boosted trees for a 0/1 label.  An empty table gives a model without trees."""
    p, features = params, list(features)
    cuts = cut_points(train, features, p.bins)
    data = cut_lineage(binned(train, features, cuts, label))
    ones = data.agg(F.sum(F.col("n") * F.col("y")).alias("ones"), F.sum("n").alias("n")).first()
    base = 0.0
    if p.from_average and ones.n and 0 < ones.ones < ones.n:
        weight = ones.ones * p.pos_weight
        base = float(np.log(weight / (ones.n - ones.ones)))
    model = Model(features, cuts, base)
    if not ones.n or not p.trees:
        return model
    width = max(len(c) for c in cuts) + 2
    if data.limit(DRIVER_ROWS + 1).count() <= DRIVER_ROWS:
        _fit_here(model, data, width, p)
    else:
        _fit_rows(model, data, width, p)
    return model


def _fit_here(model: Model, data: DataFrame, width: int, p: Params) -> None:
    """The trees over a small counted table, held by the driver."""
    got, features = data.toArrow(), len(model.features)
    bins = np.concatenate([_matrix(rb, features) for rb in got.to_batches()])
    y, n = got.column("y").to_numpy(), got.column("n").to_numpy()
    margin = np.full(len(n), model.base)
    for number in range(p.trees):
        columns = columns_of(number, features, p)
        tree = grow(lambda t, nodes: cells(bins, y, n, margin, t, number, nodes, columns, width, p), columns, p)  # noqa: B023
        model.trees.append(tree)
        margin = margin + tree.value[tree.leaf_of(bins)]


def _fit_rows(model: Model, data: DataFrame, width: int, p: Params) -> None:
    """The trees over a counted table of any size, one Spark job per round."""
    features = len(model.features)
    rows, before = data.withColumn("margin", F.lit(model.base)).persist(), None
    for number in range(p.trees):
        columns = columns_of(number, features, p)
        tree = grow(lambda t, nodes: histograms(rows, t, number, nodes, columns, features, width, p), columns, p)  # noqa: B023
        model.trees.append(tree)
        if before is not None:               # the tree's first round has filled the new table
            before.unpersist()
        moved = advance(rows, tree, features)
        before, rows = rows, cut_lineage(moved) if (number + 1) % CUT_EACH == 0 else moved.persist()
    before.unpersist()
    rows.unpersist()


def advance(rows: DataFrame, tree: Tree, features: int) -> DataFrame:
    """The rows with a tree added to their margins."""
    def run(batches):
        for rb in batches:
            margin = rb.column("margin").to_numpy() + tree.value[tree.leaf_of(_matrix(rb, features))]
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in ("bins", "y", "n")), pa.array(margin)],
                                             names=["bins", "y", "n", "margin"])
    return rows.mapInArrow(run, "bins binary, y int, n long, margin double")


def score(model: Model, df: DataFrame, key: str = "transaction_id", label: str = "is_fraud",
          cutoff: float = C.DEFAULT_CUTOFF) -> DataFrame:
    """key, label, probability of class 1 and the label at ``cutoff`` (M9)."""
    names = [f"x{i}" for i in range(len(model.features))]

    def run(batches):
        for rb in batches:
            margin = model.margin(bin_rows([_numbers(rb, x) for x in names], model.cuts))
            yield pa.RecordBatch.from_arrays([rb.column("k"), rb.column("y"), pa.array(1.0 / (1.0 + np.exp(-margin)))],
                                             names=["k", "y", "probability"])
    given = df.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"),
                      *[F.col(f"`{f}`").cast("double").alias(x) for f, x in zip(model.features, names)])
    kind = given.schema["k"].dataType.simpleString()
    out = given.mapInArrow(run, f"k {kind}, y int, probability double")
    return out.select(F.col("k").alias(key), F.col("y").alias(label), "probability",
                      F.when(F.col("probability") >= cutoff, 1).otherwise(0).alias("prediction"))


def save(spark, model: Model, path: str) -> None:
    """The model as a table: one row per tree node, and one (tree -1) per feature with its cuts."""
    rows = [(-1, i, f, None, None, None, None, model.base, [float(c) for c in cuts])
            for i, (f, cuts) in enumerate(zip(model.features, model.cuts))]
    for k, t in enumerate(model.trees):
        rows += [(k, i, None if f < 0 else model.features[f], int(u), bool(m), int(a), int(b), float(v), None)
                 for i, (f, u, m, a, b, v) in enumerate(zip(t.feature, t.upto, t.missing_left, t.left, t.right, t.value))]
    spark.createDataFrame(rows, "tree int, node int, feature string, upto int, missing_left boolean, left int, right int, "
                                "value double, cuts array<double>").coalesce(1).write.parquet(path)


def load(spark, path: str) -> Model:
    rows = sorted(spark.read.parquet(path).collect(), key=lambda r: (r.tree, r.node))
    head = [r for r in rows if r.tree < 0]
    model = Model([r.feature for r in head], [np.array(r.cuts, float) for r in head], head[0].value if head else 0.0)
    at = {f: i for i, f in enumerate(model.features)}
    for k in sorted({r.tree for r in rows if r.tree >= 0}):
        own = [r for r in rows if r.tree == k]
        model.trees.append(Tree(*(np.array(x) for x in zip(*(
            (-1 if r.feature is None else at[r.feature], r.upto, r.missing_left, r.left, r.right, r.value) for r in own)))))
    return model
