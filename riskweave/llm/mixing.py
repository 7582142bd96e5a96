"""Mixing to target weights: iterative proportional fitting, then calibrated sampling.

A document belongs to a cell (source, language, topic); its weight is its
number of words.  Raking scales the cells' token weights until their sums
over each margin meet the targets.  A cell's factor (fitted weight over its
own tokens) times a common multiplier, at most 1, is the probability with
which each of its documents is kept; the multiplier is solved so that the
expected tokens are the wanted share of all tokens.  Where that sets cells to
1, the margins no longer hold, and the probabilities are raked again under the
bound 1.  A value whose target is more than all its tokens keeps them all, and
the other values of its margin share what is left in proportion to their
targets (``reachable``); ``margins`` lists targets and expected shares, and a
margin that has not come to the tolerance is warned of.  A document is kept if a
hash of its id and text, as a number in [0, 1), is below its probability, so
the sample does not depend on the order or the number of tasks.

Sources may be as many as there are web hosts.  A table of at most ``COLLECT``
cells (some tens of MB) is solved with arrays on the driver, a larger one as
DataFrames, one aggregate per margin and round; the steps, the tolerance and
the end are the same: rounds end when no margin is off by more than the
tolerance, when the largest error has not fallen by a hundredth over
``patience`` rounds, or after ``rounds``.

Topic: the one of ``topics`` classes to which most long words (six bytes or
more) of the text hash; ties take the smaller class, texts without long words
class -1.  Targets: each margin's shares to the power ``alpha``, normalised
(below 1: rare values gain), unless given.

Edge cases: a null source or language is a value of its own; a null or empty
text has no words, weighs nothing and is never sampled away (it is in no
margin); repeated rows share one decision; an empty table gives no rows.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import written
from .text import Words, blocks, utf8

CELL = ["__source", "__lang", "__topic"]
#: Cells up to which the table is solved on the driver (some tens of MB).
COLLECT = 200_000


@dataclass
class Params:
    topics: int = 8
    alpha: dict[str, float] = field(default_factory=lambda: {"source": 0.8, "lang": 0.8, "topic": 0.8})
    keep: float = 0.9          # wanted share of the tokens
    tolerance: float = 1e-6    # largest relative error of a margin
    rounds: int = 5_000
    patience: int = 50
    seed: int = 11


class Rounds:
    """Whether another round of raking is due, from the largest error of each; the same for arrays and tables."""

    def __init__(self, what: str, p: Params):
        self.what, self.p, self.errors = what, p, []

    def done(self, off: float) -> bool:
        self.errors.append(off)
        if off <= self.p.tolerance:
            return True
        n = len(self.errors)
        stuck = n > self.p.patience and min(self.errors) > 0.99 * min(self.errors[:n - self.p.patience])
        if stuck or n >= self.p.rounds:
            warnings.warn(f"{self.what}: a margin is off by {off:.2g} of its target after {n} rounds", stacklevel=3)
            return True
        return False


def measured(docs: DataFrame, p: Params) -> DataFrame:
    """The rows with __source, __lang, __topic, __tokens and __u (the hash of id and text in [0, 1))."""
    cols = docs.columns
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    code = F.xxhash64(F.lit(p.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)
    given = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)], text.alias("text"),
                        (F.shiftrightunsigned(code, 11) / F.lit(float(1 << 53))).alias("u"))
    schema = T.StructType([*[T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(cols)],
                           T.StructField("topic", T.IntegerType()), T.StructField("tokens", T.LongType()),
                           T.StructField("u", T.DoubleType())])

    def run(batches):
        for rb in batches:
            topic, size = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            raw, offs = utf8(rb.column("text"))
            for lo, hi in blocks(offs):
                w = Words(raw, offs[lo:hi + 1])
                long = (w.end - w.start) >= 6
                kind = ((w.hashes()[long] >> np.uint64(40)) % np.uint64(p.topics)).astype(np.int64)
                n = np.bincount(w.doc_of()[long] * p.topics + kind, minlength=w.n_docs * p.topics).reshape(-1, p.topics)
                topic.append(np.where(n.any(axis=1), n.argmax(axis=1), -1).astype(np.int32))
                size.append(w.counts())
            yield pa.RecordBatch.from_arrays(
                [*(rb.column(f"c{i}") for i in range(len(cols))), pa.array(np.concatenate(topic)),
                 pa.array(np.concatenate(size), pa.int64()), rb.column("u")], names=schema.names)
    got = given.mapInArrow(run, schema)
    at = {c: F.col(f"c{i}") for i, c in enumerate(cols)}

    def value(c):
        return F.when(at[c].isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), at[c].cast("string")))
    return got.select(*[at[c].alias(c) for c in cols], value("source").alias("__source"), value("lang").alias("__lang"),
                      F.col("topic").alias("__topic"), F.col("tokens").alias("__tokens"), F.col("u").alias("__u"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], p: Params) -> DataFrame:
    """Cells with the column ``fit``: token weights whose margins meet ``targets`` (value, share).

    cells: the three cell columns and ``tokens`` (above 0).  Every round scales
    all margins in turn; rounds end when no margin was off by more than the
    tolerance.  Cells of a value without a target keep none of the weight.
    """
    total = cells.agg(F.sum("tokens")).first()[0]
    now = written(cells.withColumn("fit", F.col("tokens").cast("double")), "rake")
    rounds, off = Rounds("rake", p), None
    while off is None or not rounds.done(off):
        step = now.select(*CELL, "tokens", "fit", F.lit(0.0).alias("off"))
        for c in CELL:
            want = targets[c].select(F.col("value").alias(c), (F.col("share") * F.lit(float(total))).alias("want"))
            have = step.groupBy(c).agg(F.sum("fit").alias("have")).join(want, c, "left").select(
                c, F.when(F.col("have") > 0, F.coalesce("want", F.lit(0.0)) / F.col("have")).otherwise(0.0).alias("by"))
            step = step.join(have, c).select(*CELL, "tokens", (F.col("fit") * F.col("by")).alias("fit"),
                                             F.greatest("off", F.abs(F.col("by") - 1)).alias("off"))
        now = written(step, "rake")
        off = now.agg(F.max("off")).first()[0] or 0.0
    return now.select(*CELL, "tokens", "fit")


def powered(cells: DataFrame, c: str, alpha: float) -> DataFrame:
    """Target shares of a margin: its shares to the power alpha, normalised."""
    m = cells.groupBy(F.col(c).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(alpha)).alias("w"))
    total = m.agg(F.sum("w")).first()[0] or 1.0
    return m.select("value", (F.col("w") / F.lit(total)).alias("share"))


def multiplier(f: DataFrame, p: Params) -> float:
    """The multiplier of ``factor`` at which the tokens times min(1, multiplier * factor) are the wanted share.

    It starts at the wanted tokens over all tokens and is raised for what the
    rows at 1 cannot give, until none is added (each step sets at least one
    more row to 1; a step is one aggregate).
    """
    total = f.agg(F.sum("tokens")).first()[0] or 0
    wanted, by = p.keep * total, p.keep
    while True:
        at_one = (F.col("factor") * F.lit(by)) >= 1
        full, rest = f.agg(F.sum(F.when(at_one, F.col("tokens")).otherwise(0.0)),
                           F.sum(F.when(~at_one, F.col("tokens") * F.col("factor")).otherwise(0.0))).first()
        new = (wanted - (full or 0.0)) / rest if rest else by
        if new <= by * (1 + 1e-9):
            return by
        by = new


def calibrated(fitted: DataFrame, p: Params) -> DataFrame:
    """Cells with ``factor`` (fit over tokens) and the probability ``prob`` = min(1, multiplier * factor)."""
    f = written(fitted.select(*CELL, "tokens", (F.col("fit") / F.col("tokens")).alias("factor")), "factors")
    return f.withColumn("prob", F.least(F.lit(1.0), F.col("factor") * F.lit(multiplier(f, p))))


def reachable(cells: DataFrame, c: str, target: DataFrame, p: Params) -> DataFrame:
    """(c, want): the tokens that each value of a margin shall have in the sample, at most all that it has.

    Without values that are short of tokens these are the targets; else the
    others share the rest in proportion to their targets.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0])
    have = cells.groupBy(c).agg(F.sum("tokens").alias("tokens"))
    f = written(have.join(target.withColumnRenamed("value", c), c, "left").select(
        c, "tokens", (F.coalesce("share", F.lit(0.0)) * total / F.col("tokens")).alias("factor")), "reach")
    return written(f.select(c, (F.col("tokens") * F.least(F.lit(1.0), F.col("factor") * F.lit(multiplier(f, p))))
                            .alias("want")), "wants")


def bounded(cells: DataFrame, targets: dict[str, DataFrame], p: Params) -> DataFrame:
    """Cells from ``calibrated`` with ``prob`` raked under the bound 1 to the reachable tokens of all margins.

    A margin below its target is raised by its cells that are not at 1, one
    above it is lowered as a whole; rounds end as in ``rake``.
    """
    cells = written(cells, "cells")
    if cells.where("prob >= 1").isEmpty():
        return cells
    want = {c: reachable(cells, c, targets[c], p) for c in CELL}
    now = cells
    rounds, off_all = Rounds("bounded", p), None
    while off_all is None or not rounds.done(off_all):
        step = now.select(*CELL, "tokens", "factor", "prob", F.lit(0.0).alias("off"))
        for c in CELL:
            have = step.groupBy(c).agg(
                F.sum(F.col("tokens") * F.col("prob")).alias("have"),
                F.sum(F.when(F.col("prob") >= 1, F.col("tokens")).otherwise(0)).alias("full")).join(want[c], c)
            by = (F.when(F.col("have") <= 0, 1.0).when(F.col("want") <= F.col("have"), F.col("want") / F.col("have"))
                  .when(F.col("have") > F.col("full"), (F.col("want") - F.col("full")) / (F.col("have") - F.col("full")))
                  .otherwise(1.0))
            off = F.when(F.col("have") > 0, F.abs(F.col("want") / F.col("have") - 1)).otherwise(0.0)
            step = step.join(have.select(c, by.alias("by"), off.alias("here")), c).select(
                *CELL, "tokens", "factor", F.least(F.lit(1.0), F.col("prob") * F.col("by")).alias("prob"),
                F.greatest("off", "here").alias("off"))
        now = written(step, "bounded")
        off_all = now.agg(F.max("off")).first()[0] or 0.0
    return now.select(*CELL, "tokens", "factor", "prob")


# ---------------------------------------------------------------- the same steps on arrays
def solved_here(cells: DataFrame, targets: dict[str, DataFrame], p: Params) -> DataFrame:
    """``rake``, ``calibrated`` and ``bounded`` of a small cell table, on the driver."""
    rows = cells.select(*CELL, "tokens").collect()
    tokens = np.array([r["tokens"] for r in rows], np.float64)
    total = float(tokens.sum())
    sides = []
    for c in CELL:
        share = {r["value"]: r["share"] for r in targets[c].collect()}
        values = sorted({r[c] for r in rows}, key=str)
        at = {v: i for i, v in enumerate(values)}
        sides.append((np.array([at[r[c]] for r in rows]), np.array([share.get(v) or 0.0 for v in values]) * total))
    fit, rounds, off = tokens.copy(), Rounds("rake", p), None
    while off is None or not rounds.done(off):
        off = 0.0
        for at, want in sides:
            have = np.bincount(at, fit, len(want))
            by = np.where(have > 0, want / np.where(have > 0, have, 1.0), 0.0)
            off = max(off, float(np.abs(by - 1).max()))
            fit = fit * by[at]
    factor = fit / tokens
    prob = np.minimum(1.0, factor * _multiplier_here(tokens, factor, p))
    if (prob >= 1).any():
        goals = []
        for at, want in sides:
            have = np.bincount(at, tokens, len(want))
            f = want / have
            goals.append((at, have * np.minimum(1.0, f * _multiplier_here(have, f, p))))
        prob = _bounded_here(tokens, prob, goals, p)
    out = [(*[r[c] for c in CELL], r["tokens"], float(f), float(x)) for r, f, x in zip(rows, factor, prob)]
    schema = T.StructType([*cells.select(*CELL, "tokens").schema.fields, T.StructField("factor", T.DoubleType()),
                           T.StructField("prob", T.DoubleType())])
    return cells.sparkSession.createDataFrame(out, schema)


def _multiplier_here(tokens: np.ndarray, factor: np.ndarray, p: Params) -> float:
    wanted, by = p.keep * tokens.sum(), p.keep
    while True:
        at_one = factor * by >= 1
        rest = float((tokens * factor)[~at_one].sum())
        new = (wanted - tokens[at_one].sum()) / rest if rest else by
        if new <= by * (1 + 1e-9):
            return float(by)
        by = new


def _bounded_here(tokens: np.ndarray, prob: np.ndarray, sides: list, p: Params) -> np.ndarray:
    rounds, off = Rounds("bounded", p), None
    while off is None or not rounds.done(off):
        off = 0.0
        for at, goal in sides:
            have = np.bincount(at, tokens * prob, len(goal))
            full = np.bincount(at, tokens * (prob >= 1), len(goal))
            some = np.where(have > 0, have, 1.0)
            by = np.where(goal <= have, goal / some,
                          np.where(have > full, (goal - full) / np.where(have > full, have - full, 1.0), 1.0))
            by = np.where(have > 0, by, 1.0)
            off = max(off, float(np.where(have > 0, np.abs(goal / some - 1), 0.0).max()))
            prob = np.minimum(1.0, prob * by[at])
    return prob


def solved(cells: DataFrame, targets: dict[str, DataFrame], p: Params) -> DataFrame:
    """Cells with ``factor`` and ``prob``."""
    if cells.count() <= COLLECT:
        return solved_here(cells, targets, p)
    return bounded(calibrated(rake(cells, targets, p), p), targets, p)


def margins(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """margin, value, target, expected: shares of the sample's tokens; cells: with ``tokens`` and ``prob``."""
    total = cells.agg(F.sum(F.col("tokens") * F.col("prob"))).first()[0] or 1.0
    out = None
    for c in CELL:
        have = cells.groupBy(F.col(c).alias("value")).agg((F.sum(F.col("tokens") * F.col("prob")) / F.lit(total)).alias("expected"))
        one = have.join(targets[c], "value", "left").select(
            F.lit(c[2:]).alias("margin"), F.col("value").cast("string").alias("value"),
            F.coalesce("share", F.lit(0.0)).alias("target"), "expected")
        out = one if out is None else out.union(one)
    return out


def decided(docs: DataFrame, params: Params | None = None, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rows with __source, __lang, __topic, __tokens, __factor, __prob and __keep."""
    p = params or Params()
    rows = measured(docs, p)
    slim = measured(docs.select("doc_id", "text", "source", "lang"), p)
    cells = written(slim.where("__tokens > 0").groupBy(*CELL).agg(F.sum("__tokens").alias("tokens")), "cells")
    names = dict(zip(CELL, ("source", "lang", "topic")))
    goal = {c: written(powered(cells, c, p.alpha[names[c]]), "targets") for c in CELL} | (targets or {})
    if cells.isEmpty():
        probs = cells.select(*CELL, F.lit(1.0).alias("__factor"), F.lit(1.0).alias("__prob"))
    else:
        probs = written(solved(cells, goal, p).select(
            *CELL, F.col("factor").alias("__factor"), F.col("prob").alias("__prob")), "probs")
    out = rows.join(probs, CELL, "left")
    empty = F.col("__tokens") == 0
    return out.withColumn("__keep", empty | (F.col("__u") < F.col("__prob")))


def op2_mixing(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """doc_id, topic, n_tokens, factor, probability, sampled for every row."""
    d = decided(docs.select("doc_id", "text", "source", "lang"), params)
    return d.select("doc_id", "source", "lang", F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"),
                    F.col("__factor").alias("factor"), F.coalesce("__prob", F.lit(1.0)).alias("probability"),
                    F.col("__keep").alias("sampled"))


def mix(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """The sampled documents, with their own columns (taken by position, so they may have any names)."""
    read = ("doc_id", "text", "source", "lang")
    held = docs.toDF(*[c if c in read else f"own{i}" for i, c in enumerate(docs.columns)])
    return decided(held, params).where("__keep").select(*held.columns).toDF(*docs.columns)
