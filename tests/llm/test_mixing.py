"""Raking against plain iterative proportional fitting; calibration; sampling; edge cases."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from riskweave.llm import mixing as M

SF = "/root/testdata/sf0.001"


def plain_rake(cells, targets, rounds=200):
    total, fit = sum(cells.values()), dict.fromkeys(cells, 0.0) | {k: float(v) for k, v in cells.items()}
    for _ in range(rounds):
        for axis in range(3):
            have = defaultdict(float)
            for k, v in fit.items():
                have[k[axis]] += v
            fit = {k: v * targets[axis][k[axis]] * total / have[k[axis]] for k, v in fit.items()}
    return fit


def test_rake_and_calibration_match_plain_fitting(spark):
    import random
    rng = random.Random(2)
    cells = {(f"=s{i}", f"=l{j}", k): rng.randrange(1, 5000) for i in range(4) for j in range(3) for k in range(3)
             if rng.random() < 0.9}
    rows = [(*k, v) for k, v in cells.items()]
    df = spark.createDataFrame(rows, "__source string, __lang string, __topic int, tokens long")
    p = M.Params(keep=0.7, tolerance=1e-10, rounds=200)
    targets, tables = [], {}
    for axis, c in enumerate(M.CELL):
        share = defaultdict(float)
        for k, v in cells.items():
            share[k[axis]] += v
        w = {x: s ** 0.5 for x, s in share.items()}
        targets.append({x: y / sum(w.values()) for x, y in w.items()})
        tables[c] = M.powered(df, c, 0.5)
    fitted = M.rake(df, tables, p)
    want = plain_rake(cells, targets)
    got = {tuple(r[c] for c in M.CELL): r.fit for r in fitted.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-6) for k in want)
    prob = {tuple(r[c] for c in M.CELL): (r.factor, r.prob) for r in M.calibrated(fitted, p).collect()}
    assert sum(cells[k] * q for k, (_, q) in prob.items()) == pytest.approx(0.7 * sum(cells.values()), rel=1e-6)
    by = {q / f for f, q in prob.values() if q < 1}
    assert max(by) == pytest.approx(min(by)) and all(f * max(by) >= 1 - 1e-9 for f, q in prob.values() if q == 1)


def test_sample_meets_the_probabilities(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = M.op2_mixing(docs).cache()
    assert r.count() == docs.count()
    s = r.agg(F.sum(F.col("n_tokens") * F.col("probability")).alias("e"), F.sum("n_tokens").alias("t"),
              F.sum(F.when(F.col("sampled"), F.col("n_tokens"))).alias("k")).first()
    assert s.e == pytest.approx(0.9 * s.t, rel=1e-3) and s.k == pytest.approx(s.e, rel=0.05)
    words = docs.select("doc_id", F.size(F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")).alias("w"))
    assert r.join(words, "doc_id").where("w <> n_tokens").count() == 0


def test_edge_cases(spark):
    rows = [(1, None, None, None, 1.0), (2, "", "a", "en", 1.0), (3, "some words here", None, "en", 1.0), (None, "longer words", "a", None, 1.0),
            (3, "some words here", None, "en", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, probability double").repartition(2)
    got = M.op2_mixing(docs).collect()
    assert len(got) == 5 and all(r.sampled and r.n_tokens == 0 for r in got if r.doc_id in (1, 2))
    assert len({r.sampled for r in got if r.doc_id == 3}) == 1
    kept = M.mix(docs)
    assert kept.columns == docs.columns
    assert M.op2_mixing(docs.limit(0)).count() == 0
    assert M.op2_mixing(docs.where("text = ''")).count() == 1


def test_decisions_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = ({r.doc_id for r in M.mix(docs.repartition(n)).collect()} for n in (1, 7))
    assert a == b


@pytest.mark.parametrize("collect,tolerance,near", [(1000, 1e-7, 1e-5), (0, 1e-3, 2e-3)])
def test_expected_margins_of_the_sample_meet_the_targets(spark, monkeypatch, collect, tolerance, near):
    """Targets that the tokens allow, with cells that the common multiplier would set to 1."""
    import random
    rng = random.Random(5)
    rows = [(f"=s{i}", f"=l{j}", k, rng.randrange(100, 5000)) for i in range(4) for j in range(3) for k in range(3)]
    monkeypatch.setattr(M, "COLLECT", collect)
    p = M.Params(keep=0.7, tolerance=tolerance, rounds=5000 if collect else 20)
    df = spark.createDataFrame(rows, "__source string, __lang string, __topic int, tokens long")
    goal = {c: M.powered(df, c, 0.5) for c in M.CELL}
    first = M.calibrated(M.rake(df, goal, M.Params(keep=0.7, tolerance=1e-3)), p)
    got = M.solved(df, goal, p)
    off = [max(abs(r.expected / r.target - 1) for r in M.margins(x, goal).collect()) for x in (first, got)]
    assert off[0] > 5e-3 and off[1] < near
    assert got.where("prob > 1 or prob < 0").isEmpty()


def test_arrays_and_tables_give_the_same(spark, monkeypatch):
    """The steps, tolerance and end are the same on both sides of ``COLLECT``, also where a margin cannot be met."""
    rows = [("=a", "=x", 0, 9000), ("=a", "=y", 1, 4000), ("=b", "=x", 1, 300), ("=b", "=y", 0, 20), ("=c", "=x", 0, 5)]
    df = spark.createDataFrame(rows, "__source string, __lang string, __topic int, tokens long")
    goal = {c: M.powered(df, c, 0.5) for c in M.CELL}
    p = M.Params(keep=0.8, tolerance=1e-3, rounds=12, patience=5)
    got = []
    for collect in (5, 4):
        monkeypatch.setattr(M, "COLLECT", collect)
        got.append({tuple(r[c] for c in M.CELL): (r.factor, r.prob) for r in M.solved(df, goal, p).collect()})
    assert got[0].keys() == got[1].keys()
    assert all(got[0][k] == pytest.approx(got[1][k], rel=1e-9) for k in got[0])


def test_own_columns_may_have_the_names_of_helpers(spark):
    docs = spark.createDataFrame([(i, "some words here", "a", "en", 6, True, 0.25) for i in range(5)],
                                 "doc_id long, text string, source string, lang string, __keep int, __prob boolean, c0 double")
    out = M.mix(docs, M.Params(keep=1.0))
    assert out.schema.simpleString() == docs.schema.simpleString()
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))


def test_values_short_of_tokens_keep_all_and_the_rest_stays_in_proportion(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = M.op2_mixing(docs).where("n_tokens > 0").collect()
    total = sum(r.n_tokens for r in rows)
    for col in ("source", "lang", "topic"):
        have, exp = defaultdict(int), defaultdict(float)
        for r in rows:
            have[r[col]] += r.n_tokens
            exp[r[col]] += r.n_tokens * r.probability
        goal = {k: v ** 0.8 for k, v in have.items()}
        short, by = set(), 0.0
        while True:                                              # the plain way: caps, then the others in proportion
            by = (0.9 * total - sum(have[k] for k in short)) / sum(goal[k] for k in goal if k not in short)
            more = {k for k in goal if k not in short and by * goal[k] >= have[k]}
            if not more:
                break
            short |= more
        assert all(exp[k] == pytest.approx(have[k] if k in short else by * goal[k], rel=1e-3) for k in goal), col
