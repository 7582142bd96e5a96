"""SMOTE neighbour search against brute force, including cells with <= k rows."""

import math
import random

from riskweave import config as C
from riskweave.operators import balance as B


def _rows(seed=3):
    rng = random.Random(seed)
    rows = []
    layout = {"CARD_WEB": 1, "DEBIT": 2, "TRANSFER": 40, "CASH_OUT": 25}
    i = 0
    for ch, n in layout.items():
        for _ in range(n):
            feats = {f: 0.0 for f in C.FEATURES}
            feats["amount"] = round(rng.random(), 3)
            feats[f"channel_{ch}"] = 1.0
            feats["source_dataset_PaySim"] = 1.0
            rows.append((f"k{i:03d}", *[feats[f] for f in C.FEATURES]))
            i += 1
    return rows


def _brute(rows, k):
    out = {}
    for a in rows:
        cand = []
        for b in rows:
            if a[0] == b[0]:
                continue
            d = math.sqrt(sum((x - y) * (x - y) for x, y in zip(a[1:], b[1:])))
            if d > 0:
                cand.append((d, b[0]))
        out[a[0]] = [key for _, key in sorted(cand)[:k]]
    return out


def test_neighbours_match_brute_force(spark):
    rows = _rows()
    schema = "transaction_id string, " + ", ".join(f"`{f}` double" for f in C.FEATURES)
    df = spark.createDataFrame(rows, schema)
    got = {}
    for r in B.smote_neighbours(df, 2).collect():
        got.setdefault(r.transaction_id, []).append((r.nbr_rank, r.nbr_key))
    got = {k: [n for _, n in sorted(v)] for k, v in got.items()}
    assert got == _brute(rows, 2)
    # The single-row cell found neighbours in other cells.
    assert len(got["k000"]) == 2


def test_single_minority_row_jitters(spark):
    rows = _rows()[:4]
    schema = "transaction_id string, " + ", ".join(f"`{f}` double" for f in C.FEATURES) + ", is_fraud int"
    df = spark.createDataFrame([r + ((1 if i == 0 else 0),) for i, r in enumerate(rows)], schema)
    syn = B.smote_rows(df).collect()
    assert len(syn) == 2
    base = rows[0]
    for r in syn:
        assert all(abs(r[f] - v) <= 0.01 + 1e-12 for f, v in zip(C.FEATURES, base[1:]))


def test_synthetic_points_on_segments(spark):
    rows = _rows()
    schema = "transaction_id string, " + ", ".join(f"`{f}` double" for f in C.FEATURES) + ", is_fraud int"
    # Minority = the given rows; add enough majority rows to need synthetic ones.
    major = [(f"m{i:03d}", *([0.5] + [0.0] * (len(C.FEATURES) - 1))) for i in range(150)]
    df = spark.createDataFrame([r + (1,) for r in rows] + [r + (0,) for r in major], schema)
    syn = B.smote_rows(df).collect()
    assert len(syn) == 150 - len(rows)
    by_key = {r[0]: r for r in rows}
    nbrs = _brute(rows, 2)
    for s in syn:
        src = s.transaction_id[len("SYN_"):].rsplit("_", 1)[0]
        base = by_key[src]
        ok = False
        for n in nbrs[src]:
            other = by_key[n]
            # s = base + r * (other - base) for one r in [0, 1], on every feature.
            rs = {round((s[f] - b) / (o - b), 9) for f, b, o in zip(C.FEATURES, base[1:], other[1:])
                  if o != b}
            same = all(abs(s[f] - b) < 1e-12 for f, b, o in zip(C.FEATURES, base[1:], other[1:]) if o == b)
            if same and len(rs) == 1 and 0.0 <= next(iter(rs)) <= 1.0:
                ok = True
        assert ok, s.transaction_id


def _neighbours(spark, rows, k):
    schema = "transaction_id string, " + ", ".join(f"`{f}` double" for f in C.FEATURES)
    got = {}
    for r in B.smote_neighbours(spark.createDataFrame(rows, schema), k).collect():
        got.setdefault(r.transaction_id, []).append((r.nbr_rank, r.nbr_key))
    return {key: [n for _, n in sorted(v)] for key, v in got.items()}


def _make(spec):
    rows = []
    for i, (ch, amount) in enumerate(spec):
        feats = {f: 0.0 for f in C.FEATURES} | {"amount": float(amount), f"channel_{ch}": 1.0}
        rows.append((f"k{i:03d}", *[feats[f] for f in C.FEATURES]))
    return rows


def test_repeated_points_and_one_value_cells(spark):
    # five equal rows in one cell: their neighbours are in the other cells
    rows = _make([("DEBIT", 0.5)] * 5 + [("TRANSFER", x / 10) for x in range(6)] + [("CASH_OUT", 0.5)] * 3)
    for k in (1, 2, 3):
        assert _neighbours(spark, rows, k) == {a: n for a, n in _brute(rows, k).items() if n}


def test_unscaled_amounts_cross_cells(spark):
    rng = random.Random(9)
    rows = _make([(rng.choice(["DEBIT", "TRANSFER", "CASH_OUT", "CARD_WEB"]), rng.choice([rng.randrange(5000), rng.randrange(40)]))
                  for _ in range(90)])
    assert _neighbours(spark, rows, 2) == _brute(rows, 2)


def test_blocks_of_ranks_do_not_part_neighbours(spark, monkeypatch):
    """Points on either side of a block's end find each other; ranks run on over range partitions."""
    monkeypatch.setattr(C, "TUNABLES", C.Tunables(neighbour_block=4))
    rng = random.Random(21)
    rows = _make([(rng.choice(["DEBIT", "TRANSFER"]), rng.choice([rng.random(), 0.25])) for _ in range(60)])
    for k in (1, 2, 5):
        assert _neighbours(spark, rows, k) == _brute(rows, k)


def test_large_tables_are_written_as_columns_and_spread(spark):
    """Ranks and synthetic rows come from Parquet files; few minority rows do not make a single task's output."""
    rows = _rows()
    schema = "transaction_id string, " + ", ".join(f"`{f}` double" for f in C.FEATURES) + ", is_fraud int"
    df = spark.createDataFrame([r + (1,) for r in rows] + [(f"m{i}", *r[1:], 0) for i in range(5) for r in rows], schema)
    ranked = B.ranked_minority(df.where("is_fraud = 1"))
    assert ranked.inputFiles()
    want = sorted((r[0], i) for c in {r[2:] for r in rows}
                  for i, r in enumerate(sorted([r for r in rows if r[2:] == c], key=lambda r: (r[1], r[0]))))
    assert sorted((r.transaction_id, r.rk) for r in ranked.collect()) == want
    assert B.smote_rows(df).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
