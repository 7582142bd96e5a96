"""Training order: permutation, exact round trip of the shards, resumed reads."""

import numpy as np
import pytest
from tokenizers import Tokenizer

from riskweave.llm import trainorder as O
from riskweave.llm.queries import vocabulary


@pytest.mark.parametrize("size", [1, 2, 3, 7, 16, 17, 1000, 4097])
def test_feistel_is_a_permutation(size):
    got = O.feistel(np.arange(size), size, 42)
    assert sorted(got.tolist()) == list(range(size))
    if size > 100:
        assert got.tolist() != O.feistel(np.arange(size), size, 43).tolist()
        assert abs(np.corrcoef(np.arange(size), got.astype(float))[0, 1]) < 0.2


TEXTS = [None, "", "one", "it's a test " * 40, "x" * 900, "été 漢字 " * 60, "same text here", "same text here"]


@pytest.mark.parametrize("parts,shard", [(1, 100), (4, 100), (3, 1 << 25)])
def test_round_trip(spark, parts, shard):
    rows = [(i * 7 - 9, t, 5, "s") for i, t in enumerate(TEXTS)] + [(None, "no id", 5, "s"), (5, "again", 5, "s"), (5, "again", 5, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int, shard string").repartition(parts)
    folder, manifest = O.materialise(docs, vocabulary(), key=9, length=16, shard_bytes=shard)
    got = sorted(manifest.collect(), key=lambda r: r.slot)
    assert [r.slot for r in got] == list(range(len(got)))
    table = sorted((r.shard, r.base, r.records) for r in O.bases(manifest).collect())
    all_ = O.read_slots(folder, table, 0, len(got), length=16)
    assert all_.shape == (len(got), 16)
    tok = Tokenizer.from_file(vocabulary())
    want = {}
    for i, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 16):
            want.setdefault((i, k // 16), []).append(ids[k:k + 16])
    mine = {}
    for r, rec in zip(got, all_.tolist()):
        assert not any(rec[r.length:])
        mine.setdefault((r.doc_id, r.piece), []).append(rec[:r.length])
    assert {k: sorted(v) for k, v in mine.items()} == {k: sorted(v) for k, v in want.items()}
    for cut in (0, 3, len(got) - 1):
        resumed = np.concatenate([O.read_slots(folder, table, 0, cut, length=16), O.read_slots(folder, table, cut, 10**6, length=16)])
        assert (resumed == all_).all()


def test_order_does_not_depend_on_splits(spark):
    rows = [(i, f"text {i} " * (i % 30)) for i in range(60)]
    orders = []
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        m = O.materialise(docs, vocabulary(), length=16, shard_bytes=500)[1]
        orders.append([(r.doc_id, r.piece) for r in sorted(m.collect(), key=lambda r: r.slot)])
    assert orders[0] == orders[1] and orders[0] != sorted(orders[0])


def test_distant_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(-2**63, "a"), (2**63 - 1, "b"), (0, "c")], "doc_id long, text string")
    assert sorted(r.slot for r in O.materialise(docs, vocabulary())[1].collect()) == [0, 1, 2]
    assert O.materialise(spark.createDataFrame([], "doc_id long, text string"), vocabulary())[1].count() == 0
