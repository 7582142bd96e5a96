"""Packing: optimality on small instances, ids, gapless sequences, edge cases."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from riskweave.llm import bpe, packing
from riskweave.llm.queries import vocabulary
from riskweave.llm.text import blocks, utf8


def optimal(items, cap):
    items = sorted(items, reverse=True)
    best = [len(items)]

    def rec(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        seen = set()
        for j, free in enumerate(bins):
            if free >= items[i] and free not in seen:
                seen.add(free)
                bins[j] -= items[i]
                rec(i + 1, bins)
                bins[j] += items[i]
        rec(i + 1, bins + [cap - items[i]])
    rec(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_optimal_on_small_instances(seed):
    rng = random.Random(seed)
    for _ in range(80):
        cap = rng.choice([10, 20, 50, 100])
        items = [rng.randint(max(1, cap // rng.choice([20, 8, 5])), cap * rng.choice([5, 7, 10]) // 10)
                 for _ in range(rng.randint(0, 12))]
        hist = Counter(items)
        bins = packing.plan(hist, cap)
        assert sum((Counter({s: c * n for s, c in Counter(x).items()}) for x, n in bins), Counter()) == hist
        assert all(sum(x) <= cap for x, _ in bins)
        n = sum(c for _, c in bins)
        assert packing.lower_bound(hist, cap) <= n == optimal(items, cap)


def test_search_beats_best_fit():
    hist = Counter([44, 24, 24, 22, 21, 17, 8, 8, 6, 6])
    assert sum(c for _, c in packing.best_fit(hist, 60)) == 4
    assert sum(c for _, c in packing.plan(hist, 60)) == 3


TEXTS = [None, "", "short", "it's we'll don't''s  x\n\n y \t z", "word " * 700, "漢字 été ١٢٣ ² " * 90, "same", "same", "<|endoftext|> a"]


def test_ids_equal_the_tokenizers_library():
    rng = random.Random(1)
    letters = " \n\t'\"stmdrevl aZé1२!?.　 😀漢字\r\x00-͸"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(4000)] + [t or "" for t in TEXTS]
    import pyarrow as pa
    raw, offs = utf8(pa.array(texts))
    coder, got = bpe.load(vocabulary()), []
    for lo, hi in blocks(offs, 3000):
        o = offs[lo:hi + 1]
        ids, ptr = coder.encode(raw[o[0]:o[-1]].tobytes(), o - o[0])
        got += [ids[ptr[i]:ptr[i + 1]].tolist() for i in range(hi - lo)]
    tok = Tokenizer.from_file(vocabulary())
    tok.encode_special_tokens = True
    assert got == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("parts,cap", [(1, 64), (4, 64), (3, 2048)])
def test_pack(spark, parts, cap):
    rows = [(i, t, 1, 2) for i, t in enumerate(TEXTS)] + [(None, "no id", 1, 2), (2, "short", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, sequence_id int").repartition(parts)
    packed = packing.pack(docs, vocabulary(), cap).cache()
    tok = Tokenizer.from_file(vocabulary())
    tok.encode_special_tokens = True
    want = Counter()
    for i, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        cuts = [0] if len(ids) <= cap else ([0] if len(ids) % cap else []) + list(range(len(ids) % cap, len(ids), cap))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:] + [len(ids)])):
            want[(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    got = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
        assert sum(n for _, n in places) <= cap
    assert len(by) == sum(c for _, c in packing.plan(Counter(r.length for r in got), cap))


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    packed = packing.pack(docs, vocabulary(), 64).cache()
    ids = {r.sequence_id: r.ids for r in packing.sequences(docs, packed, vocabulary()).collect()}
    for r in packed.collect():
        assert zlib.crc32(np.array(ids[r.sequence_id][r.offset:r.offset + r.length], "<u4").tobytes()) == r.ids_crc32


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), vocabulary()).count() == 0
