"""First-fit decreasing in groups: tree, gaps, ids, every id once, no padding, edge cases."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from riskweave.llm import ffd
from riskweave.llm.queries import vocabulary

VOCABULARY = vocabulary("word_bpe_49k.json")


@pytest.mark.parametrize("seed", range(5))
def test_tree_gives_the_first_bin_with_room(seed):
    rng = random.Random(seed)
    for _ in range(40):
        cap = rng.choice([7, 20, 64])
        sizes = [rng.randint(1, cap) for _ in range(rng.randint(0, 60))]
        bins, rooms = [], []
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            at = next((k for k, r in enumerate(rooms) if r >= sizes[i]), len(rooms))
            if at == len(rooms):
                bins.append([])
                rooms.append(cap)
            bins[at].append(i)
            rooms[at] -= sizes[i]
        assert ffd.first_fit_decreasing(sizes, cap) == bins


@pytest.mark.parametrize("seed", range(5))
def test_gaps_are_filled_and_the_last_is_cut_at_powers_of_two(seed):
    rng = random.Random(seed)
    for _ in range(60):
        cap = rng.choice([8, 50, 2048])
        sizes = [rng.randint(1, cap) for _ in range(rng.randint(0, 50))]
        bins = [[(i, 0, sizes[i]) for i in b] for b in ffd.first_fit_decreasing(sizes, cap)]
        out = ffd.fill_gaps([list(b) for b in bins], cap)
        lengths = [sum(p[2] for p in s) for s in out]
        assert all(n == cap or n & (n - 1) == 0 for n in lengths) and sum(lengths) == sum(sizes)
        assert len([n for n in lengths if n == cap]) >= sum(sizes) // cap
        cover = defaultdict(list)
        for s in out:
            for item, start, size in s:
                assert size > 0
                cover[item].append((start, start + size))
        for i, n in enumerate(sizes):
            ends = sorted(cover[i])
            assert ends[0][0] == 0 and ends[-1][1] == n and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
        assert sum(len(s) for s in out) <= len(sizes) + len(bins) + 12   # about one cut a gap


TEXTS = [None, "", "short", "it's we'll don't''s  x\n\n y \t z", "Word " * 3000, "漢字 ÉTÉ ١٢٣ ² é ̈́ ", "same", "same",
         "<|endoftext|> a", "a b c　d\x0b\x0ce\x1cf\x85g", "ΣΑΣ İstanbul ǅ ﬃ", " ́x ̸", "\r\n\tq\r", "x" * 9000]


def test_ids_equal_those_of_whole_texts(monkeypatch):
    tok = Tokenizer.from_file(VOCABULARY)
    tok.encode_special_tokens = True
    coder = ffd.Coder(VOCABULARY)
    assert coder.by_word
    rng = random.Random(2)
    odd = "aZé'ſKΣİ̸́Kẞﬃ \t\n\r\x0b\x0c\x1c\x1f\x85\xa0  ‍﻿漢9٣!?-<|>\U0001f600"
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(odd) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    monkeypatch.setattr(ffd, "PART_CHARS", 50)
    for t in texts:
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_a_vocabulary_whose_pieces_hold_blanks_is_encoded_whole():
    path = vocabulary("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    coder = ffd.Coder(path)
    assert not coder.by_word
    assert np.frombuffer(coder.encode("two  words"), "<u4").tolist() == tok.encode("two  words", add_special_tokens=False).ids


def check(docs, packed, capacity):
    tok = Tokenizer.from_file(VOCABULARY)
    tok.encode_special_tokens = True
    want = defaultdict(list)
    for i, t in docs:
        want[i].append([*tok.encode(t or "", add_special_tokens=False).ids, ffd.END_ID])
    places, got = defaultdict(list), defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
        got[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for runs in places.values():
        runs.sort()
        assert runs[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(runs, runs[1:]))
        total = sum(n for _, n in runs)
        assert total == capacity or total & (total - 1) == 0 and total < capacity
    for i, all_ids in want.items():
        crc = {(s, n): zlib.crc32(np.asarray(ids[s:s + n], "<u4").tobytes()) for ids in all_ids
               for s, n in {(g[0], g[1]) for g in got[i]} if s + n <= len(ids)}
        assert sum(g[1] for g in got[i]) == sum(map(len, all_ids))
        if len(all_ids) == 1:
            ends = sorted((s, s + n) for s, n, _, _ in got[i])
            assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
            assert all(g[2] == crc[g[0], g[1]] and g[3] == len(all_ids[0]) for g in got[i])
    assert set(got) == set(want)
    return len(places)


def test_packing_of_documents(spark):
    docs = list(enumerate(TEXTS)) + [(100 + i, "a few more words of text " * (i % 23)) for i in range(200)]
    docs += [(None, "no id"), (7, TEXTS[7])]
    df = spark.createDataFrame([(*d, "x", 2) for d in docs], "doc_id long, text string, start string, ids int").repartition(6)
    for capacity, rows in ((2048, 4096), (64, 40)):
        packed = ffd.pack(df, VOCABULARY, capacity, group_rows=rows)
        check(docs, packed.selectExpr("*", "crc32(ids) as ids_crc32").collect(), capacity)
        assert ffd.padding(packed, capacity).first().padded == 0
    thin = ffd.op13_ffd_packing(df, VOCABULARY)
    assert thin.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_groups_stay_small_when_rows_are_equal(spark):
    """A third of the rows without an id and with the same text are dealt to all groups."""
    df = spark.sql("SELECT cast(null AS long) AS doc_id, 'same text here' AS text FROM range(3000)")
    cut = ffd.cut_documents(df, VOCABULARY, 2048, 1, 13)
    sizes = [r["count"] for r in cut.selectExpr("pmod(draw, 10) AS g").groupBy("g").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 400


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ffd.op13_ffd_packing(none, VOCABULARY).count() == 0
    assert ffd.padding(ffd.pack(none, VOCABULARY)).first().sequences == 0
