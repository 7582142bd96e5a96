"""Importance resampling: spans, weights, draw and ranks against a plain version; edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from riskweave.llm import resampling

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TABLE = {c: c + 32 for c in range(65, 91)}


def plain_features(text, n=2):
    w = WORDS.findall((text or "").translate(TABLE))
    return w, [" ".join(w[i:i + k]) for i in range(len(w)) for k in range(1, n + 1) if i + k <= len(w)]


def plain(docs, target, buckets=10_000, percent=25, least=20, n=2):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    found = [plain_features(t, n) for _, t in docs]
    s = Counter(bucket(g) for _, f in found for g in f)
    t = Counter(bucket(g) for x in target for g in plain_features(x, n)[1])
    a, b = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    gain = lambda k: math.floor(1000 * math.log(float(t[k] + 1) * a / (float(s[k] + 1) * b)))
    rows = []
    for (i, _), (w, f) in zip(docs, found):
        weight = sum(gain(bucket(g)) for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(f), weight, score, len(w) >= least, None])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:len(able) * percent // 100], 1):
        r[5] = k
    return sorted(((r[0], r[1], r[2], r[3], r[5]) for r in rows), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_spans_are_all_runs_of_words(n):
    pattern = resampling.grams(n)
    for text in ("", " ", "a", "Ab--cd  ef", "x " * 50, "été, ١٢٣ 漢字! a-b_c'd", "9z\x00\x7fq\n\nZ", "w" * 5000 + " v"):
        raw = resampling.normal(text.encode())
        got = Counter(raw[s].decode() for s in resampling.spans(raw, pattern))
        words, want = plain_features(text, n)
        assert got == Counter(want)
        assert resampling.hashed(text.encode(), pattern, 97)[0] == len(words)


TARGET = ["the quick brown fox", "jumps over the lazy dog " * 3, None, ""]


def make(n=300):
    vocab = "the quick brown fox jumps over lazy dog alpha beta gamma delta Été über 42".split()
    docs = [(i, " ".join(vocab[(i * 7 + j * j * (1 + i % 5)) % len(vocab)] for j in range(3 + i % 60))) for i in range(n)]
    return docs + [(n, None), (n + 1, ""), (n + 2, "--- ..."), (None, "the quick brown fox " * 8), (5, docs[5][1]),
                   (n + 3, "the lazy " * 30_000)]


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_equals_plain_version(spark):
    docs = make()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, rank string, score int").repartition(7)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    assert rows(resampling.resample(df, target)) == plain(docs, TARGET)
    small = resampling.resample(df, target, n=3, buckets=50, percent=60, min_words=1)
    assert rows(small) == plain(docs, TARGET, 50, 60, 1, 3)


def test_many_rows_of_one_id_and_ties(spark):
    docs = [(None, "the quick brown fox " * 6)] * 200 + [(1, "alpha beta " * 12)] * 50
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    target = spark.createDataFrame([("the fox",)], "text string")
    assert rows(resampling.resample(df, target)) == plain(docs, ["the fox"])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 20), (2, "c d " * 20), (3, "e f " * 20), (4, "g " * 30)], none.schema)
    assert resampling.resample(none, some.select("text")).count() == 0
    assert rows(resampling.resample(some, none.select("text"))) == plain([tuple(r) for r in some.collect()], [])


def test_ranks_run_over_partitions(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "25L as n_words", "1L as n_features", "0L as weight", "id % 7 as score",
                                      "id as tie")
    got = {r.doc_id: r["rank"] for r in resampling.ranked(df, 50).collect()}
    order = sorted(got, key=lambda i: (-(i % 7), i))
    assert [got[i] for i in order] == list(range(1, 2501)) + [None] * 2500
