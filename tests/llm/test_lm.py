"""Kneser-Ney scores against a plain dictionary implementation."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from riskweave.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = ["The cat sat on the mat", "the cat sat on the hat.\nthe END", "", None, "THE the the The", "É un étang, É un",
         "a b a b a b c", "the cat", "x" * 3000 + " the cat " * 500, "one two three four five one two three six", " \t\n ",
         "the cat sat", "the cat sat"]


def words(text):
    return WORD.findall((text or "").translate(LOWER)) + ["</s>"]


def brute(rows, order, test):
    train = [words(t) for t in rows]
    raw = Counter(w for t in train for w in t)
    n, v = sum(raw.values()), len(raw)
    counts = {order: Counter(tuple(([None] * (order - 1) + t)[i:i + order]) for t in train for i in range(len(t)))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    disc, ctx = {}, {}
    for k, c in counts.items():
        cc = Counter(c.values())
        disc[k] = lm.discounts(*(cc[i] for i in range(1, 5)))
        ctx[k] = defaultdict(lambda: [0, 0, 0, 0])
        for g, x in c.items():
            s = ctx[k][g[:-1]]
            s[0] += x
            s[min(x, 3)] += 1

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / (v + 1)
        low = p(gram[1:])
        s = ctx[k].get(gram[:-1])
        if s is None:
            return low
        x = counts[k].get(gram, 0)
        d = (0, *disc[k])
        return (x - d[min(x, 3)]) / s[0] + sum(d[i] * s[i] for i in (1, 2, 3)) / s[0] * low
    out = []
    for t in test:
        w = words(t)
        pad = [None] * (order - 1) + w
        score = sum(math.log10(p(tuple(pad[i:i + order]))) for i in range(len(w)))
        base = sum(math.log10((raw[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        out.append((len(w), sum(raw[x] > 0 for x in w), n, base, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("shard", [200, 1 << 30])
def test_scores_match_dictionaries(spark, order, shard, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_BYTES", shard)
    rows = [(i, t, "x", i) for i, t in enumerate(TEXTS * 2)] + [(None, "the cat", "x", 1), (3, "the cat", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, held_out long").repartition(3)
    got = lm.op1_lm_scoring(docs, order).collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    want = brute([t for i, t, *_ in rows if not held(i)], order, [t for _, t, *_ in rows])
    key = lambda i, r: (-1 if i is None else i, held(i), *r[:3], round(r[3], 6), round(r[4], 3))
    a = sorted(key(r.doc_id, (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)) for r in got)
    b = sorted(key(i, w) for (i, *_), w in zip(rows, want))
    assert a == b
    assert all(r.held_out == held(r.doc_id) for r in got)


def test_probabilities_sum_to_one(spark):
    """Over all words, and the share of one unseen word, for a seen context."""
    docs = spark.createDataFrame([(t,) for t in TEXTS if t], "text string")
    m = lm.fit(docs, 2)
    import numpy as np

    from riskweave.llm.text import utf8
    import pyarrow as pa
    vocab = sorted({w for t in TEXTS if t for w in words(t)} - {"</s>"})
    raw, offs = utf8(pa.array(["the " + w for w in vocab] + ["the", "the neverseen"]))
    tok, ptr = lm.tokens(raw, offs)
    p = lm.probabilities(m, tok, ptr)
    second = p[ptr[:-1] + 1]
    assert np.isclose(second.sum(), 1.0)


def test_empty_training_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm.op1_lm_scoring(none).count() == 0
    m = lm.fit(none)
    r = lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), m).first()
    assert (r.n_tokens, r.n_known, r.base_score, r.score) == (3, 0, 0.0, 0.0)


def test_registered_query_uses_three_words(spark):
    from riskweave.llm import queries
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in queries.read(spark, sf, "documents").collect()]
    got = {r.doc_id: r for r in queries.QUERIES["op1_lm_scoring"](spark, sf).collect()}
    test = rows[:40]
    want = brute([t for i, t in rows if not got[i].held_out], 3, [t for _, t in test])
    assert all(got[i].score == pytest.approx(w[4], rel=1e-6) for (i, _), w in zip(test, want))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_a_shard_answers_all_batches_from_one_walk_over_its_files(spark, order, monkeypatch, scratch):
    """Time at size: every batch of texts used to look into the files of every shard."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.types import LongType, StringType, StructField, StructType
    monkeypatch.setattr(lm, "SHARD_BYTES", 400)
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)]
    m = lm.fit(spark.createDataFrame(rows[5:], schema), order)
    given = pa.record_batch([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])
    stored = list(lm._stored(scratch, 300)(iter([given])))
    assert len(stored) > 3 and m.bits > 2
    asked = [rb for levels in ([lm.RAW, 1], *([x] for x in range(2, order + 1)))
             for rb in lm._asked(scratch, m, levels)(iter(stored))]
    asked = pa.Table.from_batches(asked)
    opened, mapped = [], lm._mapped
    monkeypatch.setattr(lm, "_mapped", lambda uri, name: opened.append(name) or mapped(uri, name))
    answers = []
    for level, shard in sorted(set(zip(asked.column("level").to_pylist(), asked.column("shard").to_pylist()))):
        mine = np.array([x == (level, shard) for x in zip(asked.column("level").to_pylist(), asked.column("shard").to_pylist())])
        answers.append(lm._answered(m)((pa.scalar(level), pa.scalar(shard)), asked.filter(pa.array(mine))))
    assert len(opened) == len(set(opened))
    answers, got = pa.concat_tables(answers), {}
    for name in (x for rb in stored for x in rb.column("batch").to_pylist()):
        mine = answers.filter(pa.compute.equal(answers.column("batch"), name))
        scored = lm._combined(scratch, m, ["doc_id", "n", "known", "base", "score"])((pa.scalar(name),), mine)
        got.update({r["doc_id"]: r for r in scored.to_pylist()})
    from riskweave.llm.text import utf8
    direct = list(zip(*lm.score_block(m, *utf8(given.column("text")))))
    for (i, _), (n, known, base, score) in zip(rows, direct):
        r = got[i]
        assert (r["n"], r["known"], r["base"], r["score"]) == (n, known, pytest.approx(base), pytest.approx(score))


def test_batches_of_documents_and_intermediate_tables(spark, monkeypatch):
    """Small batches and shards give the same scores; the tables between the orders are gone after counting."""
    from riskweave.llm import store
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 2)] + [(None, "the cat")], "doc_id long, text string")
    key = lambda r: (-1 if r.doc_id is None else r.doc_id, r.n_tokens)
    whole = sorted(lm.op1_lm_scoring(docs.repartition(2)).collect(), key=key)
    made, keep = [], store.written
    monkeypatch.setattr(lm, "written", lambda df, name, *a: made.append((name, keep(df, name, *a))) or made[-1][1])
    monkeypatch.setattr(lm, "SCORE_BYTES", 50)
    monkeypatch.setattr(lm, "SHARD_BYTES", 300)
    parts = sorted(lm.op1_lm_scoring(docs.repartition(2)).collect(), key=key)
    for a, b in zip(whole, parts, strict=True):
        assert a[:5] == b[:5] and a.base_score == pytest.approx(b.base_score) and a.score == pytest.approx(b.score)
    from riskweave.session import path_exists
    assert not any(path_exists(spark, t.inputFiles()[0]) for name, t in made if name == "counts")
    assert all(path_exists(spark, t.inputFiles()[0]) for name, t in made if name != "counts")


def test_distinct_places_and_packed_keys():
    import numpy as np
    for n in (0, 1, 5000):
        keys = np.random.default_rng(n).integers(0, 900, n).astype(np.uint64) << np.uint64(54)
        want, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        assert all(np.array_equal(a, b) for a, b in zip((*lm.distinct(keys), *lm.places(keys)), (want, counts, want, inverse)))
        assert np.array_equal(lm.unpack(lm.pack(want)), want)
