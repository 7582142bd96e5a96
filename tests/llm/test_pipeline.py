"""The pipeline's stages one after another: schemas, and each stage's decisions against plain ones."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from riskweave.llm import jaccard, lines, mixing, packing, quality
from riskweave.llm.queries import vocabulary
from riskweave.llm.store import read, written

from test_pairs import brute_components, brute_lines

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "ngram_jaccard", "mixing", "packing"]


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = read(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        nxt = written(stage(spark, docs, SF), f"test-{name}")
        out.append((docs, nxt))
        docs = nxt
    return out


def test_schemas_and_decisions(spark, steps):
    first = steps[0][0]
    for given, got in steps[:-1]:
        assert got.schema == first.schema
    given, got = steps[0]
    pred = quality.op4_quality_classifier(given, read(spark, SF, "labels"))
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in pred.where("predicted = 1").collect()}
    given, got = steps[1]
    rows = [(r.doc_id, r.text) for r in given.collect()]
    gone, want = brute_lines(rows), {}
    for i, t in rows:
        left = [x for k, x in enumerate((t or "").split("\n")) if (i, k) not in gone]
        if left:
            want[i] = "\n".join(left)
    have = {r.doc_id: r.text for r in got.collect()}
    differ = [i for i in set(have) | set(want) if have.get(i) != want.get(i)]
    assert len(differ) <= 0.02 * len(rows)                     # signatures may miss a pair near the threshold
    given, got = steps[2]
    rows = [(r.doc_id, r.text) for r in given.collect()]
    u = brute_components(rows)
    assert {r.doc_id for r in got.collect()} == {u.find(i) for i, _ in rows}
    given, got = steps[3]
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in mixing.op2_mixing(given).where("sampled").collect()}
    given, got = steps[4]
    packed = got.collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in given.collect()}
    fill = Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= packing.CAPACITY
    assert len(fill) == -(-sum(fill.values()) // packing.CAPACITY)


def test_run_gives_the_same_rows(spark, steps):
    got = Counter((r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == Counter((r.doc_id, r.piece, r.ids_crc32) for r in steps[-1][1].collect())


def test_stages_keep_extra_columns_and_take_empty_tables(spark):
    docs = read(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name
    assert lines and jaccard and vocabulary()


def test_near_duplicate_stage_compares_five_words_at_80(spark):
    rng = random.Random(3)
    rows, far = [], 0
    for k in range(25):
        a = [f"v{rng.randrange(5000)}" for _ in range(400)]
        b = list(a)
        for at in rng.sample(range(400), rng.randint(7, 11)):
            b[at] = "x"
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]

    def similar(n, a, b):
        s, t = ({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} for w in (a.split(), b.split()))
        return len(s & t) / len(s | t)
    want = set()
    for (i, a), (j, b) in zip(rows[::2], rows[1::2]):
        want |= {i} if similar(5, a, b) >= 0.8 else {i, j}
        far += similar(5, a, b) >= 0.8 and similar(3, a, b) < 0.9
    assert far > 0 and len(want) > 25                                # linked by five words only; not linked at all
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.ngram_jaccard_stage(spark, docs, SF).collect()} == want
