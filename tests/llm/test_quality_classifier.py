"""Quality classifier: held-out accuracy, scores by a plain loop, edge cases."""

import numpy as np
import pyarrow as pa

from riskweave.llm import quality as Q
from riskweave.llm.text import utf8

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = Q.op4_quality_classifier(docs, labels)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    right = np.mean([r.predicted == r.quality for r in rows])
    common = max(np.mean([r.quality for r in rows]), 1 - np.mean([r.quality for r in rows]))
    assert right >= 0.95 > common


def features(text, p):
    """Plain list of the hashed features of one text."""
    raw, offs = utf8(pa.array([text]))
    w = Q.Words(raw, offs, lower=False)
    out = [int(f) for part, _ in Q.word_features(w, p) for f in part]
    data = text.encode()
    for n in p.ngrams:
        for i in range(len(data) - n + 1):
            gram = np.frombuffer(data[i:i + n], np.uint8)
            out.append(int(Q.gram_features(gram, np.array([0, n]), n, p)[0][0]))
    return out


def test_scores_equal_a_plain_average():
    p = Q.Params(buckets=1 << 10, dim=4)
    rng = np.random.default_rng(0)
    m = Q.Model(p, rng.normal(size=(p.buckets, 4)).astype(np.float32), rng.normal(size=(2, 4)).astype(np.float32), np.array([0.1, -0.3]))
    texts = ["", "a", "ab", "the the cat", "Été au lait, " * 3, "x y x y y", "long " * 300]
    raw, offs = utf8(pa.array(texts))
    got = Q.score_block(raw, offs, p, m.table, m.bias)
    for t, s in zip(texts, got):
        f = features(t, p)
        z = (np.mean([m.table[i].astype(float) for i in f], axis=0) if f else np.zeros(2)) + m.bias
        assert abs(s - 1 / (1 + np.exp(z[0] - z[1]))) < 1e-5


def test_training_separates_and_ignores_held_out(spark):
    rows = [(i, "good plain words here " * 3 if i % 2 else "### $$$ !!! " * 4) for i in range(300)]
    docs = spark.createDataFrame([(i, t, 0.5, 9) for i, t in rows], "doc_id long, text string, score double, predicted int")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(None, 1), (7, None), (3, 0), (3, 1), (3, 1)],
                                   "doc_id long, quality int")
    got = Q.op4_quality_classifier(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert all(r.predicted == r.doc_id % 2 for r in got.collect())
    # labels of held-out rows change nothing
    flipped = labels.withColumn("quality", Q.F.when(Q.held_out(), 1 - Q.F.col("quality")).otherwise(Q.F.col("quality")))
    a = {r.doc_id: r.score for r in got.collect()}
    assert a == {r.doc_id: r.score for r in Q.op4_quality_classifier(docs, flipped).collect()}
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id % 2 for r in kept.collect()} == {1}


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (None, "x"), (2, ""), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = Q.op4_quality_classifier(docs, labels).collect()
    assert len(got) == 4 and all(r.score == 0.5 and r.predicted == 1 for r in got if r.doc_id is not None)
    assert Q.op4_quality_classifier(docs.limit(0), labels).count() == 0
