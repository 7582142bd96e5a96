"""Queries of the subpackage: QUERIES[name](spark, sf_dir) and ORACLE[name] (DuckDB SQL)."""

from __future__ import annotations

from . import (balltree, ffd, jaccard, licenses, lines, lm, mixing, packing, quality, resampling, spelling, trainorder,
               vamana)
from .store import read

#: Folder of the public vocabulary files; the package names it if it is installed.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


QUERIES: dict = {}
ORACLE: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_quality_classifier(spark, sf_dir):
    return quality.op4_quality_classifier(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op6_best_fit_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary())


@query
def op3_ngram_jaccard_join(spark, sf_dir):
    return jaccard.join(read(spark, sf_dir, "documents"))


@query
def op10_line_dedup(spark, sf_dir):
    return lines.report(read(spark, sf_dir, "documents"))


@query
def op1_lm_scoring(spark, sf_dir):
    return lm.op1_lm_scoring(read(spark, sf_dir, "documents"))


@query
def op2_mixing_to_targets(spark, sf_dir):
    return mixing.op2_mixing(read(spark, sf_dir, "documents"))


@query
def op5_exact_top_k(spark, sf_dir):
    return balltree.top_k(read(spark, sf_dir, "embeddings"))


ORACLE["op5_exact_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
           FROM (SELECT DISTINCT vec_id, embedding FROM embeddings)
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


@query
def op9_approximate_neighbours(spark, sf_dir):
    return vamana.nearest(read(spark, sf_dir, "embeddings"))


@query
def op8_license_scan(spark, sf_dir):
    return licenses.op8_license_scan(read(spark, sf_dir, "documents"))


@query
def op7_training_order(spark, sf_dir):
    return trainorder.materialise(read(spark, sf_dir, "documents"), vocabulary())[1]


@query
def op11_importance_resampling(spark, sf_dir):
    return resampling.op11_importance_resampling(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLE["op11_importance_resampling"] = resampling.ORACLE_SQL


@query
def op12_spelling_variants(spark, sf_dir):
    return spelling.op12_spelling_variants(read(spark, sf_dir, "documents"))


ORACLE["op12_spelling_variants"] = spelling.oracle_sql()


@query
def op13_ffd_packing(spark, sf_dir):
    return ffd.op13_ffd_packing(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
