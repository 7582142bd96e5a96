"""Corpus pipeline: documents -> quality -> line dedup -> n-gram Jaccard -> mixing -> packed sequences.

Every stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes
each result as Parquet to the cluster's shared folder and reads it back as the
next stage's documents.  All stages but the last keep the columns of their
documents:

* quality: documents that the classifier rejects go (labels of the held-out
  rows are never learned from);
* line_dedup: of every group of like lines the first one stays; documents
  that lose all their lines go;
* ngram_jaccard: of every group of documents linked by a five-word Jaccard
  similarity of 0.8 or more the smallest id stays (op3's query has its own
  settings);
* mixing: documents are sampled towards the target weights;
* packing: the place of every piece of the rest in sequences of 2048 tokens.

No SQL can express the learned, iterative and search stages (``ORACLE_SQL`` is
None); the tests compare ``run`` with a plain version of the stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskweave.llm import jaccard, lines, mixing, packing, quality
from riskweave.llm.queries import vocabulary
from riskweave.llm.store import read, written


#: Settings of the near-duplicate stage: five words, 80 / 100.
NEAR = jaccard.Params(n=5, num=80)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup(docs)


def ngram_jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_per_component(docs, NEAR)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard", ngram_jaccard_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
