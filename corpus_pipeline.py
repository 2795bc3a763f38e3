"""From raw documents to a training-order token store, in five stages.

Each stage takes the documents that its predecessor wrote, decides about all
of them, and returns those that stay, with the columns of ``documents``; the
last returns one row for each sequence that it wrote.

1. ``language_id``: documents without a letter, or with less than two
   fifths of their letters in any one language, go.
2. ``jaccard_join``: of each group of similar documents (five-word shingles,
   80 % or more) the one with the smallest doc_id stays.
3. ``decontamination``: documents that hold a benchmark window go.
4. ``mixing``: sources come to their target weights; documents are left out
   or repeated, and the one on a source's cut gives its first words.
5. ``token_output``: sequences in training order, in fixed-stride shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from augsight.llm import decontaminate, jaccard_join, language, mixing, token_store
from augsight.llm.common import documents, scratch, staged

#: Near-duplicate stage: words of a shingle, and similarity in percent.  Operator 5 has its own, 4 and 85.
SHINGLE, SIMILARITY = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.identified(docs)


def similar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, SHINGLE, SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_store.training_order(docs, scratch(spark, "shards"))


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", similar_documents),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
    ("token_output", token_output),
]

#: Learning and tokenising stages have no SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
