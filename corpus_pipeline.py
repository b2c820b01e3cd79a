"""From raw documents to token files: language ID, near-duplicates,
benchmark decontamination, mixing, token output.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
stored and read again as the next stage's docs; all but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimledger.llm import decontaminate, language, mixing, ngram_join, tokens
from claimledger.llm.common import materialize, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; dictionaries come from their own labels."""
    return language.keep_identified(docs, language.learn(docs.select("doc_id", "text", "lang")))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (five-word shingles, similarity 0.8)."""
    return ngram_join.first_of_class(docs, 5, 80, 100)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixing.mixed_documents(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and per document what was read back from them."""
    return tokens.read_files(tokens.store(docs))


STAGES = [
    ("language ID", identified),
    ("n-gram Jaccard join", deduplicated),
    ("benchmark decontamination", decontaminated),
    ("mixing", mixed),
    ("token output", tokenized),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Compression, edit distance and tokenizers have no SQL form: tests hold the stages against brute force.
ORACLE_SQL = None
