"""A corpus pipeline over ``documents``: language, quality, repeated lines, near copies, packing.

Each stage is a function of (spark, docs, sf_dir) that works on all documents that the stage before has kept. All but
the last return the columns of documents, whatever their names; the last returns the packed pieces.

Null, empty and letterless texts go with the first stage. Documents with a null doc_id stay until a stage has a reason in
their text; repeated rows are judged alike, and rows that share a doc_id are one document to the stages of lines and near
copies. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import jaccard, language, lines, packing, quality
from tessera.llm.common import stored, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language that is learned from docs, go."""
    return language.keep_known(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among docs, holds to be bad go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and similar lines the first stays; documents without a line of their own go."""
    return lines.keep_fresh(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of their 5-word shingles the smallest doc_id stays."""
    return jaccard.keep_one(docs, k=5, num=80, den=100)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", known_language),
    ("quality classifier", good_quality),
    ("line dedup", fresh_lines),
    ("n-gram Jaccard join", one_of_near_copies),
    ("best-fit packing", packed),
]

#: Language models, classifiers, MinHash and BPE can't be written in SQL; the tests hold every stage against its own check.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents of the folder that the stages keep; what a stage keeps is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
