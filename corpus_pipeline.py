"""A training corpus from documents, in stages of Spark operators.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All stages but the last return the columns of documents.

Defined results, stage by stage: null and empty texts fail the base rule of the first stage, so the later ones see texts only;
used alone they keep such texts (they link to nothing, hold no benchmark window and no entity, and have no tokens to draw). Repeated
rows are judged one by one by the first stage, and the second keeps one of them; rows without an id pass all stages but are told
apart by their text only. Ties go to the least doc_id. Empty tables give empty tables; without labels nothing is learned and the
base rule alone decides; without benchmark items nothing is contaminated. Other columns of the documents pass through the first
four stages unchanged, whatever their names; the last one returns doc_id, source and its own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperlake.llm import decontamination, mixing, ngram_join, pii, quality_rules
from paperlake.llm.shared import store, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned decision list keep."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (word 5-grams, Jaccard 0.8 or more)."""
    return ngram_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with surrogates for personal data."""
    return pii.pseudonymise(docs).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The order in which documents are drawn, sources at their temperature weights."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("pii surrogates", surrogates),
    ("temperature mixing", mixture),
]
#: Hash orders and a learned list are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
