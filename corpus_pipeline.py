"""From raw documents to training sequences: five stages, each a table of its own.

Each stage takes ``(spark, docs, sf_dir)`` with the rows that the stage before
kept, and returns documents with the same columns (the last returns pieces of
sequences). Between stages the documents are written as Parquet and read again,
so a stage's decisions are made once and a lost executor repeats one stage's
tasks at most.

For every stage: null, empty and very long texts are texts like any other, null
ids and repeated rows are allowed, an empty table gives an empty result, and
further columns of any name pass through (they do not reach the last stage).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strataweave.llm import decision_list, hilbert_packing, positional_index, simhash_copies, weak_pii
from strataweave.llm.common import release, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go; null and blank texts have no words, so they go. Repeated rows are judged alike."""
    return decision_list.keep_good(docs, decision_list.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id stays, null ids last; texts without words are one group, and of equal rows one stays."""
    return simhash_copies.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go; null and blank texts stay, equal rows go together."""
    return positional_index.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; all rows stay, null texts as they are."""
    return weak_pii.mask(docs, weak_pii.fit(weak_pii.candidate_rows(docs)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, similar documents next to each other; null and empty texts are the end id alone, every row is packed."""
    return hilbert_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Fingerprints, learned rules and tokens have no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
