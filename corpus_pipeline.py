"""The training-data pipeline over ``documents``: five stages, each one operator.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns of ``documents``.

Defined cases: a null or letterless text is in no language and leaves at the first stage; a text without a word that
the labels know stays at the second; repeated rows, and rows that share a doc_id, are judged each by its own text, and of near
copies one row of the smallest doc_id stays, and every row without a doc_id; a text whose words all repeat
stays as an empty one and is packed as its closing id; texts of any length are read whole by every stage; columns of
any other name pass through unchanged; an empty table passes all stages, empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import langid, packing, simhash, substrings, toxicity
from ledgerloom.llm.common import materialize, small_batches, table
from ledgerloom.llm.queries import vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages stay."""
    small_batches(spark)
    return langid.keep_known(docs)


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxic threshold stay."""
    small_batches(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    small_batches(spark)
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur more than once leave the texts."""
    small_batches(spark)
    return substrings.remove_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of what is left."""
    small_batches(spark)
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("toxicity", non_toxic),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("packing", packed),
]

#: SQL can't express hashing into fingerprints, learned filters or tokens; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each one's rows are written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else materialize(docs, STAGES[i - 1][0]), sf_dir)
    return docs
