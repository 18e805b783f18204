"""A corpus in four stages: languages, quality, near copies, packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before it kept; all but the last return the columns of
``documents``. Nothing is sampled away: a stage drops a document only by its own decision. Rows without an id are judged like others, rows that
share an id each by their own text, until the third stage, which counts rows of one id as one document; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import langid, neardup, quality, queries
from spanloom.llm.common import crc_bucket, free_name, table

#: Texts below this likeness to every language profile are in none of the languages; clean texts stand above 0.35.
LEAST_LIKENESS = 0.2


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter (null and empty ones too) and texts unlike every learned language."""
    found = free_name(docs, "language")
    judged = langid.identify(docs, learn_from=crc_bucket("doc_id", 4) != 2, output=found)
    return judged.where((F.col(f"{found}.lang_pred") != langid.UNDETERMINED) & (F.col(f"{found}.score") >= LEAST_LIKENESS)).select(docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that rank below the quality threshold; where no labelled document is left to learn from, all stay."""
    score = free_name(docs, "quality_score")
    rated = quality.rate(docs, table(spark, sf_dir, "labels"), learn_from=crc_bucket("doc_id", 3) != 1, output=score)
    return rated.where(F.col(score) >= 0.5).select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies, the one with the smallest id; of rows that share an id one stays, rows without an id all stay."""
    return neardup.keep_representatives(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 2048, of every row that is left, with or without an id."""
    return queries.packed_digests(docs)


STAGES = [("language", known_language), ("quality", good_quality), ("near copies", one_of_each), ("packing", packed)]

#: SQL can express none of these stages; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), neardup.Scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep_last(docs)  # what the stage has read is no longer needed
    return docs
