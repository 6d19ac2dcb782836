"""The corpus pipeline: quality rules, language ID, near-duplicates, repeated passages, packing.

Every stage works on all rows that the one before it kept and, but for the last, returns the columns of ``documents``;
each is written as Parquet in the shared folder and read again, so a lost executor costs one stage's tasks at most.

Defined results: null and empty texts have too few words and go in the first stage; of equal texts and repeated rows one stays, of
ties the least (doc_id, digest); texts of any length go through whole; other columns are carried along, whatever their names, until
packing gives its own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import bpe, dedup, language, neardup, packing, quality
from tabloom.llm.common import table, written
from tabloom.llm.queries import BYTE_VOCABULARY, PIECE_VOCABULARY, POLICY
from tabloom.session import ship

#: A language must be the likeliest by this score.
LEAST_SCORE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail an enforced rule go."""
    ship(spark)
    return quality.keep_passing(docs, POLICY)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language, or in none for sure, go; the languages are learned from what is not held out."""
    ship(spark)
    model = language.train(docs.where(~language.held_out()), bpe.vocabulary_path(PIECE_VOCABULARY))
    return language.keep_known(docs, model, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays."""
    ship(spark)
    return neardup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose every passage that stands earlier; documents of which nothing is left go."""
    ship(spark)
    return dedup.rewrite(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of the packed sequences."""
    ship(spark)
    return packing.pack(docs, bpe.vocabulary_path(BYTE_VOCABULARY))


STAGES = [
    ("quality", quality_rules),
    ("language", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packing_stage),
]

#: Language scores, sampled sketches and token ids can't be told in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
