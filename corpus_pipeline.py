"""Training-corpus pipeline: five stages over the documents, each on what the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All
but the last return the columns of ``documents``. ``run`` writes each stage's result as Parquet to the
shared folder and reads it again for the next one.

Defined cases are those of the operators: null texts are empty, repeated rows stay until the near
duplicates go, an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontamination, line_dedup, near_dedup, packing, quality_classifier
from foliant.llm.common import stash, table

#: Similarity of near duplicates in percent; the query op5_near_dedup has its own.
NEAR_THRESHOLD = 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours' vote does not reject."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that are similar to an earlier line; their lengths follow."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, which share 80 percent of their shingles or more."""
    return near_dedup.keep_first(docs, threshold=NEAR_THRESHOLD)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold benchmark passages."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, placed in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", remove_lines),
    ("near_dedup", keep_one_of_near),
    ("decontamination", remove_benchmark),
    ("best_fit_packing", pack_sequences),
]

#: The classifier and the packer have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
