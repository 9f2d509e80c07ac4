"""From raw documents to encoded training text, in five stages.

Every stage takes the documents that the one before kept and returns the columns of `documents`; the last returns what is
trained on.  Stages work on all rows they get: texts with null or no content stay unless a stage's operator says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronogrid.llm import decontam, neardup, pieces, pii, quality
from chronogrid.llm.common import cut, table
from chronogrid.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on a bounded sample of the labelled ones, accepts."""
    net = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, net).where("predicted = 1").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least doc_id."""
    return neardup.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage like a benchmark item."""
    return decontam.matched(docs, table(spark, sf_dir, "benchmark")).where(F.size("matches") == 0).select(*docs.columns)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and terms that disclose it replaced or left out."""
    return pii.sanitise(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as piece ids, and the text that these decode to."""
    found = pieces.encoded(docs, tokenizer_path())
    return found.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded")


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", personal_data_stage),
    ("SentencePiece encoding and decoding", pieces_stage),
]

#: A trained network, hash minima and merges of pieces aren't for SQL; the pipeline is tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stage's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
