"""From documents to token ids: five stages, each on all that the one before it kept.

Every stage takes documents with nulls in any column, empty and very long texts, repeated rows and ids, and columns of any
other name, which it passes on; an empty table gives an empty one. What becomes of them is stated at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, langid, neardup, pieces, secrets
from tidemark.llm.common import discard, load, written

REDACTED = "[REDACTED]"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; null texts and those without a letter go. A null lang is filled with the prediction."""
    found = langid.identify(docs, langid.fit(docs)).where("lang_pred <> 'und'")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the document with the least doc_id (a null one is the largest); of one id, each unlike text."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; a null text has none."""
    return decontaminate.clean_documents(docs, load(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts and n_chars counted anew; a null text stays null, with a null n_chars."""
    clean = secrets.scan(docs, secrets.fit(docs), redact=REDACTED)
    return clean.withColumn("text", F.col("redacted")).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids, and whether decoding gives the text again; null for a null text."""
    return pieces.encode(docs, pieces.compile_model())


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: SQL can express neither the automata nor the alignment; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
