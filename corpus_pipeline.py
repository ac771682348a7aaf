"""Corpus pipeline: from raw documents to a training mix, one operator a stage.

Defined results of every stage: an empty table gives an empty table of the same
columns; extra columns, whatever their names, pass through unchanged (but
``domain``, ``tokens`` and ``epoch``, which the last stage replaces); very long
texts are read whole; equal rows get equal decisions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyflow.llm import decontaminate, langid, mixing, neardup, pii
from eddyflow.llm.common import fresh, quoted, settle, table
from eddyflow.llm.queries import WEIGHTS, domain


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language the model is sure of.

    Null texts and texts without a letter have no language and go; documents
    without ``lang`` are judged, but teach nothing.
    """
    lang, score, rejected = fresh(docs.columns, "lang_pred", "score", "rejected")
    out = langid.identify(docs, langid.fit(docs), lang=lang, score=score, rejected=rejected)
    return out.filter(~F.col(rejected)).select(*map(quoted, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates: the one with the least doc_id.

    Null texts, texts without a word and rows without a doc_id stay; rows that
    share a doc_id are one document and stay or go together.
    """
    return neardup.without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a test item; null and empty texts hold none, null items are in no text."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redact personal data in the text; n_chars follows the new text, and is null where the text is."""
    clean = pii.redact(docs, pii.train())
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*map(quoted, docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Choose documents to the target weights: columns of documents, domain, tokens, epoch.

    Null languages and sources are leaves of their own; texts without tokens go
    with the documents before them.
    """
    return mixing.mix(docs, domain(), WEIGHTS)


STAGES = [("language ID", language_id), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("personal data", personal_data), ("mixing", mixture)]

#: No SQL can express the trained models of the first and fourth stage; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
