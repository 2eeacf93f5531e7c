"""A training corpus from raw documents: language ID, near duplicates, decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and gives the documents that it keeps, as the next stage reads them; the last one
gives the mixture.  run() writes each stage's documents to the session's shared folder.

Columns beside those of documents pass through all stages but the last, whatever their names.  An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, written
from tessera.llm.decontaminate import without_leaks
from tessera.llm.jaccard import one_of_each
from tessera.llm.language import UNKNOWN, fit, predicted
from tessera.llm.mixing import mix
from tessera.llm.pii import redacted, spotted


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; lang is the predicted one.  Null texts and texts without a letter go."""
    row = lambda c: F.col("lang_pred").alias(c) if c == "lang" else F.col("row")[c].alias(c)
    return predicted(docs, fit(docs)).where(F.col("lang_pred") != UNKNOWN).select(*map(row, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: that of the least doc_id (of rows that share it, one).  Texts
    without words are nobody's duplicates: all of them stay."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.  Null and empty texts contain none; equal rows go or stay together."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each span of personal data replaced by its kind; n_chars follows the text.  Null texts stay null."""
    text = redacted(F.col("row.text"), F.col("pii"))
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return spotted(docs).select(*(new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document: doc_id, source, size, source_size, target, taken."""
    mixed = mix(docs.select("doc_id", "text", F.array("source").alias("sources")))
    return mixed.select("doc_id", F.element_at("sources", 1).alias("source"), "size", "source_size", "target", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

#: Language ID and the seeded selection can't be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
