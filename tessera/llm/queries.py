"""The operators' queries over the tables of a folder, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import contained
from .htmltree import main_text
from .jaccard import near_duplicates
from .language import fit, held_out, identify
from .mixing import mix
from .multiindex import search
from .oracle import SQL
from .pii import digest, find
from .substring import remove_repeats
from .suffixlm import score
from .tokencount import token_counts


def tokenizer_file(name: str = "piece_bpe_32k.model", folder: str | None = None) -> str:
    """A public vocabulary file: in `folder`, or in that of TESSERA_TOKENIZERS, or in the installed package of them."""
    folder = folder or os.environ.get("TESSERA_TOKENIZERS") or os.path.dirname(importlib.util.find_spec("public_tokenizers").origin)
    return os.path.join(folder, name)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), text=False).drop("kept")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("pii_base", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(digest(F.col("pii_base")), 256).alias("base_sha256"), digest(F.col("pii")).alias("spans"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs.select("doc_id", "text", F.array("source").alias("sources"))).drop("sources")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 10, 0))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    net = fit(docs.where(~out))
    return identify(docs, net, ["doc_id"]).select("doc_id", out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_pii": op2_pii,
    "op3_source_mixing": op3_source_mixing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_decontamination": op6_decontamination,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_language_id": op9_language_id,
    "op10_token_counts": op10_token_counts,
}

ORACLE_SQL: dict[str, str] = SQL
