"""Readers and writers: corpora as lines or whole files, models and indexes as Parquet tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder.  One of fewer files than cores is spread over the cores; larger ones are read as they lie."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < min(cores, 32) else df


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): one document a line; the id is a hash of the line and its file."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(F.xxhash64(F.input_file_name(), "value").alias("doc_id"), F.col("value").alias("text"))


def files(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.xxhash64(F.input_file_name()).alias("doc_id"), F.col("value").alias("text"))


def write_index(postings: DataFrame, path: str) -> None:
    postings.repartitionByRange("position").sortWithinPartitions("position", "word").write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; a local session without one uses a folder of its own, a cluster has
    to name it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_models: dict[tuple[str, ...], DataFrame] = {}


def stored(spark: SparkSession, name: str, folder: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A model that is built once in a session for each folder, and read as a table of the shared folder from then on."""
    key = (spark.sparkContext.applicationId, name, folder)
    if key not in _models:
        _models[key] = kept(build(), name)
    return _models[key]
