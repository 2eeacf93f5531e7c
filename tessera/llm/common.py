"""What the operators share: the shared folder, whole tables, words as Spark sees them."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Options of tables on the way.  Without Hadoop's native library, an executor starts a chmod for each file, each .crc file and
#: each task's folder in file://, and until that is another program the executor's memory counts twice.  Pages have checksums of
#: their own, verified here in place of the .crc files.
LEAN = {
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
    "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false",
    "parquet.page.write-checksum.enabled": "true",
    "parquet.page.verify-checksum.enabled": "true",
}

#: One word: a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
SPACES = r"[ \x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  A local session that names none (as in tests) gets one; a cluster has to name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


class _Scratch(threading.local):
    """The folders of the operators that run now, innermost last, and the catalog's tables in each."""

    def __init__(self) -> None:
        self.folders: list[tuple[str, list[str]]] = []


_scratch = _Scratch()


def scratched(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """operator (whose first argument is a DataFrame) with its result written, and all else that it wrote removed."""

    @wraps(operator)
    def run(docs: DataFrame, *args: object, **options: object) -> DataFrame:
        spark = docs.sparkSession
        _scratch.folders.append((os.path.join(shared_dir(spark), f"{operator.__name__}-{uuid.uuid4().hex}"), []))
        folder, tables = _scratch.folders[-1]
        try:
            result = operator(docs, *args, **options)
            _scratch.folders.pop()
            path = _path(spark, operator.__name__)
            result.write.parquet(path)
            return spark.read.schema(result.schema).parquet(path)
        finally:
            if _scratch.folders and _scratch.folders[-1][0] == folder:
                _scratch.folders.pop()
            for name in tables:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            place = spark._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

    return run


def _path(spark: SparkSession, label: str) -> str:
    return os.path.join(_scratch.folders[-1][0] if _scratch.folders else shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and outlives any executor."""
    path = _path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).options(**options).parquet(path)


def keyed(df: DataFrame, label: str, key: str, buckets: int, **options: str) -> DataFrame:
    """The same in buckets by key, so that joins and groups on it move the other side alone.  For operators that are scratched."""
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    df.write.options(**options).bucketBy(buckets, key).option("path", _path(spark, label)).saveAsTable(name)
    _scratch.folders[-1][1].append(name)
    return spark.table(name)


def removed(*tables: DataFrame) -> None:
    """Tables of written or keyed that are spent: their files go before the operator ends."""
    for df in tables:
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character unchanged.  Texts of ASCII alone take the fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words of a text as an array (null text: empty array)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words, without building more than one array."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACES}|{SPACES}$", "")
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, SPACES))).cast("long")
