"""Streams of documents or words against a model: each batch is an ordinary plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..plans.retina import Retina


def fingerprint_stream(docs: DataFrame, model: Retina, path: str, checkpoint: str) -> StreamingQuery:
    """Fingerprints of arriving documents (doc_id, text), appended to a table once each."""

    def batch(part: DataFrame, number: int) -> None:
        model.fingerprint_texts(part).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def word_counts(docs: DataFrame, time_col: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts of words in event-time windows, closed when the watermark passes."""
    words = docs.withWatermark(time_col, late).select(time_col, F.explode(T.tokens(F.col("text"))).alias("word"))
    return words.groupBy(F.window(time_col, window), "word").agg(F.count("*").alias("n"))
