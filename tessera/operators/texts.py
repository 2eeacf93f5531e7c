"""Fingerprints of all texts of a corpus: the words that most texts share go to every task, only the rare ones are joined."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scan import ragged, spread
from . import fingerprints as fp
from .vocabulary import by_row, parts, summed

BITS = 17
OTHER = 1 << BITS  # codes of the other words begin here
COMMON = OTHER  # words of the broadcast at most
TOGETHER = 64  # texts that are added up at once


def counted(batches: Iterator[pa.RecordBatch], common: dict[str, int]) -> Iterator[tuple[pa.Array, int, int, np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """Of batches of (id, tokens), for some texts at a time: ids, the first text, how many, and (text, code, tf) of each
    different word; codes from OTHER on are places in the list of the others."""
    for batch in batches:
        low = 0
        for doc, local, words in parts(batch.column(1)):
            if not len(doc):
                continue
            code = np.array([common.get(w, -1) for w in words], np.int64)
            rare = np.flatnonzero(code < 0)
            code[rare] = OTHER + np.arange(len(rare))
            wide, low = OTHER + len(rare), int(doc[0])
            keys, tf = summed((doc - low) * wide + code[local])
            yield batch.column(0), low, int(doc[-1]) + 1 - low, keys // wide, keys % wide, tf, [words[x] for x in rare]


def requests(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (id, tokens) to (word, id, tf) of the words that are not common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = {w: i for i, w in enumerate(shared.value[0])}
        for ids, low, _, doc, code, tf, words in counted(batches, common):
            some = code >= OTHER
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()).take(pa.array(code[some] - OTHER)), ids.take(pa.array(doc[some] + low)), pa.array(tf[some], pa.int64())], ["word", "id", "tf"])

    return run


def codes(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (id, tokens) to (id, codes): the common words of a text, each with how often it occurs in the upper bits."""
    most = (1 << 31 - BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = {w: i for i, w in enumerate(shared.value[0])}
        for ids, low, n, doc, code, tf, _ in counted(batches, common):
            some = code < OTHER
            doc, code, tf = doc[some], code[some], tf[some]
            times = -(-tf // most)  # what does not fit takes several
            tf = np.where(np.arange(times.sum()) == np.repeat(np.cumsum(times) - 1, times), np.repeat(tf - (times - 1) * most, times), most)
            ends = np.searchsorted(np.repeat(doc, times), np.arange(n + 1))
            values = pa.array((tf << BITS | np.repeat(code, times)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([ids.slice(low, n), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["id", "codes"])

    return run


def chosen(worth: np.ndarray, most: int) -> np.ndarray:
    """Which of these are the `most` largest; ties: the first."""
    limit = np.partition(worth, len(worth) - most)[len(worth) - most]
    out = worth > limit
    out[np.flatnonzero(worth == limit)[: most - int(out.sum())]] = True
    return out


def adder(shared: Broadcast, grid: int, most: int, lowest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (id, codes, w, positions), in order of the id, to (id, positions): codes are those of common words, a rare
    word has a row of its own with its weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, flat, starts, idf = shared.value
        sizes = np.diff(starts)

        def added(batch: pa.RecordBatch, of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
            for low in range(0, int(of[-1]) + 1, TOGETHER):
                a, b = np.searchsorted(of, [low, low + TOGETHER])
                some, own = batch.slice(a, b - a), of[a:b] - low
                value, n = ragged(some.column(1))
                code = value & OTHER - 1
                at, m = ragged(some.column(3))
                each, whose = sizes[code], np.repeat(own, n)
                keys = np.concatenate([np.repeat(whose * grid, each) + flat[spread(starts[code], each)], np.repeat(own * grid, m) + at])
                weights = np.concatenate([np.repeat((value >> BITS) * idf[code], each), np.repeat(some.column(2).fill_null(0).to_numpy(zero_copy_only=False), m)])
                n_docs = int(own[-1]) + 1
                worth = np.bincount(keys, weights, n_docs * grid).reshape(n_docs, grid)  # whole numbers: exact
                there = np.zeros(n_docs * grid, bool)
                there[keys] = True
                for d, mine in enumerate(there.reshape(n_docs, grid)):
                    places = np.flatnonzero(mine)
                    if len(places) > most:
                        places = places[:most] if lowest else places[chosen(worth[d, places], most)]
                    if len(places):
                        yield low + d, places

        def finished(batch: pa.RecordBatch, of: np.ndarray) -> pa.RecordBatch:
            docs, places = zip(*found, strict=True) if (found := list(added(batch, of))) else ((), ())
            ends = np.cumsum([0, *map(len, places)])
            first = np.searchsorted(of, np.array(docs, np.int64))
            values = np.concatenate(places) if places else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))], ["id", "positions"])

        rest = None
        for batch in batches:
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            of = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(of):
                continue
            cut = int(np.searchsorted(of, of[-1]))  # the last text may go on
            if cut:
                yield finished(batch.slice(0, cut), of[:cut])
            rest = batch.slice(cut)
        if rest is not None:
            yield finished(rest, np.zeros(len(rest), np.int64))

    return run


def text_fingerprints(docs: DataFrame, fps: DataFrame, grid: int, how: str = "weighted", most: int = 328, id_col: str = "doc_id", text_col: str = "text", df: DataFrame | None = None, n_docs: int = 0) -> DataFrame:
    """fingerprints.text_fingerprints of many texts, with fps (word, positions, hits).  The places of the COMMON words with most
    hits go to all tasks, whatever the vocabulary; the other words of a text meet the vocabulary in a join and come back by
    id.  Rows that share an id, or have none, take the way of fingerprints.text_fingerprints."""
    spark = docs.sparkSession
    alone, others = by_row(docs, id_col)
    if how in ("idf", "tfidf"):
        idf = F.round(F.log(F.lit(float(n_docs)) / F.coalesce("df", F.lit(1))) * 1_000_000).cast("long")
        words = (fps if "df" in fps.columns and df is None else fps.drop("df").join(df, "word", "left")).withColumn("idf", idf)
    else:
        words = fps.withColumn("idf", F.lit(1).cast("long"))
    total, least = 0, 0
    for hits, n in fps.groupBy("hits").agg(F.count("*").alias("n")).orderBy(F.desc("hits")).limit(COMMON + 1).collect():
        total += n
        if total > COMMON:
            least = hits + 1
            break
    held = words.where(F.col("hits") >= least).select("word", "positions", "idf").toArrow().combine_chunks()
    flat, sizes = ragged(held.column("positions").combine_chunks()) if len(held) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    shared = spark.sparkContext.broadcast((held.column("word").to_pylist(), flat.astype(np.int32), np.concatenate([[0], np.cumsum(sizes)]), held.column("idf").to_numpy()))
    kind = dict(docs.dtypes)[id_col]
    small = f"array<{'smallint' if grid <= 1 << 15 else 'int'}>"
    tokens = alone.select(F.col(id_col).alias("id"), T.tokens(F.col(text_col)).alias("t"))
    rows = tokens.mapInArrow(codes(shared), f"id {kind}, codes array<int>").select("id", "codes", F.lit(None).cast("long").alias("w"), F.lit(None).cast(small).alias("positions"))
    if least:
        rare = words.where(F.col("hits") < least).select("word", F.col("positions").cast(small).alias("positions"), "idf")
        answers = tokens.mapInArrow(requests(shared), f"word string, id {kind}, tf long").join(rare, "word")
        rows = rows.unionByName(answers.select("id", F.lit(None).cast("array<int>").alias("codes"), (F.col("tf") * F.col("idf")).alias("w"), "positions"))
    out = rows.repartition("id").sortWithinPartitions("id").mapInArrow(adder(shared, grid, most, how == "union"), f"id {kind}, positions array<int>").withColumnRenamed("id", id_col)
    if others is None:
        return out
    own = df if df is not None or "df" not in fps.columns else fps.select("word", "df")
    return out.unionByName(fp.text_fingerprints(others, fps, how, most, id_col, text_col, own, n_docs))
