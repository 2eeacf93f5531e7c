"""Word fingerprints of a corpus in one pass: hits are counted where the texts lie, and only counts move."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

TOKENS = 250_000  # tokens of texts that are counted at once (a longer text goes alone)
HELD = 4_000_000  # different hits that a task holds before it passes them on


def place(word: str, grid: int) -> int:
    """hashed(word) modulo the grid, as hdc.hashed has it."""
    return (int.from_bytes(md5(word.encode()).digest()[:8], "big") >> 4) % grid


def record(grid: int) -> np.dtype:
    """A place and how often it was hit; more than 255 hits take several records."""
    return np.dtype([("p", "<u2" if grid <= 1 << 16 else "<u4"), ("n", "u1")])


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and the sum of the counts of each (1 where there are none)."""
    if counts is None:
        keys = np.sort(keys)
    elif len(keys) and int(keys.max()) < 1 << 38 and int(counts.max()) < 1 << 24:  # both in one number: no order to follow
        both = np.sort(keys << 24 | counts)
        keys, counts = both >> 24, both & (1 << 24) - 1
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.diff(np.append(starts, len(keys))) if counts is None else np.add.reduceat(counts, starts)


def binaries(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    """Binary values from the end of each in data."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def parts(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """(document, code, words) of the tokens of some whole texts after others."""
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat, low, at = lists.flatten(), 0, 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, at + TOKENS, side="right")))
        some = flat.slice(at, int(ends[high - 1]) - at).dictionary_encode()
        lengths = np.diff(np.concatenate([[at], ends[low:high]]))
        yield np.repeat(np.arange(low, high), lengths), some.indices.to_numpy(zero_copy_only=False).astype(np.int64), some.dictionary.to_pylist()
        low, at = high, int(ends[high - 1])


def counter(grid: int, half: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (tokens) to (word, hits, df): the places that the words near a word give it, and the texts with the word."""
    kind = record(grid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, int] = {}
        places = np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        df = np.zeros(0, np.int64)
        n_held = 0

        def passed() -> pa.RecordBatch:
            keys, counts = summed(*map(np.concatenate, zip(*held, strict=True)))
            times = -(-counts // 255)
            ends = np.cumsum(times)
            rows = np.full(int(ends[-1]) if len(ends) else 0, 255, kind)
            rows["p"] = np.repeat(keys % grid, times)
            rows["n"][ends - 1] = counts - (times - 1) * 255
            last = np.concatenate([[0], ends])[np.searchsorted(keys, np.arange(1, len(codes) + 1) * grid)]
            return pa.RecordBatch.from_arrays([pa.array(list(codes), pa.string()), binaries(last * kind.itemsize, rows), pa.array(df)], ["word", "hits", "df"])

        for batch in batches:
            for doc, local, words in parts(batch.column(0)):
                new = [w for w in words if w not in codes]
                for w in new:
                    codes[w] = len(codes)
                if new:
                    places = np.concatenate([places, np.array([place(w, grid) for w in new], np.int64)])
                code = np.array([codes[w] for w in words], np.int64)[local] if words else local
                at, pairs = places[code], []
                for far in range(1, half + 1):
                    same = np.flatnonzero(doc[far:] == doc[:-far])
                    pairs += [code[same] * grid + at[same + far], code[same + far] * grid + at[same]]
                held.append(summed(np.concatenate(pairs)))
                n_held += len(held[-1][0])
                seen = summed(doc * max(1, len(codes)) + code)[0] % max(1, len(codes))
                df = np.bincount(seen, minlength=len(codes)) + np.pad(df, (0, len(codes) - len(df)))
                if n_held > HELD:
                    held = [summed(*map(np.concatenate, zip(*held, strict=True)))]
                    n_held = len(held[0][0])
                    if n_held > HELD // 2:
                        yield passed()
                        codes, places, held, df, n_held = {}, places[:0], [], df[:0], 0
        if held:
            yield passed()

    return run


def word_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (tokens) to (word, n, df): the tokens of a word and the texts with it, as a task has them."""
    codes: dict[str, int] = {}
    both = np.zeros((2, 0), np.int64)

    def passed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(codes), pa.string()), pa.array(both[0]), pa.array(both[1])], ["word", "n", "df"])

    for batch in batches:
        for doc, local, words in parts(batch.column(0)):
            for w in words:
                codes.setdefault(w, len(codes))
            code = np.array([codes[w] for w in words], np.int64)[local] if words else local
            seen = summed(doc * max(1, len(codes)) + code)[0] % max(1, len(codes))
            both = np.pad(both, ((0, 0), (0, len(codes) - both.shape[1])))
            both += np.array([np.bincount(x, minlength=len(codes)) for x in (code, seen)])
            if len(codes) > HELD // 4:
                yield passed()
                codes, both = {}, both[:, :0]
    if codes:
        yield passed()


def merger(grid: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (word, hits, df), in order of the word, to (word, positions, cardinality, hits, df)."""
    kind = record(grid)

    def finished(words: pa.Array, keys: np.ndarray, counts: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
        starts = np.searchsorted(keys, np.arange(len(words) + 1) * grid)
        sizes, kept = np.diff(starts), np.ones(len(keys), bool)
        for w in np.flatnonzero(sizes > most):
            n = counts[starts[w] : starts[w + 1]]
            limit = np.partition(n, len(n) - most)[len(n) - most]
            chosen = n > limit
            chosen[np.flatnonzero(n == limit)[: most - int(chosen.sum())]] = True  # ties: the lower position
            kept[starts[w] : starts[w + 1]] = chosen
        total = np.diff(np.concatenate([[0], np.cumsum(counts)])[starts])
        some = np.flatnonzero(sizes > 0)  # a word that is always alone has no place
        words, sizes, total, df = words.take(pa.array(some)), np.minimum(sizes, most)[some], total[some], df[some]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(keys[kept] % grid, pa.int32()))
        return pa.RecordBatch.from_arrays([words, lists, pa.array(sizes, pa.int32()), pa.array(total, pa.int64()), pa.array(df, pa.int64())], ["word", "positions", "cardinality", "hits", "df"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, carried = None, (np.zeros(0, np.int64), np.zeros(0, np.int64), 0)  # the last word so far, which may go on

        for whole in batches:
            for low in range(0, len(whole), 1000):
                batch = whole.slice(low, 1000)
                words, hits = batch.column(0).dictionary_encode(), batch.column(1)
                of, names = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
                ends = np.frombuffer(hits.buffers()[1], np.int32)[hits.offset : hits.offset + len(hits) + 1]
                rows = np.frombuffer(hits.buffers()[2], kind, (ends[-1] - ends[0]) // kind.itemsize, int(ends[0]))
                keys = np.repeat(of, np.diff(ends) // kind.itemsize) * grid + rows["p"]
                counts, df = rows["n"].astype(np.int64), np.bincount(of, batch.column(2).to_numpy(), len(names)).astype(np.int64)
                if word is not None:
                    if names[0].as_py() == word:
                        keys, counts = np.concatenate([carried[0], keys]), np.concatenate([carried[1], counts])
                        df[0] += carried[2]
                    else:
                        yield finished(pa.array([word], pa.string()), *carried[:2], np.array([carried[2]]))
                keys, counts = summed(keys, counts)
                cut = np.searchsorted(keys, (len(names) - 1) * grid)
                if len(names) > 1:
                    yield finished(names[:-1], keys[:cut], counts[:cut], df[:-1])
                word, carried = names[-1].as_py(), (keys[cut:] % grid, counts[cut:], int(df[-1]))
        if word is not None:
            yield finished(pa.array([word], pa.string()), *carried[:2], np.array([carried[2]]))

    return run


def word_fingerprints(docs: DataFrame, grid: int, most: int = 328, half: int = 2, text_col: str = "text") -> DataFrame:
    """word, positions, cardinality, hits, df: fingerprints.word_fingerprints of fingerprints.context_hits, with the sum of a
    word's hits and the number of rows that have it.  A word has at most as many counts in a task as the grid has places."""
    counted = docs.select(T.tokens(F.col(text_col)).alias("t")).mapInArrow(counter(grid, half), "word string, hits binary, df long")
    sorted_ = counted.repartition("word").sortWithinPartitions("word")
    return sorted_.mapInArrow(merger(grid, most), "word string, positions array<int>, cardinality int, hits long, df long")


def by_row(docs: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows that have an id of their own, and the others, if there are any: rows without an id or with one that occurs
    more than once."""
    ids = docs.groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1 OR _id IS NULL")
    if ids.isEmpty():
        return docs, None
    marked = docs.join(ids, F.col(id_col).eqNullSafe(F.col("_id")), "left")
    return marked.where("_n IS NULL").select(*docs.columns), marked.where("_n IS NOT NULL").select(*docs.columns)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, df): tokens of each word, and the ids whose texts have it.  Rows with an id of their own are counted where
    they lie; those that share one meet by id first."""
    alone, shared = by_row(docs, id_col)
    counts = alone.select(T.tokens(F.col(text_col)).alias("t")).mapInArrow(word_counter, "word string, n long, df long")
    if shared is not None:
        each = shared.select(F.col(id_col).alias("_id"), F.explode(T.tokens(F.col(text_col))).alias("word")).groupBy("_id", "word").agg(F.count("*").alias("n"))
        counts = counts.unionByName(each.select("word", "n", F.when(F.col("_id").isNotNull(), 1).otherwise(0).cast("long").alias("df")))
    return counts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def with_frequency(fps: DataFrame) -> DataFrame:
    """word, positions, cardinality, frequency (share of all hits)."""
    total = fps.agg(F.sum("hits").alias("total"))  # one row
    return fps.crossJoin(F.broadcast(total)).select("word", "positions", "cardinality", (F.col("hits") / F.col("total")).alias("frequency"))
