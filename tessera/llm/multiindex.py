"""Nearest neighbours by inner product over an inverted multi-index.

The two halves of a vector are quantised apart (k-means, `cells` centroids each), so a vector lies in one of cells**2
cells.  A query walks the pairs of centroids from the best summed half-product downwards with a heap, until the cells it
has met hold `fraction` of all vectors (and `least` at least); every entry in them is scored on the original vectors in
double precision.  The codebooks come from a bounded sample (`sample` rows by hash of id); every row is indexed.

Work is laid out in blocks: a first-half cell is split into blocks of about `block` entries by hash (a cell that holds a
third of all rows becomes many blocks), queries into blocks of as many; a task sees one pair of blocks at a time and
keeps k rows for each query.  Only counts by cell and the codebooks reach the driver.

Isotropic data leave any index little to skip: at 64 dimensions recall 0.9 asks for about half of the entries, hence the
default fraction.  Clustered data allow far less.

Defined results.  Rows without an id, or whose vector is null, zero, of an uncommon length, or holds a null or
non-finite component, take no part.  Of rows with one id the largest vector (as arrays compare) stands.  Ties go to the
smaller id.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

EXACT = 1 << 16  # candidates scored at a time


def kmeans(rows: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = rows[rng.choice(len(rows), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(rows, c)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, rows)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(rows: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None, :] - 2 * rows @ c.T).argmin(1)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def cells_by_heap(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Pairs of centroids by falling first[i] + second[j], until their counts come to `enough`."""
    o1, o2 = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    a, b = first[o1].tolist(), second[o2].tolist()
    o1, o2 = o1.tolist(), o2.tolist()
    heap, met, got = [(-(a[0] + b[0]), 0, 0)], 0, []
    while heap and met < enough:
        _, i, j = heappop(heap)
        if n := counts[o1[i]][o2[j]]:
            got.append((o1[i], o2[j]))
            met += n
        if j + 1 < len(b):
            heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
    return got


def assigner(c1: np.ndarray, c2: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                v, half = matrix(batch.column(1)), c1.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nearest(v[:, :half], c1).astype(np.int32)), pa.array(nearest(v[:, half:], c2).astype(np.int32))], ["id", "v", "i", "j"])

    return run


def walker(c1: np.ndarray, c2: np.ndarray, counts: np.ndarray, enough: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each query (id, v) to rows (qid, qv, i, js): the second-half cells that it visits under each first-half cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = counts.tolist()
        for batch in batches:
            if not len(batch):
                continue
            v, half = matrix(batch.column(1)), c1.shape[1]
            p1, p2 = v[:, :half] @ c1.T, v[:, half:] @ c2.T
            row, of, js = [], [], []
            for q in range(len(v)):
                by: dict[int, list[int]] = {}
                for i, j in cells_by_heap(p1[q], p2[q], cells, enough):
                    by.setdefault(i, []).append(j)
                row += [q] * len(by)
                of += by.keys()
                js += by.values()
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(of, pa.int32()), pa.array(js, pa.list_(pa.int32()))], ["qid", "qv", "i", "js"])

    return run


def scorer(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a block of entries and a block of queries: the k best entries of each query among the cells that it visits."""

    def run(entries: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        out: list[list[np.ndarray]] = [[], [], []]
        if len(entries) and len(queries):
            e, q = matrix(entries["v"].combine_chunks()), matrix(queries["qv"].combine_chunks())
            eid, qid, j = entries["id"].to_numpy(), queries["qid"].to_numpy(), entries["j"].to_numpy()
            js = queries["js"].combine_chunks()
            seen = np.zeros((len(q), int(max(j.max(), js.flatten().to_numpy().max(initial=0))) + 1), bool)
            seen[np.repeat(np.arange(len(q)), np.diff(js.offsets.to_numpy())), js.flatten().to_numpy()] = True
            longest = np.linalg.norm(e, axis=1).max()
            for s in range(0, len(q), 256):
                score = q[s : s + 256] @ e.T
                score[~seen[s : s + 256][:, j]] = -np.inf
                score[qid[s : s + 256][:, None] == eid[None, :]] = -np.inf
                m = min(k, score.shape[1])
                kth = np.partition(score, score.shape[1] - m, 1)[:, score.shape[1] - m]
                # all entries that may tie with the k-th: the product may round otherwise than the sum below
                slack = 4 * e.shape[1] * np.finfo(float).eps * np.linalg.norm(q[s : s + 256], axis=1) * longest
                least = np.where(np.isfinite(kth) & np.isfinite(slack), kth - slack, -np.inf)
                r, c = np.nonzero((score >= least[:, None]) & (score > -np.inf))
                exact = np.concatenate([(q[s + r[x : x + EXACT]] * e[c[x : x + EXACT]]).sum(1) for x in range(0, len(r), EXACT)] or [np.zeros(0)])
                o = np.lexsort((eid[c], -exact, r))
                r, c, exact = r[o], c[o], exact[o]
                rank = np.arange(len(r)) - np.searchsorted(r, r)
                keep = rank < k
                for x, y in zip(out, (qid[s + r[keep]], eid[c[keep]], exact[keep]), strict=True):
                    x.append(y)
        kinds = [np.int64, np.int64, np.float64]
        return pa.table({n: np.concatenate(x).astype(t) if x else np.zeros(0, t) for n, x, t in zip(names, out, kinds, strict=True)})

    return run


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, cells: int = 32, fraction: float = 0.55, least: int = 2000, sample: int = 20_000, block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for each row for which is_query (of column id) holds."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(v))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    spark = vectors.sparkSession
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == lengths[0]["n"]).groupBy("id").agg(F.max("v").alias("v"))
    some = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()])
    half = some.shape[1] // 2
    c1, c2 = (kmeans(x, min(cells, len(x))) for x in (some[:, :half], some[:, half:]))
    index = written(rows.mapInArrow(assigner(c1, c2), "id long, v array<double>, i int, j int"), "index")
    counts = np.zeros((len(c1), len(c2)), np.int64)
    for r in index.groupBy("i", "j").count().collect():
        counts[r["i"], r["j"]] = r["count"]
    n = int(counts.sum())
    queries = index.where(is_query)
    walked = queries.select("id", "v").mapInArrow(walker(c1, c2, counts, max(least, int(np.ceil(fraction * n)))), "qid long, qv array<double>, i int, js array<int>")
    parts = F.element_at(F.array(*(F.lit(int(-(-x // block)) or 1) for x in counts.sum(1))), F.col("i") + 1)
    q_parts = max(1, -(-queries.count() // block))
    left = index.select("id", "v", "i", "j", F.pmod(F.xxhash64("id"), parts).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))).alias("qb"))
    right = walked.select("qid", "qv", "i", "js", F.pmod(F.xxhash64("qid"), F.lit(q_parts)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), parts - 1).cast("array<bigint>")).alias("b"))
    pairs = left.groupBy("i", "b", "qb").cogroup(right.groupBy("i", "b", "qb"))
    found = pairs.applyInArrow(scorer(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
