"""Vector operators with numeric kernels: context embeddings, map training, best-matching units, product quantisation."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BadDimension, SomConfig
from ..functions import text as T
from ..functions.hdc import hashed


def context_embeddings(docs: DataFrame, dim: int = 100, half: int = 2, text_col: str = "text") -> DataFrame:
    """(word, vec): the normalised sum of the seeded random vectors of a word's context words.  Counts of (word, context
    word) are added up first, so a pair costs one vector however often it occurs."""
    w = docs.select(F.explode(T.context_windows(T.tokens(F.col(text_col)), half)).alias("w"))
    pairs = w.select("w.center", F.explode("w.context").alias("c")).groupBy("center", "c").agg(F.count("*").alias("n"))
    place = F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("d")
    value = F.pmod(hashed(F.concat_ws(":", F.col("c"), F.col("d").cast("string"))), F.lit(2_000_001)) / 1_000_000.0 - 1
    parts = pairs.select("center", "c", "n", place).groupBy("center", "d").agg(F.sum(F.col("n") * value).alias("v"))
    rows = parts.groupBy(F.col("center").alias("word")).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda x: x["v"]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return rows.select("word", F.transform("v", lambda x: x / F.when(norm > 1e-10, norm).otherwise(1.0)).alias("vec"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest_units(x: np.ndarray, w: np.ndarray, rows: int = 2048) -> np.ndarray:
    """Index of the nearest weight vector of each row (the first of equals), a block of rows at a time."""
    if x.shape[1] != w.shape[1]:
        raise BadDimension(f"{x.shape[1]} components, the map has {w.shape[1]}")
    norms = (w * w).sum(1)
    return np.concatenate([(norms - 2 * x[i : i + rows] @ w.T).argmin(1) for i in range(0, len(x), rows)]) if len(x) else np.zeros(0, np.int64)


def assign_units(vectors: DataFrame, weights: np.ndarray, id_col: str, vec_col: str) -> DataFrame:
    """(id, unit): best-matching unit of each vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(np.ascontiguousarray(weights))  # a map: fixed by the grid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nearest_units(_matrix(b.column(1)), shared.value).astype(np.int32))], ["id", "unit"])

    out = vectors.select(id_col, F.col(vec_col).cast("array<double>")).mapInArrow(run, f"id {dict(vectors.dtypes)[id_col]}, unit int")
    return out.withColumnRenamed("id", id_col)


def k_nearest_units(vectors: DataFrame, weights: np.ndarray, k: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, rank, unit, distance): the k nearest units of each vector, nearest first (ties: the smaller unit)."""
    shared = vectors.sparkSession.sparkContext.broadcast(np.ascontiguousarray(weights))  # a map: fixed by the grid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.slice(at, 512)
                x = _matrix(part.column(1))
                d = np.sqrt(np.maximum(((x[:, None, :] - w[None, :, :]) ** 2).sum(2), 0)) if len(w) <= 1024 else np.sqrt(np.maximum((x * x).sum(1)[:, None] + (w * w).sum(1)[None, :] - 2 * x @ w.T, 0))
                order = np.argsort(d, axis=1, kind="stable")[:, :k]
                m = order.shape[1]
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(part)), m)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(part))), pa.array(order.ravel().astype(np.int32)), pa.array(np.take_along_axis(d, order, 1).ravel())], ["id", "rank", "unit", "distance"])

    out = vectors.select(id_col, F.col(vec_col).cast("array<double>")).mapInArrow(run, f"id {dict(vectors.dtypes)[id_col]}, rank int, unit int, distance double")
    return out.withColumnRenamed("id", id_col)


def neighbourhood(dim: int, radius: float, toroidal: bool = True) -> np.ndarray:
    """Weights exp(-d^2 / 2r^2) between all units of a grid, 0 beyond three radii."""
    i = np.arange(dim)
    g = np.abs(i[:, None] - i[None, :])
    g = np.minimum(g, dim - g) if toroidal else g
    d = (g[:, None, :, None] ** 2 + g[None, :, None, :] ** 2).reshape(dim * dim, dim * dim)
    return np.where(d <= 9 * radius * radius, np.exp(-d / (2 * radius * radius)), 0)


def decayed(pair: tuple[float, float], t: int, total: int) -> float:
    return pair[0] * (pair[1] / pair[0]) ** (t / max(1, total))


def train_online(x: np.ndarray, config: SomConfig, steps: int) -> np.ndarray:
    """The sequential rule, on a bounded sample in the driver's memory: each step depends on the one before."""
    rng = np.random.default_rng(config.seed)
    w = rng.normal(0, 0.1, (config.total_neurons, x.shape[1]))
    i = np.arange(config.dimension)
    for t in range(steps):
        if t % len(x) == 0:
            order = rng.permutation(len(x))
        v = x[order[t % len(x)]]
        unit = int(((w - v) ** 2).sum(1).argmin())
        radius = decayed(config.radius, t, steps)
        gr, gc = np.abs(i - unit // config.dimension), np.abs(i - unit % config.dimension)
        if config.toroidal:
            gr, gc = np.minimum(gr, config.dimension - gr), np.minimum(gc, config.dimension - gc)
        d = (gr[:, None] ** 2 + gc[None, :] ** 2).ravel()
        near = d <= 9 * radius * radius
        w[near] += (decayed(config.rate, t, steps) * np.exp(-d[near] / (2 * radius * radius)))[:, None] * (v - w[near])
    return w


def train_batch(vectors: DataFrame, vec_col: str, config: SomConfig, epochs: int = 10) -> tuple[np.ndarray, list[dict[str, float]]]:
    """Batch rule over all rows: in each epoch tasks add up vectors and counts by best unit (a map's size each), the
    driver smooths them over the grid.  Gives weights and the epochs' metrics (qe: mean squared distance; radius)."""
    spark, n, rng = vectors.sparkSession, config.total_neurons, np.random.default_rng(config.seed)
    first = vectors.select(F.size(vec_col).alias("n")).limit(1).collect()
    if not first:
        return np.zeros((n, 0)), []
    w = rng.normal(0, 0.1, (n, first[0]["n"]))
    metrics = []
    for e in range(epochs):
        shared = spark.sparkContext.broadcast(w)

        def run(batches: Iterator[pa.RecordBatch], shared: object = shared) -> Iterator[pa.RecordBatch]:
            total, count, qe = np.zeros_like(shared.value), np.zeros(len(shared.value)), 0.0
            for b in batches:
                if len(b):
                    x = _matrix(b.column(0))
                    u = nearest_units(x, shared.value)
                    np.add.at(total, u, x)
                    count += np.bincount(u, minlength=len(count))
                    qe += float(((x - shared.value[u]) ** 2).sum())
            used = np.flatnonzero(count)
            yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(list(total[used]), pa.list_(pa.float64())), pa.array(count[used]), pa.array([qe if i == 0 else 0.0 for i in range(len(used))], pa.float64())], ["unit", "total", "n", "qe"])

        parts = vectors.select(F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(run, "unit int, total array<double>, n double, qe double")
        added = parts.groupBy("unit").agg(*(F.sum(F.get("total", d)).alias(f"t{d}") for d in range(w.shape[1])), F.sum("n").alias("n"), F.sum("qe").alias("qe")).collect()
        total, count = np.zeros_like(w), np.zeros(n)
        for r in added:
            total[r["unit"]], count[r["unit"]] = r[1:-2], r["n"]
        radius = decayed((config.dimension / 2, 1.0), e, epochs - 1)
        h = neighbourhood(config.dimension, radius, config.toroidal)
        below = h @ count
        w = np.where(below[:, None] > 0, (h @ total) / np.maximum(below, 1e-12)[:, None], w)
        metrics.append({"epoch": e, "qe": float(sum(r["qe"] for r in added) / max(1.0, count.sum())), "radius": radius})
    return w, metrics


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[[int(rng.integers(len(x)))]]
    while len(c) < min(k, len(x)):
        d = np.min([((x - y) ** 2).sum(1) for y in c], 0)
        c = np.vstack([c, x[int(rng.choice(len(x), p=d / d.sum()))] if d.sum() > 0 else x[len(c)]])
    for _ in range(rounds):
        near = nearest_units(x, c)
        c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
    return c


def train_codebooks(sample: np.ndarray, parts: int = 8, k: int = 256, rounds: int = 25) -> list[np.ndarray]:
    """Product quantiser of a bounded sample: one k-means for each part of the vector (seed: the part's number)."""
    if sample.shape[1] % parts:
        raise BadDimension(f"{sample.shape[1]} components don't divide into {parts} parts")
    return [kmeans(p, k, rounds, m) for m, p in enumerate(np.split(sample, parts, axis=1))]


def train_rotation(sample: np.ndarray, parts: int = 8, k: int = 16, rounds: int = 5) -> tuple[np.ndarray, list[np.ndarray]]:
    """An orthogonal rotation (Procrustes) and codebooks, in turn."""
    r = np.eye(sample.shape[1])
    for _ in range(rounds):
        x = sample @ r
        books = train_codebooks(x, parts, k, 5)
        back = np.hstack([b[nearest_units(p, b)] for p, b in zip(np.split(x, parts, axis=1), books, strict=True)])
        u, _, v = np.linalg.svd(sample.T @ back)
        r = u @ v
    return r, train_codebooks(sample @ r, parts, k, 10)


def encoder(books: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = _matrix(b.column(1))
                codes = np.stack([nearest_units(p, c) for p, c in zip(np.split(x, len(books), axis=1), books, strict=True)], 1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32()))], ["id", "codes"])

    return run


def encode(vectors: DataFrame, books: list[np.ndarray], id_col: str, vec_col: str) -> DataFrame:
    """(id, codes)."""
    out = vectors.select(id_col, F.col(vec_col).cast("array<double>")).mapInArrow(encoder(books), f"id {dict(vectors.dtypes)[id_col]}, codes array<int>")
    return out.withColumnRenamed("id", id_col)


def compression(dim: int, parts: int) -> float:
    return dim * 4 / parts


def sample_rows(vectors: DataFrame, vec_col: str, id_col: str, most: int = 10_000) -> np.ndarray:
    rows = vectors.orderBy(F.xxhash64(id_col), id_col).limit(most).select(F.col(vec_col).cast("array<double>").alias("v")).collect()
    return np.array([r["v"] for r in rows])


def recommended_batch(neurons: int, budget: int = 1 << 28) -> int:
    return int(min(500_000, max(10_000, budget // max(1, 4 * neurons))))


def radius_steps(radius: float, threshold: float) -> list[tuple[int, int, float]]:
    """Steps of a neighbourhood whose weight passes a threshold."""
    k = math.ceil(1.5 * radius)
    near = [(r, c, math.exp(-(r * r + c * c) / (2 * radius * radius))) for r in range(-k, k + 1) for c in range(-k, k + 1) if r * r + c * c <= 4 * radius * radius]
    return [x for x in near if x[2] > threshold]
