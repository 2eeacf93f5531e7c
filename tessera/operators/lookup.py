"""Search by places on the grid: statistics of places, neighbourhoods, spatial clusters, smoothed fingerprints."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import LookupConfig
from ..functions import grid as G
from ..functions import scan


def position_stats(posts: DataFrame, dim: int, config: LookupConfig = LookupConfig()) -> DataFrame:
    """position, words, information (-ln((n+s)/(V+s))), idf (ln(V/(1+n))), density (mean words within the radius)."""
    size = dim * dim
    total = posts.agg(F.countDistinct("word").alias("V"))
    every = posts.sparkSession.range(size).select(F.col("id").cast("int").alias("position"))
    n = every.join(posts.groupBy("position").agg(F.count("*").alias("n")), "position", "left").select("position", F.coalesce("n", F.lit(0)).alias("words"))
    near = n.select("words", F.explode(G.neighbours(F.col("position"), config.radius, dim)).alias("x")).groupBy(F.col("x.position").alias("position")).agg(F.avg("words").alias("density"))
    s = config.smoothing
    both = n.join(near, "position").crossJoin(F.broadcast(total))  # one row
    info = -F.log((F.col("words") + s) / (F.col("V") + s))
    return both.select("position", "words", F.round(info, 9).alias("information"), F.round(F.log(F.col("V") / (1 + F.col("words"))), 9).alias("idf"), F.round("density", 9).alias("density"))


def adaptive_radius(stats: DataFrame, config: LookupConfig = LookupConfig()) -> DataFrame:
    mean = stats.agg(F.avg("density").alias("mean"))
    r = config.radius * F.sqrt(F.col("mean") / (F.col("density") + 1))
    return stats.crossJoin(F.broadcast(mean)).select("position", F.round(F.least(F.greatest(r, F.lit(config.adaptive[0])), F.lit(config.adaptive[1])), 9).alias("radius"))


def lookup(posts: DataFrame, stats: DataFrame, positions: list[int], k: int, dim: int, config: LookupConfig = LookupConfig()) -> DataFrame:
    """word, weighted (sum over the places near the asked ones of Gaussian weights times 1 + idf), overlap (such places of
    the word), nearest (least distance), score = weighted * (1 + ln(overlap))."""
    q = posts.sparkSession.createDataFrame([(p,) for p in positions], "q int")
    near = q.select(F.explode(G.neighbours(F.col("q"), config.radius, dim)).alias("x")).select("x.position", "x.distance")
    w = G.gaussian_weight(F.col("distance"), config.sigma)
    by_place = near.groupBy("position").agg(F.sum(w).alias("w"), F.min("distance").alias("d"))
    hit = by_place.join(stats.select("position", "idf"), "position").join(posts, "position")
    out = hit.groupBy("word").agg(F.sum(F.col("w") * (1 + F.col("idf"))).alias("weighted"), F.min("d").alias("nearest"), F.count("*").alias("overlap"))
    out = out.select("word", F.round(F.col("weighted") * (1 + F.log("overlap")), 6).alias("score"), F.round("weighted", 6).alias("weighted"), "nearest", "overlap")
    return out.orderBy(F.desc("score"), "word").limit(k)


def convolve(sets: DataFrame, dim: int, id_col: str = "id", config: LookupConfig = LookupConfig()) -> DataFrame:
    """(id, position, value): each bit spread by a kernel that wraps around."""
    steps = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(w).alias("w")) for r, c, w in G.kernel(config.kernel, config.sigma)))
    bits = sets.select(id_col, F.explode("positions").alias("p")).select(id_col, "p", F.explode(steps).alias("s"))
    at = G.linear(F.pmod(G.row(F.col("p"), dim) + F.col("s.r"), F.lit(dim)), F.pmod(G.col(F.col("p"), dim) + F.col("s.c"), F.lit(dim)), dim)
    return bits.select(id_col, at.alias("position"), F.col("s.w").alias("w")).groupBy(id_col, "position").agg(F.sum("w").alias("value"))


def smoothed_similarity(pairs: DataFrame, sets: DataFrame, dim: int, id_col: str = "id", config: LookupConfig = LookupConfig()) -> DataFrame:
    """(a, b, similarity, met): cosine of convolved fingerprints for the pairs (a, b), 0 without one of them, and whether they
    meet in a place.  The fingerprints of a pair are spread where they meet; no spread place moves."""
    own = lambda c: sets.select(F.col(id_col).alias(c), F.col("positions").alias(f"p{c}"))
    both = pairs.select("a", "b").join(own("a"), "a", "left").join(own("b"), "b", "left").select("a", "b", "pa", "pb")
    kinds = dict(both.dtypes)
    out = both.mapInArrow(scan.smoothed(dim, G.kernel(config.kernel, config.sigma)), f"a {kinds['a']}, b {kinds['b']}, similarity double, met boolean")
    return out.withColumn("similarity", F.round("similarity", 6))


def centroid(cells: np.ndarray, dim: int) -> int:
    """Circular mean of places, cut to a place."""

    def mean(x: np.ndarray) -> int:
        a = x * (2 * math.pi / dim)
        m = math.atan2(np.sin(a).mean(), np.cos(a).mean()) % (2 * math.pi)
        return int(m * dim / (2 * math.pi) + 1e-9) % dim

    return mean(cells // dim) * dim + mean(cells % dim)


def clusters(posts: DataFrame, dim: int, k: int, rounds: int = 50, seed: int = 7) -> DataFrame:
    """(position, cluster, centroid) by toroidal k-means over the places in use: the grid fits on the driver, whatever the corpus."""
    cells = np.array(sorted(r[0] for r in posts.select("position").distinct().collect()))
    if not len(cells):
        return posts.sparkSession.createDataFrame([], "position int, cluster int, centroid int")

    def gaps(c: np.ndarray) -> np.ndarray:
        dr, dc = np.abs(cells[:, None] // dim - c[None, :] // dim), np.abs(cells[:, None] % dim - c[None, :] % dim)
        return np.minimum(dr, dim - dr) ** 2 + np.minimum(dc, dim - dc) ** 2

    rng = np.random.default_rng(seed)
    c = cells[[int(rng.integers(len(cells)))]]
    while len(c) < min(k, len(cells)):
        d = gaps(c).min(1).astype(float)
        c = np.append(c, cells[int(rng.choice(len(cells), p=d / d.sum()))])
    for _ in range(rounds):
        near = gaps(c).argmin(1)
        new = np.array([centroid(cells[near == j], dim) for j in range(len(c)) if (near == j).any()])
        if len(new) == len(c) and (new == c).all():
            break
        c = new
    near = gaps(c).argmin(1)
    return posts.sparkSession.createDataFrame([(int(p), int(j), int(c[j])) for p, j in zip(cells, near, strict=True)], "position int, cluster int, centroid int")


def representatives(posts: DataFrame, stats: DataFrame, cluster: DataFrame, k: int = 10) -> DataFrame:
    """The k words of each cluster with the largest sum of idf over its places."""
    score = cluster.join(posts, "position").join(stats.select("position", "idf"), "position").groupBy("cluster", "word").agg(F.round(F.sum("idf"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), "word"))
    return score.withColumn("rank", rank).where(F.col("rank") <= k)
