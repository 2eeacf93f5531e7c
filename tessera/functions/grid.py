"""Geometry of a square toroidal grid whose cells are numbered row by row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def row(p: Column, dim: int) -> Column:
    return F.floor(p / dim).cast("int")


def col(p: Column, dim: int) -> Column:
    return F.pmod(p, F.lit(dim)).cast("int")


def linear(r: Column, c: Column, dim: int) -> Column:
    return (r * dim + c).cast("int")


def _gap(x: Column, y: Column, dim: int) -> Column:
    return F.least(F.abs(x - y), dim - F.abs(x - y))


def distance(a: Column, b: Column, dim: int) -> Column:
    dr, dc = _gap(row(a, dim), row(b, dim), dim), _gap(col(a, dim), col(b, dim), dim)
    return F.sqrt((dr * dr + dc * dc).cast("double"))


def manhattan(a: Column, b: Column, dim: int) -> Column:
    return _gap(row(a, dim), row(b, dim), dim) + _gap(col(a, dim), col(b, dim), dim)


def flat_distance(a: Column, b: Column, dim: int) -> Column:
    dr, dc = row(a, dim) - row(b, dim), col(a, dim) - col(b, dim)
    return F.sqrt((dr * dr + dc * dc).cast("double"))


def angle(a: Column, b: Column, dim: int) -> Column:
    """Bearing of the shortest way from a to b."""

    def short(d: Column) -> Column:
        return F.when(d > dim / 2, d - dim).when(d < -dim / 2, d + dim).otherwise(d)

    return F.atan2(short(row(b, dim) - row(a, dim)).cast("double"), short(col(b, dim) - col(a, dim)).cast("double"))


def collinear(a: Column, b: Column, c: Column, dim: int, tolerance: float) -> Column:
    """Is the longest of the three distances, less the shortest and a middle one, within a tolerance of 0.  The middle one
    is a nest of extremes that is not always the median."""
    x, y, z = distance(a, b, dim), distance(b, c, dim), distance(a, c, dim)
    longest, shortest = F.greatest(x, y, z), F.least(x, y, z)
    middle = F.least(longest, F.greatest(F.least(x, y), z, F.least(F.greatest(x, y), z)))
    return F.abs(longest - shortest - middle) < tolerance


def gaussian_weight(d: Column, sigma: float) -> Column:
    return F.exp(-(d * d) / (2 * sigma * sigma))


def exponential_weight(d: Column) -> Column:
    return F.pow(F.lit(2.0), -d)


def shifted(p: Column, dr: int, dc: int, dim: int) -> Column:
    return linear(F.pmod(row(p, dim) + dr, F.lit(dim)), F.pmod(col(p, dim) + dc, F.lit(dim)), dim)


def moore(p: Column, dim: int) -> Column:
    return F.array(*(shifted(p, r, c, dim) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c))


def von_neumann(p: Column, dim: int) -> Column:
    return F.array(*(shifted(p, r, c, dim) for r, c in ((-1, 0), (0, -1), (0, 1), (1, 0))))


def offsets(radius: float) -> list[tuple[int, int, float]]:
    """Steps (rows, columns, distance) nearer than radius, the nearest first."""
    k = math.ceil(radius)
    near = [(math.hypot(r, c), r, c) for r in range(-k, k + 1) for c in range(-k, k + 1)]
    return [(r, c, d) for d, r, c in sorted(near) if d < radius]


def neighbours(p: Column, radius: float, dim: int) -> Column:
    """array of (position, distance) nearer than radius."""
    return F.array(*(F.struct(shifted(p, r, c, dim).alias("position"), F.lit(d).alias("distance")) for r, c, d in offsets(radius)))


def kernel(size: int, sigma: float) -> list[tuple[int, int, float]]:
    """A normalised Gaussian kernel as steps with weights."""
    half = size // 2
    w = {(r, c): math.exp(-(r * r + c * c) / (2 * sigma * sigma)) for r in range(-half, half + 1) for c in range(-half, half + 1)}
    total = sum(w.values())
    return [(r, c, x / total) for (r, c), x in w.items()]


def all_distances(spark: SparkSession, dim: int) -> DataFrame:
    """Distance of all pairs of cells.  Quadratic in the grid, which is small; meant for small ones."""
    n = spark.range(dim * dim).select(F.col("id").cast("int").alias("p"))
    pairs = n.select("p", F.explode(F.sequence(F.lit(0), F.lit(dim * dim - 1))).alias("q"))
    return pairs.select("p", "q", distance(F.col("p"), F.col("q"), dim).alias("distance"))
