"""Dense vectors as arrays: distances, normalisation, signatures and product codes."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_squared(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def scale(a: Column, by: float) -> Column:
    return F.transform(a, lambda x: x * by)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def normalise(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 1e-10, F.transform(a, lambda x: x / norm)).otherwise(a)


def pull(w: Column, x: Column, influence: float) -> Column:
    """w moved towards x."""
    return F.zip_with(w, x, lambda a, b: a + influence * (b - a))


def uniform(*key: object) -> float:
    """A number in [0, 1) that depends on the key alone."""
    return int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:13], 16) / 16**13


def gaussian(*key: object) -> float:
    return math.sqrt(-2 * math.log(1 - uniform(*key, "u"))) * math.cos(2 * math.pi * uniform(*key, "v"))


def hyperplanes(dim: int, bits: int, seed: int = 42) -> list[list[float]]:
    return [[round(gaussian(seed, b, d), 6) for d in range(dim)] for b in range(bits)]


def simhash(vector: Column, planes: list[list[float]]) -> Column:
    """Sign bits of the products with at most 63 hyperplanes."""
    bits = (F.when(dot(vector, F.array(*map(F.lit, p))) >= 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, p in enumerate(planes))
    total = F.lit(0).cast("long")
    for b in bits:
        total = total + b
    return total


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def estimated_cosine(hamming_distance: Column, bits: int) -> Column:
    return F.cos(F.lit(math.pi) * hamming_distance / bits)


def pq_encode(vector: Column, codebooks: list[list[list[float]]]) -> Column:
    """Nearest centroid of each part (the first of equals)."""
    codes, at = [], 1
    for book in codebooks:
        part = F.slice(vector, at, len(book[0]))
        d = F.array(*(F.struct(l2_squared(part, F.array(*map(F.lit, c))).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(book)))
        codes.append(F.array_min(d)["k"])
        at += len(book[0])
    return F.array(*codes)


def pq_decode(codes: Column, codebooks: list[list[list[float]]]) -> Column:
    parts = [F.element_at(F.array(*(F.array(*map(F.lit, c)) for c in book)), F.element_at(codes, m + 1) + 1) for m, book in enumerate(codebooks)]
    return F.concat(*parts)


def pq_table(query: list[float], codebooks: list[list[list[float]]]) -> list[list[float]]:
    """Squared distances of each part of a query to its centroids."""
    out, at = [], 0
    for book in codebooks:
        part = query[at : at + len(book[0])]
        out.append([sum((x - y) ** 2 for x, y in zip(part, c, strict=True)) for c in book])
        at += len(book[0])
    return out


def pq_distance(codes: Column, table: list[list[float]]) -> Column:
    total = F.lit(0.0)
    for m, row in enumerate(table):
        total = total + F.element_at(F.array(*map(F.lit, row)), F.element_at(codes, m + 1) + 1)
    return total
